"""Secrets in whole texts, in DataFrame functions only: fixed patterns, and Markov models of characters for the rest.

Both models are tables of transitions between neighbouring characters. One is trained on strings labelled random: the
values that the patterns found, and digests in usual alphabets. The other is trained on ordinary words and identifiers.
A long token is a secret if the mean log-likelihood ratio of its transitions is high enough.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.tables import read, texts

# Fixed values of the contract, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Mean log-likelihood ratio per transition, in nats, from which a token counts as random.
RATIO = 0.75
#: Bounds of the training data: about so many documents for ordinary words, so many random strings of each alphabet.
SAMPLE = 1500
DIGESTS = 1500

SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,value:string>>"


def spans(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Where a pattern matches: what lies between the matches and the matches themselves add up to the positions."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(
        F.zip_with(gaps, matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))), values,
        lambda x, value: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), value.alias("value")),
    )

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind_no"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))
    found = F.aggregate(parts, start, add, lambda state: state["out"])
    return F.filter(found, lambda span: span["value"].isNotNull())  # the gap after the last match has none


def none() -> Column:
    return F.array().cast(SPANS)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base``: the matches of the three patterns. Only texts that can match meet the patterns."""
    low = F.lower("text")
    named = functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")))
    assign = F.filter(spans(F.col("text"), ASSIGN, 2, 0), lambda span: F.length(span["value"]) >= 6)
    hexes = F.when(F.col("text").rlike(HEX), spans(F.col("text"), HEX, 0, 2)).otherwise(none())
    access = F.when(F.contains("text", F.lit("AKIA")), spans(F.col("text"), ACCESS, 0, 1)).otherwise(none())
    return docs.select("*", F.concat(F.when(named, assign).otherwise(none()), access, hexes).alias("_base"))


def pairs(values: Column) -> Column:
    """All pairs of neighbouring characters, by a look-ahead that moves on by one character."""
    return F.regexp_extract_all(values, F.lit("(?s)(?=(..))"), F.lit(1))


def counts(values: DataFrame) -> dict[int, int]:
    """How often each transition occurs in a column ``value``: at most ``STATES`` squared numbers."""
    rows = values.select(F.explode(pairs(F.col("value"))).alias("pair")).groupBy(transition(F.col("pair")).alias("k")).agg(F.count("*").alias("n"))
    return {row["k"]: row["n"] for row in rows.collect()}


def transition(pair: Column) -> Column:
    """Place of a pair in a table of ``STATES`` x ``STATES``; characters outside the alphabet are state 0."""
    return F.instr(F.lit(ALPHABET), F.substring(pair, 1, 1)) * STATES + F.instr(F.lit(ALPHABET), F.substring(pair, 2, 1))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, random against ordinary, with one added to all counts.

    Random: values of the base patterns in the sampled documents, and digests as hexadecimal, base 64 and letters with
    digits. Ordinary: the words of the sampled documents without what the patterns found, as they are and joined to
    identifiers. ``docs`` has ``doc_id`` and ``text`` and is sampled by a hash of the text.
    """
    spark, total = docs.sparkSession, max(docs.count(), 1)
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(min(1.0, SAMPLE / total) * (1 << 20)))
    sample = base_spans(chosen)
    found = sample.select(F.explode("_base").alias("span")).where(F.length("span.value") >= 16).select(F.col("span.value").alias("value"))
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    code = F.base64(F.unhex(digest))
    digests = spark.range(DIGESTS).select(F.explode(F.array(
        digest, code, F.translate(code, "+/=", "-_"), F.translate(code, "+/=", ""), F.upper(F.translate(code, "+/=", "")),
    )).alias("value"))
    plain = functools.reduce(lambda text, pattern: F.regexp_replace(text, pattern, " "), (ASSIGN, ACCESS, HEX), F.col("text"))
    words = F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,}[0-9]{0,3}(?![A-Za-z0-9])"), F.lit(0))
    listed = chosen.select(words.alias("words")).where(F.size("words") > 0)
    following = F.slice("words", 2, F.size("words"))

    def joined_by(mark: str) -> Column:
        return F.zip_with("words", following, lambda a, b: F.concat(a, F.lit(mark), F.coalesce(b, F.lit("0"))))

    ordinary = listed.select(F.explode(F.concat("words", joined_by("_"), joined_by("-"))).alias("value"))
    random_counts, word_counts = counts(found.unionByName(digests)), counts(ordinary)

    def logs(seen: dict[int, int]) -> list[float]:
        out = []
        for state in range(STATES):
            row = [seen.get(state * STATES + k, 0) + 1 for k in range(STATES)]
            out += [math.log(n / sum(row)) for n in row]
        return out

    return [a - b for a, b in zip(logs(random_counts), logs(word_counts))]


def with_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``docs`` (``text`` not null) with ``_base`` and ``_spans``: all spans by start and kind, in code points.

    Spans of kind ``markov`` are tokens of at least 20 characters with letters and digits that touch no base span.
    """
    table = F.split(F.lit(",".join(repr(round(r, 6)) for r in ratios)), ",").cast("array<double>")

    def mean_ratio(value: Column) -> Column:
        total = F.aggregate(pairs(value), F.lit(0.0), lambda so_far, pair: so_far + F.element_at(table, transition(pair) + 1))
        return total / (F.length(value) - 1)

    based = base_spans(docs)
    tokens = F.when(F.col("text").rlike(TOKEN), F.filter(
        spans(F.col("text"), TOKEN, 0, 3),
        lambda span: span["value"].rlike("[0-9]") & span["value"].rlike("[A-Za-z]"),
    )).otherwise(none())
    listed = based.select("*", tokens.alias("_tokens"))
    fresh = F.filter(F.col("_tokens"), lambda token: ~F.exists(F.col("_base"), lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"])))
    added = F.filter(fresh, lambda token: mean_ratio(token["value"]) >= RATIO)
    return listed.select(
        *docs.columns, "_base",
        F.when(F.size("_tokens") == 0, F.array_sort("_base")).otherwise(F.array_sort(F.concat("_base", added))).alias("_spans"),
    )


def joined(found: Column) -> Column:
    name = F.array(*(F.lit(kind) for kind in KINDS))
    ordered = F.array_sort(found)
    return F.array_join(F.transform(ordered, lambda span: F.concat_ws(":", F.element_at(name, span["kind_no"] + 1), span["start"].cast("string"), span["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``text``, ``_base`` and ``_spans``. A null or empty text has no spans."""
    rows = texts(docs)
    return with_secrets(rows, train(rows))


def redact(text: Column, found: Column, mark: str = "[secret]", values: bool = False) -> Column:
    """``text`` with every span, or run of spans that overlap, replaced by ``mark``.

    With ``values`` only the value of an assignment goes: its name and both quotes stay.
    """

    def secret(span: Column) -> Column:
        # the value ends where the match does
        start = F.when(F.lit(values) & (span["kind_no"] == 0), span["end"] - F.length(span["value"])).otherwise(span["start"])
        return F.struct(start.alias("start"), span["end"].alias("end"))

    def cut(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        kept = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, kept).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(F.array_sort(F.transform(found, secret)), start, cut, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(found) > 0, rest).otherwise(text)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("_base", lambda span: span["kind_no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"),
    )
