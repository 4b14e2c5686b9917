"""Personal data in whole texts: fixed patterns, and weakly supervised spans beside them.

Wider patterns propose spans. For each, labelers vote yes, no or nothing: the fixed pattern, check sums and ranges,
a gazetteer, the words before it, and whether it stands alone. Expectation-maximisation estimates from the counts of
all vote patterns how reliable each labeler is, without any labels, and how likely each vote pattern is personal data.
A logistic regression learns these probabilities from votes and looks of the spans, and decides on what the fixed
patterns didn't find.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.tables import read, texts
from curbside.session import stage

# Fixed values of the contract, in the order of the kinds.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # the contract's pattern: what matches inside a run of digits matches from its beginning, so only that is tried
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# What proposes further spans. Every one is anchored at a rare character or word, so scanning stays linear.
WIDER = {
    "email": re.compile(
        r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)[A-Z0-9-]{1,63}"
        r"(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)[A-Z0-9-]{1,63})+"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?(?:[0-9A-Fa-f]{1,4}:?){0,4}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9.])(?:[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})(?![0-9])"),
    "phone": re.compile(
        r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[\x20.-]?|\([0-9]{2,5}\)[\x20-]?|0[0-9]{2,4}[\x20/-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9.])"
        r"|(?<![0-9+(.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
}
#: Without a match of these no pattern of the kinds can match; most texts have none, and the tests are cheap.
DIGIT = re.compile(r"[0-9]")
RUN_OF_DIGITS = re.compile(r"[0-9][\x20()./0-9-]{5,}[0-9]")
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:")
SPELLED_AT = (re.compile(r"[(\[{]\x20?[aA][tT]\x20?[)\]}]"), re.compile(r"\x20[aA][tT]\x20[A-Za-z0-9-]+(?:\.[A-Za-z0-9]|\x20?[(\[{]?\x20?[dD][oO][tT])"))
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co eu uk us de fr es it nl be ch at pl pt se no fi dk ie ca au nz jp cn in br mx ru example test".split())
CONTEXT = {
    "email": frozenset("email e-mail mail contact contacto courriel kontakt correo write".split()),
    "ip": frozenset("ip ipv4 ipv6 address host server client login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon teléfono téléphone handy".split()),
}
AGAINST = frozenset("isbn issn version order invoice build ticket article page id no nr serial doi".split())
LABELERS = ("pattern", "check", "gazetteer", "context", "alone")
YES, NO, NOTHING = 1, 0, -1
#: Bound of the spans that the classifier is trained on.
SAMPLE = 20_000
#: Probability from which a proposed span counts.
SURE = 0.9
BEFORE = re.compile(r"[\w-]+")


def digits(found: str) -> str:
    return re.sub(r"[^0-9]", "", found)


def luhn(number: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(number)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether a match of the fixed pattern counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in found.split("."))
    number = digits(found)
    return 13 <= len(number) <= 19 and luhn(number) if kind == "card" else 9 <= len(number) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, non-overlapping per kind, those that fail dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for k, kind in enumerate(KINDS[1:], 1):
            out += [(k, m.start(), m.end()) for m in BASE[kind].finditer(text) if valid(kind, m[0])]
    return out


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """All matches of the email pattern. They are looked for around each @, as scanning from every letter is slow."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := BASE["email"].match(text, start)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def vote(kind: str, text: str, start: int, end: int, is_base: bool) -> list[int]:
    found = text[start:end]
    number = digits(found)
    words = [w.lower() for w in BEFORE.findall(text[max(0, start - 40):start])][-4:]
    pattern = YES if is_base else NOTHING
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", found.lower().rstrip(")]}"))[-1]
        check = YES if re.search(r"[A-Za-z]", found) else NO
        gazetteer = YES if last in TOP_LEVEL else NO
    elif kind == "ip":
        check = YES if (":" in found and len(found.split(":")) >= 4 and re.search("[0-9]", found)) or ("." in found and valid("ip", found)) else NO
        gazetteer = NO if found.startswith(("0.", "127.")) else (YES if "." in found or found.lower().startswith(("2", "fe80", "fd", "fc")) else NOTHING)
    elif kind == "card":
        check = YES if luhn(number) else NO
        gazetteer = YES if number[:1] in "3456" and len(number) in (14, 15, 16, 19) else NO
    else:
        check = YES if 9 <= len(number) <= 15 else NO
        gazetteer = YES if found[0] == "+" or number.startswith(("00", "0")) or "(" in found else NOTHING
    context = YES if CONTEXT[kind].intersection(words) else NO if AGAINST.intersection(words) else NOTHING
    alone = NO if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else YES
    return [pattern, check, gazetteer, context, alone]


def looks(found: str) -> list[float]:
    """What a span looks like: length, and the shares of digits, letters and separators."""
    n = max(1, len(found))
    return [min(n, 64) / 64, sum(c.isdigit() for c in found) / n, sum(c.isalpha() for c in found) / n, sum(not c.isalnum() for c in found) / n]


PROPOSED = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,looks:array<double>>>"


def proposals(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans, and all spans to vote on: those and the wider ones that don't overlap one of their kind."""
    base = base_spans(text)
    out = [(k, a, b, True) for k, a, b in base]
    possible = (any(p.search(text) for p in SPELLED_AT), COLONS.search(text), RUN_OF_DIGITS.search(text), RUN_OF_DIGITS.search(text))
    for k, kind in enumerate(KINDS):
        if not possible[k]:
            continue
        taken = [(a, b) for own, a, b in base if own == k]
        at = 0
        for m in WIDER[kind].finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                out.append((k, m.start(), m.end(), False))
    return base, [
        {"kind": k, "start": a, "end": b, "base": own, "votes": vote(KINDS[k], text, a, b, own), "looks": looks(text[a:b])}
        for k, a, b, own in out
    ]


def propose(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts and digest of the base spans, and ``proposed``. A null text is empty."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, proposed = [], [], []
            for text in batch.column("text").to_pylist():
                base, all_spans = proposals(text)
                counts.append([sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))])
                sums.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
                proposed.append(all_spans)
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                              ("votes", pa.list_(pa.int32())), ("looks", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(sums), pa.array(proposed, pa.list_(span))],
                names=["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "proposed"])

    counted = ", ".join(f"n_{kind} long" for kind in KINDS)
    return texts(docs).mapInArrow(apply, f"doc_id long, {counted}, base_sha256 string, proposed {PROPOSED}")


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns for each labeler how likely it says yes (given that it votes) where the span is personal data and where it
    isn't, and the probability of each pattern. It starts from labelers that are right four times in five; each count
    gets one for either answer, so that labelers which never vote stay harmless.
    """
    votes, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    rates, prior = np.repeat([[0.8, 0.2]], votes.shape[1], axis=0), 0.5
    chance = np.zeros(len(n))
    for _ in range(rounds):
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for k, (true, false) in enumerate(rates):
            odds += np.where(votes[:, k] == YES, np.log(true / false), np.where(votes[:, k] == NO, np.log((1 - true) / (1 - false)), 0))
        chance = 1 / (1 + np.exp(-odds))
        prior = min(0.99, max(0.01, (chance @ n + 1) / (n.sum() + 2)))
        for k in range(votes.shape[1]):
            for side, weight in enumerate((chance, 1 - chance)):
                yes, no = (weight * n)[votes[:, k] == YES].sum(), (weight * n)[votes[:, k] == NO].sum()
                rates[k, side] = (yes + (4, 1)[side]) / (yes + no + 5)
    return rates, {tuple(int(v) for v in p): float(c) for p, c in zip(votes, chance)}


def features(kind: int, votes: list[int], look: list[float]) -> list[float]:
    own = [float(kind == k) for k in range(len(KINDS))]
    return [*own, *(float(v == YES) for v in votes), *(float(v == NO) for v in votes), *look]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on probabilities, by gradient steps with a light penalty; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, scale = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ (scale * (p - y)) + 1e-4 * w)
    return w


def train(rows: DataFrame) -> np.ndarray | None:
    """The span classifier. Votes of all spans are counted by Spark; it is fitted on a bounded sample of spans."""
    spans = rows.select(F.explode("proposed").alias("s")).select("s.kind", "s.votes", "s.looks", "s.start", "s.end")
    counted = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 4 x 3^5 rows
    if not counted:
        return None
    chances = {}
    for kind in range(len(KINDS)):
        own = {tuple(r["votes"]): r["n"] for r in counted if r["kind"] == kind}
        if own:
            chances[kind] = reliabilities(own)[1]
    total = sum(r["n"] for r in counted)
    share = F.lit(min(1.0, SAMPLE / total) * (1 << 20))
    chosen = spans.where(F.pmod(F.xxhash64("start", "end", "looks"), F.lit(1 << 20)) < share).collect()
    x = [features(r["kind"], r["votes"], r["looks"]) for r in chosen]
    y = [chances[r["kind"]][tuple(r["votes"])] for r in chosen]
    weight = [1.0] * len(x)
    for r in counted:  # every vote pattern takes part, also a rare one that the sample misses
        x.append(features(r["kind"], r["votes"], [0.25, 0.5, 0.25, 0.25]))
        y.append(chances[r["kind"]][tuple(r["votes"])])
        weight.append(0.1)
    return fit(np.array(x), np.array(y), np.array(weight))


def decide(rows: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """``rows`` with ``spans`` in place of ``proposed``: base spans, and proposed ones the classifier is sure of."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = []
            for proposed in batch.column("proposed").to_pylist():
                kept = []
                for s in proposed:
                    chance = 1.0 if s["base"] else 1 / (1 + np.exp(-np.dot(weights, [*features(s["kind"], s["votes"], s["looks"]), 1.0])))
                    if chance >= SURE:
                        kept.append((s["kind"], s["start"], s["end"]))
                joined.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(kept)))
            rest = [name for name in batch.schema.names if name != "proposed"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(joined, pa.string())], names=[*rest, "spans"])

    schema = rows.drop("proposed").schema.add("spans", "string")
    return rows.mapInArrow(apply, schema)


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(propose(read(spark, sf_dir, "documents")), "proposals")
    return decide(rows, train(rows))
