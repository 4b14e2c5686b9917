"""Decoding of the two JSON feeds with lenient number coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: wire field -> column, the id first
TAXI_FIELDS = {"taxiId": "taxi_id", "lon": "lon", "lat": "lat"}
CLIENT_FIELDS = {"clientId": "client_id", "origLon": "lon", "origLat": "lat"}


def decode_taxis(messages: DataFrame, **options) -> DataFrame:
    """Taxi messages to ``taxi_id, lon, lat`` (and ``seq``). See ``decode``."""
    return decode(messages, TAXI_FIELDS, **options)


def decode_clients(messages: DataFrame, **options) -> DataFrame:
    """Client messages to ``client_id, lon, lat`` (and ``seq``). See ``decode``."""
    return decode(messages, CLIENT_FIELDS, **options)


def decode(
    messages: DataFrame,
    fields: dict[str, str],
    *,
    value_col: str = "value",
    seq_field: str | None = "seq",
    keep: tuple[str, ...] = (),
    coerce: str = "zero",
) -> DataFrame:
    """Pick the fields out of JSON text; messages that are not JSON or lack a field are dropped.

    A present value that is no number counts as 0 with ``coerce="zero"`` and drops the message with
    ``coerce="reject"``. ``seq_field`` names the payload field that orders the messages of one id; pass ``None`` when
    the source has an order column of its own and name that in ``keep``.
    """
    parsed, ok = _parse(messages, fields, value_col, seq_field, coerce)
    out = [_number(name, i == 0).alias(column) for i, (name, column) in enumerate(fields.items())]
    if seq_field:
        out.append(F.try_variant_get("_json", f"$.{seq_field}", "bigint").alias("seq"))
    return parsed.where(ok).select(*out, *keep)


def rejects(messages: DataFrame, fields: dict[str, str], *, value_col: str = "value", seq_field: str | None = "seq",
            coerce: str = "zero") -> DataFrame:
    """The messages ``decode`` drops, unchanged."""
    parsed, ok = _parse(messages, fields, value_col, seq_field, coerce)
    return parsed.where(~ok).drop("_json")


def _parse(messages, fields, value_col, seq_field, coerce) -> tuple[DataFrame, Column]:
    if coerce not in ("zero", "reject"):
        raise ValueError(f"coerce must be 'zero' or 'reject', not {coerce!r}")
    if messages.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys") != "true":
        raise ValueError("decoding needs spark.sql.variant.allowDuplicateKeys, see session.tune: "
                         "without it a message with a repeated field is void")
    # a generator keeps the filter from being merged with the parsing, which would then run once per condition
    parsed = messages.withColumn("_json", F.explode(F.array(F.try_parse_json(value_col))))
    ok = F.lit(True)
    for name in fields:
        ok = ok & F.variant_get("_json", f"$.{name}", "variant").isNotNull()
        if coerce == "reject":
            number = F.try_variant_get("_json", f"$.{name}", "double")
            kind = F.schema_of_variant(F.variant_get("_json", f"$.{name}", "variant"))
            ok = ok & F.coalesce(F.abs(number) < F.lit(float("inf")), F.lit(False)) & (kind != "BOOLEAN")
    if seq_field:
        # without its order a message cannot take part in "latest wins"
        ok = ok & F.try_variant_get("_json", f"$.{seq_field}", "bigint").isNotNull()
    return parsed, F.coalesce(ok, F.lit(False))


def _number(name: str, integral: bool) -> Column:
    as_double = F.try_variant_get("_json", f"$.{name}", "double")
    if not integral:
        return F.coalesce(as_double, F.lit(0.0))
    as_long = F.try_variant_get("_json", f"$.{name}", "bigint")
    return F.coalesce(as_long, as_double.try_cast("bigint"), F.lit(0).cast("bigint"))


def encode(
    df: DataFrame, fields: dict[str, str], *, seq_col: str | None = "seq", value_col: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """The reverse of ``decode``: one JSON message per row, next to the columns in ``keep``."""
    members = [F.col(column).alias(name) for name, column in fields.items()]
    if seq_col:
        members.append(F.col(seq_col).alias("seq"))
    return df.select(F.to_json(F.struct(*members)).alias(value_col), *keep)
