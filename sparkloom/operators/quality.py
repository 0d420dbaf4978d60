"""Contract checks of JSON payload rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matches(raw: Column, kind: str) -> Column:
    """Whether the JSON text of one field has the declared type; integers and numbers are compatible."""
    text = F.trim(raw)
    shapes = {
        "string": text.startswith('"'),
        "integer": text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"),
        "number": text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"),
        "boolean": text.isin("true", "false"),
        "array": text.startswith("["),
        "object": text.startswith("{"),
        "any": F.lit(True),
    }
    return shapes[kind]


def validate_payloads(df: DataFrame, json: str, contract: dict[str, str]) -> DataFrame:
    """Per field: rows that have it, lack it, or hold a value of another type.

    ``from_json`` into variants keeps numbers and strings apart; everything is one map-side
    aggregation, one row out per field.
    """
    parsed = df.select(F.try_parse_json(json).alias("v"))
    aggs = []
    for i, (field, kind) in enumerate(contract.items()):
        raw = F.to_json(F.try_variant_get("v", f"$.{field}", "variant"))
        aggs += [F.count_if(raw.isNotNull() & _matches(raw, kind)).alias(f"ok{i}"),
                 F.count_if(raw.isNull()).alias(f"missing{i}"),
                 F.count_if(raw.isNotNull() & ~_matches(raw, kind)).alias(f"bad{i}")]
    wide = parsed.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), F.col(f"ok{i}").alias("n_ok"),
                              F.col(f"missing{i}").alias("n_missing"), F.col(f"bad{i}").alias("n_mismatched"))
                     for i, (f, t) in enumerate(contract.items())])
    return wide.select(F.inline(rows))
