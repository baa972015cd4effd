"""Column names, types and the schema check of the hourly frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TIMESTAMP = "timestamp"
SOURCES = ("BIOMASS", "NUCLEAR", "SOLAR", "WIND_ONSHORE")
CONSUMPTION = "consommation_totale"
TEMPERATURE = "temp"
FEATURES = (*SOURCES, CONSUMPTION, TEMPERATURE)
HOURLY = T.StructType([T.StructField(TIMESTAMP, T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
GENERATION_JSON = "actual_generations_per_production_type array<struct<production_type: string, values: array<struct<start_date: string, value: double>>>>"
CONSUMPTION_JSON = "short_term array<struct<values: array<struct<start_date: string, value: double>>>>"


class SchemaError(ValueError):
    """A frame lacks columns, or has them with other types or in another order."""


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that ``df`` has, in the order of ``df``."""
    return [c for c in df.columns if c in set(wanted)]


def select_features(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """``columns`` in that order; an error names those that are missing."""
    if lacking := missing_columns(df, columns):
        raise SchemaError(f"missing columns: {', '.join(lacking)}")
    return df.select(*columns)


def validate(df: DataFrame, schema: T.StructType = HOURLY) -> DataFrame:
    """``df`` if it has the schema's columns, types and order; else SchemaError tells all differences."""
    got, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in schema]
    if got != want:
        lacking, extra = [c for c in want if c not in got], [c for c in got if c not in want]
        raise SchemaError(f"expected {want}, got {got}; missing {lacking}, unexpected {extra}" if lacking or extra else f"columns come in another order: {got}")
    return df
