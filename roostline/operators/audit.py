"""Checks on stored tables: contract and privacy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline import config


def schema_differences(df: DataFrame, expected: T.StructType) -> list[str]:
    """Columns that are missing, extra or of another type, as short statements.

    Parquet readers report every column as nullable, so nullability is judged by the
    rows, in :func:`contract_violations`.
    """
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    out = [f"{name}: missing" for name in want if name not in have]
    out += [f"{name}: unexpected" for name in have if name not in want]
    out += [
        f"{name}: {have[name]} instead of {want[name]}"
        for name in want
        if name in have and have[name] != want[name]
    ]
    return sorted(out)


def listing_rules(schema: T.StructType) -> Mapping[str, Column]:
    """Rule name to the condition that breaks it: value checks and required columns."""
    c = F.col
    checks = {
        "latitude_in_range": ~c("latitude").between(-90, 90),
        "longitude_in_range": ~c("longitude").between(-180, 180),
        "price_not_negative": c("price_gbp") < 0,
        "accommodates_positive": c("accommodates") <= 0,
        "minimum_nights_at_least_one": c("minimum_nights") < 1,
        "review_count_not_negative": c("number_of_reviews") < 0,
        "amenities_are_names": F.exists("amenities", lambda a: a.isNull()),
    }
    required = {f"{f.name}_present": c(f.name).isNull() for f in schema.fields if not f.nullable}
    return checks | required


def contract_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``(rule, rows)`` for every rule, counted in one pass over the table."""
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    pairs = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(name).alias("rows")) for name in rules]
    )
    return counted.select(F.inline(pairs))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def personal_columns(tables: Mapping[str, DataFrame]) -> list[str]:
    """``table.column`` for every stored column that identifies a person."""
    dropped = set(config.PERSONAL_COLUMNS)
    return sorted(
        f"{table}.{column}"
        for table, df in tables.items()
        for column in df.columns
        if column.lower() in dropped or column.lower().startswith("reviewer")
    )


def personal_values(df: DataFrame, columns: Sequence[str], probes: Sequence[str]) -> DataFrame:
    """``(column, probe, rows)``: how often a known personal value occurs in stored text.

    The probes are a short list the caller names, so one pass over the table checks all.
    """
    tests = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(probe).alias("probe"),
            F.contains(F.coalesce(F.col(column), F.lit("")), F.lit(probe)).alias("found"),
        )
        for column in columns
        for probe in probes
    ]
    return (
        df.select(F.inline(F.array(*tests)))
        .where("found")
        .groupBy("column", "probe")
        .agg(F.count("*").alias("rows"))
    )
