"""Profile of the cleaned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.validation import duplicate_count

# Columns whose distinct values are counted.
COUNTED = ("batch", "industry", "subindustry", "status", "stage", "primary_country", "primary_city")


def _long(row: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias(key), F.col(f"`{n}`").alias(value)) for n in names]
    return row.select(F.inline(F.array(*pairs)))


def missing_percent(df: DataFrame, digits: int = 2) -> DataFrame:
    """Rows field, missing_pct: nulls of scalar columns, empty lists of list columns; one pass."""

    def missing(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            return column.isNull() | (F.size(column) == 0)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return column.isNull() | F.isnan(column)
        return column.isNull()

    row = df.agg(*[
        F.round(F.avg(missing(f).cast("double")) * 100, digits).alias(f.name) for f in df.schema.fields
    ])
    return _long(row, df.columns, "field", "missing_pct")


def most_missing(df: DataFrame, n: int = 12) -> DataFrame:
    return missing_percent(df).orderBy(F.desc("missing_pct"), "field").limit(n)


def duplicate_counts(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows key, extra_rows: rows beyond the first per key."""
    row = df.agg(*[duplicate_count(key).cast("long").alias(name) for name, key in keys.items()])
    return _long(row, list(keys), "key", "extra_rows")


def distinct_counts(df: DataFrame, columns: Sequence[str] = COUNTED, approximate: bool = False) -> DataFrame:
    """Rows field, distinct_values; exact unless asked otherwise."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    return _long(row, list(columns), "field", "distinct_values")


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows field, low, high (as text)."""
    row = df.agg(*[
        F.struct(F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(c)
        for c in columns
    ])
    return _long(row, list(columns), "field", "range").select("field", "range.low", "range.high")


def table_facts(raw: DataFrame, df: DataFrame) -> DataFrame:
    """One row: raw_rows, clean_rows, columns, scalar_columns."""
    scalars = sum(not isinstance(f.dataType, T.ArrayType) for f in df.schema.fields)
    return df.agg(F.count("*").alias("clean_rows")).select(
        raw.agg(F.count("*")).scalar().alias("raw_rows"),
        "clean_rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(scalars).alias("scalar_columns"),
    )


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def quality_report(raw: DataFrame, df: DataFrame, log: DataFrame) -> DataFrame:
    """The whole profile in one long table: section, item, value (text)."""

    def section(name: str, part: DataFrame, item: str, value: str) -> DataFrame:
        return part.select(
            F.lit(name).alias("section"), F.col(item).alias("item"), F.col(value).cast("string").alias("value")
        )

    facts = table_facts(raw, df)
    keys = {
        "company_id": F.col("company_id"), "slug": F.col("slug"),
        "name_case_insensitive": F.lower("name"),
    }
    ranges = value_ranges(df, ["batch_year", "launched_at"])
    parts = [
        section("table", _long(facts.select(*[F.col(c).cast("long") for c in facts.columns]),
                               facts.columns, "item", "value"), "item", "value"),
        section("missing_pct", missing_percent(df), "field", "missing_pct"),
        section("duplicates", duplicate_counts(df, keys), "key", "extra_rows"),
        section("unique_counts", distinct_counts(df), "field", "distinct_values"),
        section("invalid_values", log, "step", "rows_affected"),
        section("range_low", ranges, "field", "low"),
        section("range_high", ranges, "field", "high"),
    ]
    types = df.sparkSession.createDataFrame(column_types(df), "item string, value string")
    report = types.select(F.lit("dtypes").alias("section"), "item", "value")
    for part in parts:
        report = report.unionByName(part)
    return report
