"""Constraint audit: Spark enforces no keys, so violations are counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableRules:
    """Declared constraints of one table; foreign keys map a column to (table, column)."""

    primary_key: Sequence[str]
    unique: Sequence[Sequence[str]] = ()
    not_null: Sequence[str] = ()
    foreign_keys: Mapping[str, tuple[str, str]] | None = None


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of keys that occur more than once; keys with nulls are left out, as in SQL."""
    known = df.select(*columns).na.drop()
    repeated = known.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    return repeated.agg(F.count("*").alias("violations"))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent.

    References are counted per value first, so a hot reference joins once.
    """
    used = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return used.join(keys, F.col(column) == F.col("_parent"), "left_anti")


def audit(tables: Mapping[str, DataFrame], rules: Mapping[str, TableRules]) -> DataFrame:
    """Rows table, rule, columns, violations for every declared constraint."""
    report = []

    def line(table: str, rule: str, columns: Sequence[str], found: DataFrame) -> None:
        report.append(found.select(
            F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(",".join(columns)).alias("columns"),
            F.coalesce(F.col("violations"), F.lit(0)).cast("long").alias("violations"),
        ))

    for name, rule in rules.items():
        df = tables[name]
        line(name, "primary key", rule.primary_key, duplicate_keys(df, rule.primary_key))
        for columns in rule.unique:
            line(name, "unique", columns, duplicate_keys(df, columns))
        required = list(dict.fromkeys([*rule.primary_key, *rule.not_null]))
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        pairs = F.array(*[F.struct(F.lit(c).alias("columns"), F.col(c).alias("violations")) for c in required])
        report.append(nulls.select(F.inline(pairs)).select(
            F.lit(name).alias("table"), F.lit("not null").alias("rule"), "columns", "violations"
        ))
        for column, (parent, key) in (rule.foreign_keys or {}).items():
            found = orphans(df, column, tables[parent], key).agg(F.sum("_n").alias("violations"))
            line(name, "foreign key", [column], found)
    out = report[0]
    for part in report[1:]:
        out = out.unionByName(part)
    return out


def primary_counts(bridge: DataFrame, entity: str = "company_id", flag: str = "is_primary") -> DataFrame:
    """How many entities have 0, 1, ... primary rows."""
    per_entity = bridge.groupBy(entity).agg(F.sum(flag).cast("long").alias("primaries"))
    return per_entity.groupBy("primaries").agg(F.count("*").alias("entities"))
