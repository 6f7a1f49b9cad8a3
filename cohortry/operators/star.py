"""The feature table split into six keyed tables.

Input: the feature table with one row per ``company_id`` (its primary key,
checked by the audit).  Lists hold no repeats after cleaning, and the bridges
drop repeats inside the row, so bridges need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.places import first_physical, parse_place
from cohortry.operators.audit import TableRules
from cohortry.operators.ordering import dense_number

# Write order: parents before children.
TABLES = ("batches", "industries", "locations", "companies", "company_locations", "company_tags")

COMPANY_COLUMNS = (
    "company_id", "slug", "name", "website", "profile_url", "one_liner", "long_description", "batch_id",
    "industry_id", "status", "is_operating", "stage", "team_size", "team_size_outlier", "is_hiring",
    "is_nonprofit", "is_top_company", "ai_tag", "ai_keyword", "is_ai", "is_remote", "launched_at",
    "primary_location_id",
)

FLAGS = (
    "is_operating", "team_size_outlier", "is_hiring", "is_nonprofit", "is_top_company", "ai_tag", "ai_keyword",
    "is_ai", "is_remote",
)

RULES = {
    "batches": TableRules(("batch_id",), unique=[("batch",)], not_null=["batch"]),
    "industries": TableRules(("industry_id",), unique=[("industry", "subindustry")], not_null=["industry"]),
    "locations": TableRules(("location_id",), unique=[("place_raw",)], not_null=["place_raw", "is_remote"]),
    "companies": TableRules(
        ("company_id",), unique=[("slug",)], not_null=["slug", "name", "status", *FLAGS],
        foreign_keys={
            "batch_id": ("batches", "batch_id"),
            "industry_id": ("industries", "industry_id"),
            "primary_location_id": ("locations", "location_id"),
        },
    ),
    "company_locations": TableRules(
        ("company_id", "location_id"), not_null=["is_primary"],
        foreign_keys={"company_id": ("companies", "company_id"), "location_id": ("locations", "location_id")},
    ),
    "company_tags": TableRules(("company_id", "tag"), foreign_keys={"company_id": ("companies", "company_id")}),
}


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def _distinct_entries() -> Column:
    return F.array_distinct("location_entries")


def _first_physical() -> Column:
    return first_physical(F.col("location_entries"))


def batches(features: DataFrame) -> DataFrame:
    """One row per cohort label, with the derived fields of its first entity, numbered by order and label, unparsed labels last."""
    derived = F.struct(
        F.col("batch_season").alias("season"), F.col("batch_year").alias("year"), F.col("batch_code").alias("code"), "batch_order",
        iso_date(F.col("batch_start")).alias("approx_start_date"), "batch_status",
    )
    rows = features.groupBy("batch").agg(F.min_by(derived, "company_id").alias("_d")).select("batch", "_d.*")
    key = F.struct(F.isnull("batch_order"), "batch_order", F.isnull("batch"), "batch")
    return dense_number(rows, key, "batch_id")


def industries(features: DataFrame) -> DataFrame:
    """One row per pair, numbered in order with nulls first."""
    rows = features.select("industry", "subindustry").distinct()
    return dense_number(rows, F.struct("industry", "subindustry"), "industry_id")


def locations(features: DataFrame) -> DataFrame:
    """One row per place text, numbered as first seen; parsed after the grouping."""
    seen = features.select("company_id", F.posexplode(_distinct_entries()).alias("pos", "place_raw"))
    first = seen.groupBy("place_raw").agg(F.min(F.struct("company_id", "pos")).alias("_first"))
    numbered = dense_number(first, F.col("_first"), "location_id")
    return numbered.withColumn("_p", parse_place(F.col("place_raw"))).select(
        "location_id", "place_raw", "_p.city", "_p.region", "_p.country", "_p.is_remote"
    )


def companies(features: DataFrame, batch_dim: DataFrame, industry_dim: DataFrame, location_dim: DataFrame) -> DataFrame:
    """Facts with the three keys; flags as 0/1, dates as text.  Null labels match null labels.

    No join is hinted: Spark broadcasts a dimension it measures as small and
    otherwise splits a hot label's rows (AQE skew join).
    """
    fact = features.withColumn("_place", _first_physical())
    b = batch_dim.select("batch_id", F.col("batch").alias("_batch"))
    i = industry_dim.select(
        "industry_id", F.col("industry").alias("_industry"), F.col("subindustry").alias("_subindustry")
    )
    p = location_dim.select(F.col("location_id").alias("primary_location_id"), F.col("place_raw").alias("_raw"))
    joined = (
        fact.join(b, F.col("batch").eqNullSafe(F.col("_batch")), "left")
        .join(i, F.col("industry").eqNullSafe(F.col("_industry"))
              & F.col("subindustry").eqNullSafe(F.col("_subindustry")), "left")
        .join(p, F.col("_place") == F.col("_raw"), "left")
    )
    shaped = {c: F.col(c).cast("int") for c in FLAGS} | {"launched_at": iso_date(F.col("launched_at"))}
    return joined.select(*[shaped.get(c, F.col(c)).alias(c) for c in COMPANY_COLUMNS])


def company_locations(features: DataFrame, location_dim: DataFrame) -> DataFrame:
    """Entity-place pairs; ``is_primary`` marks the first place that is not remote."""
    pairs = features.select(
        "company_id", _first_physical().alias("_first"), F.explode(_distinct_entries()).alias("_place")
    )
    keys = location_dim.select("location_id", "place_raw")
    primary = F.coalesce(F.col("_place") == F.col("_first"), F.lit(False)).cast("int")
    return pairs.join(keys, F.col("_place") == F.col("place_raw")).select(
        "company_id", "location_id", primary.alias("is_primary")
    )


def company_tags(features: DataFrame) -> DataFrame:
    return features.select("company_id", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag is not null")


def build_tables(features: DataFrame) -> dict[str, DataFrame]:
    """All six tables, lazily."""
    b, i, p = batches(features), industries(features), locations(features)
    return {
        "batches": b, "industries": i, "locations": p,
        "companies": companies(features, b, i, p),
        "company_locations": company_locations(features, p),
        "company_tags": company_tags(features),
    }
