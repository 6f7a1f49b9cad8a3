"""Raw records to the cleaned table, and the log of what cleaning did."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions import cohorts, places, text
from cohortry.functions.stats import finite
from cohortry.operators.ordering import exact_quantiles
from cohortry.schemas import CLEAN_COLUMNS, KNOWN_STATUSES, OPERATING_STATUSES, UNKNOWN, UNSPECIFIED

# Earliest launch date that is believed; width of the size fence.
EARLIEST_LAUNCH = dt.date(2005, 1, 1)
FENCE_WIDTH = 3.0


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the last row per key in the given order; null is a key of its own.

    The filter on the row number lets Spark drop all but one row per key in
    every map task before the shuffle, so a hot key does not travel.
    """
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def known_status(raw: Column) -> Column:
    """Title-cased status, or ``Unknown`` outside the known ones."""
    status = text.title_case(text.clean_text(raw))
    return F.when(status.isin(*KNOWN_STATUSES), status).otherwise(UNKNOWN)


def is_operating(status: Column) -> Column:
    return status.isin(*OPERATING_STATUSES)


def number(raw: Column) -> Column:
    """Double, or null for text that is no finite number."""
    return finite(raw.try_cast("double"))


def positive(size: Column) -> Column:
    return F.when(size > 0, size)


def upper_fence(df: DataFrame, size: Column, width: float = FENCE_WIDTH) -> DataFrame:
    """One row ``fence``: upper quartile plus ``width`` quartile ranges on the log1p scale."""
    quartiles = exact_quantiles(df, F.log1p(size), {"q1": 0.25, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * F.lit(width)
    return quartiles.select(F.expm1(F.col("q3") + spread).alias("fence"))


def annotate(
    raw: DataFrame, as_of: dt.date, order: list[str], earliest: dt.date = EARLIEST_LAUNCH, exact: bool = True
) -> DataFrame:
    """Cleaned rows plus ``_notes``, a struct of one condition per cleaning step."""
    kept = keep_last(raw, "id", order)
    size_in = number(F.col("team_size"))
    size = positive(size_in)
    if exact:
        fence = upper_fence(kept, size).scalar()
    else:
        quartiles = kept.agg(F.percentile_approx(F.log1p(size), [0.25, 0.75]).alias("q"))
        fence = quartiles.select(F.expm1(F.expr(f"q[1] + (q[1] - q[0]) * {FENCE_WIDTH}D"))).scalar()
    staged = (
        kept.withColumn("_cohort", cohorts.parse_cohort(F.col("batch").cast("string")))
        .withColumn("_entries", text.split_list(F.col("all_locations")))
        .withColumn("_places", places.parse_places(F.col("_entries")))
        .withColumn("_primary", places.primary_place(F.col("_places")))
        .withColumn("_regions", text.clean_list(F.col("regions")))
        .withColumn("_status_in", text.title_case(text.clean_text(F.col("status"))))
        .withColumn("_industry", text.clean_text(F.col("industry")))
        .withColumn("_size", size)
        .withColumn("_fence", fence)
        .withColumn("_outlier", F.coalesce(F.col("_size") > F.col("_fence"), F.lit(False)))
    )
    in_bounds = cohorts.epoch_in_bounds(F.col("launched_at"), earliest, as_of)
    status = known_status(F.col("status"))
    columns = {
        "company_id": F.col("id").cast("long"),
        "slug": text.clean_text(F.col("slug")),
        "name": text.clean_text(F.col("name")),
        "website": F.lower(text.clean_text(F.col("website"))),
        "one_liner": text.clean_text(F.col("one_liner")),
        "long_description": text.clean_text(F.col("long_description")),
        "profile_url": text.clean_text(F.col("url")),
        "stage": text.clean_text(F.col("stage")),
        "status": status,
        "is_operating": is_operating(status),
        "industry": F.col("_industry"),
        "subindustry": text.after_last(text.clean_text(F.col("subindustry"))),
        "batch": text.clean_text(F.col("batch")),
        "batch_season": F.col("_cohort.season"),
        "batch_year": F.col("_cohort.year"),
        "batch_code": F.col("_cohort.code"),
        "batch_start": F.col("_cohort.start"),
        "batch_order": F.col("_cohort.order"),
        "team_size": F.bround("_size", 0).cast("int"),
        "team_size_outlier": F.col("_outlier"),
        "launched_at": F.when(in_bounds, cohorts.epoch_to_timestamp(F.col("launched_at"))),
        "is_hiring": F.coalesce(F.col("isHiring"), F.lit(False)),
        "is_nonprofit": F.coalesce(F.col("nonprofit"), F.lit(False)),
        "is_top_company": F.coalesce(F.col("top_company"), F.lit(False)),
        "tags": text.clean_list(F.col("tags")),
        "regions": F.col("_regions"),
        "all_locations": text.clean_text(F.col("all_locations")),
        "location_entries": F.col("_entries"),
        "primary_city": F.col("_primary.city"),
        "primary_region": F.col("_primary.region"),
        "primary_country": F.col("_primary.country"),
        "location_count": F.size("_entries"),
        "is_remote": F.exists("_places", lambda p: p["is_remote"])
        | F.array_contains("_regions", places.REMOTE),
    }
    notes = {
        "unknown_status": ~F.coalesce(F.col("_status_in").isin(*KNOWN_STATUSES), F.lit(False)),
        "industry_unspecified": F.col("_industry") == UNSPECIFIED,
        "unparsed_batch": F.col("_cohort.season").isNull(),
        "team_size_invalid": size_in <= 0,
        "team_size_outlier": F.col("_outlier"),
        "team_size_missing": F.col("_size").isNull(),
        "launched_at_out_of_range": ~in_bounds,
        "no_physical_location": F.col("_primary.country").isNull(),
    }
    return staged.select(
        *[columns[name].alias(name) for name in CLEAN_COLUMNS],
        F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in notes.items()]).alias("_notes"),
        F.col("_fence"),
    )


def clean(raw: DataFrame, as_of: dt.date, order: list[str], **options) -> DataFrame:
    """The cleaned table, one row per id, in no particular order."""
    return annotate(raw, as_of, order, **options).select(*CLEAN_COLUMNS)


# Steps of the log, in order, with what was decided.
DECISIONS = {
    "duplicate_ids": "An id given more than once: only its latest record went on.",
    "unknown_status": "A status that is not one of the known ones became 'Unknown'.",
    "industry_unspecified": "No industry was named; the row counts in totals but in no rate of an industry.",
    "unparsed_batch": "No season and year could be read from the label; such rows have no cohort year.",
    "team_size_invalid": "A team needs one person; other sizes were emptied.",
    "team_size_outlier": "Beyond the fence ({fence}) a size only gets a mark.",
    "team_size_missing": "No size was given and none was guessed.",
    "launched_at_out_of_range": "A launch before the first or after the last possible day was emptied.",
    "no_physical_location": "Nothing but remote work was listed, so city and country are empty.",
    "shared_names": "Another id carries the same name; both rows are there.",
}


def count_shared(df: DataFrame, key: Column, alias: str) -> DataFrame:
    """One row: how many rows share their key with another row; null equals null."""
    per_key = df.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(alias))


def cleaning_log(raw: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row per step: position, step, rows_affected, decision."""
    steps = [s for s in DECISIONS if s not in ("duplicate_ids", "shared_names")]
    raw_rows = raw.agg(F.count("*")).scalar()
    shared = count_shared(annotated, F.lower("name"), "n").scalar()
    counts = annotated.agg(
        F.count("*").alias("rows"),
        F.max("_fence").alias("_fence"),
        *[F.count_if(F.col(f"_notes.{s}")).alias(s) for s in steps],
    )
    counts = counts.withColumn("duplicate_ids", raw_rows - F.col("rows")).withColumn("shared_names", shared)
    fence = F.coalesce(F.format_string("%.0f", F.col("_fence")), F.lit("n/a"))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(step).alias("step"),
            F.col(step).cast("long").alias("rows_affected"),
            F.replace(F.lit(note), F.lit("{fence}"), fence).alias("decision"),
        )
        for i, (step, note) in enumerate(DECISIONS.items(), 1)
    ]
    return counts.select(F.inline(F.array(*rows)))
