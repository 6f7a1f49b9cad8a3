"""Count series per period: one long table (series, t, y) for all series at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the first year with a full set of cohorts.
FIRST_FULL_YEAR = 2006
ALL = "All companies"
# Series of flagged rows: name and column.
FLAG_SERIES = {"AI companies (broad)": "is_ai", "AI companies (tags only)": "ai_tag"}


def membership(flags: Mapping[str, str] = FLAG_SERIES, groups: tuple[Column, ...] = ()) -> Column:
    """The names of the series a row belongs to: all, one per true flag, one per non-null group."""
    named = [F.when(F.col(column), F.lit(name)) for name, column in flags.items()]
    return F.array_compact(F.array(F.lit(ALL), *named, *groups))


def full_periods(df: DataFrame, period: str = "batch_year", state: str = "batch_status", first: int = FIRST_FULL_YEAR) -> DataFrame:
    """Periods from ``first`` on in which every row's cohort is complete; judged on the whole table."""
    per_period = df.filter(F.col(period).isNotNull()).groupBy(F.col(period).alias("t")).agg(
        F.bool_and(F.coalesce(F.col(state) == "complete", F.lit(False))).alias("_full")
    )
    return per_period.filter(F.col("_full") & (F.col("t") >= first)).select("t")


def _counts(df: DataFrame, period: str, members: Column) -> DataFrame:
    # Rows are counted per (period, members) before the list is unfolded, so
    # the series that holds every row costs no more than any other.
    folded = df.filter(F.col(period).isNotNull()).groupBy(F.col(period).alias("t"), members.alias("_m")).agg(
        F.count("*").alias("_n")
    )
    return folded.select(F.explode("_m").alias("series"), "t", "_n").groupBy("series", "t").agg(
        F.sum("_n").alias("_n")
    )


def count_series(
    df: DataFrame, members: Column, period: str = "batch_year", state: str = "batch_status", first: int = FIRST_FULL_YEAR
) -> DataFrame:
    """Rows (series, t, y): counts on full periods, zero where a series has none.

    The list of periods is one value: calendar periods, so small by nature.
    """
    counts = _counts(df, period, members)
    periods = full_periods(df, period, state, first).agg(F.sort_array(F.collect_list("t"))).scalar()
    spine = counts.select("series").distinct().withColumn("_ts", periods).select(
        F.col("series").alias("_series"), F.explode("_ts").alias("_t")
    )
    same = (F.col("_series") == F.col("series")) & (F.col("_t") == F.col("t"))
    return spine.join(counts, same, "left").select(
        F.col("_series").alias("series"), F.col("_t").alias("t"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("double").alias("y"),
    )


def partial_period(df: DataFrame, members: Column, period: str = "batch_year", state: str = "batch_status") -> DataFrame:
    """Rows (series, t, n): the earliest period with an in-progress cohort and the count so far."""
    open_period = df.filter((F.col(state) == "in_progress") & F.col(period).isNotNull()).agg(F.min(period)).scalar()
    counts = _counts(df, period, members).withColumn("_open", open_period)
    so_far = F.coalesce(F.sum(F.when(F.col("t") == F.col("_open"), F.col("_n"))), F.lit(0))
    return counts.filter("_open is not null").groupBy("series").agg(
        F.max("_open").alias("t"), so_far.alias("n")
    )
