"""Backtests of the generic series and of every frequent group, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import forecasting as fc
from cohortry.operators.metrics import frequent_groups
from cohortry.operators.series import count_series, membership
from cohortry.session import stage
from cohortry.sources.files import write_csv
from cohortry.sources.runlog import append_runs, run_records

METRICS = ("mae", "rmse", "mape_pct", "n_eval", "fit_failures", "rmse_vs_naive")


def annual_series(features: DataFrame, min_group: int = 100) -> DataFrame:
    """Yearly counts of all rows, of both flags and of every frequent industry."""
    groups = frequent_groups(features, "industry", min_group).select(F.col("industry").alias("_group"))
    marked = features.join(groups, F.col("industry") == F.col("_group"), "left")
    return count_series(marked, membership(groups=(F.col("_group"),)))


def run(features: DataFrame, csv_path: str, log_path: str, version: str = "unknown") -> DataFrame:
    """Compare all models on all series; write the table as CSV and one log record per row (runs jobs)."""
    series = stage(annual_series(features), "series")
    table = stage(fc.compare_models(series), "comparison")
    write_csv(table, csv_path)
    records = run_records(
        table, "forecast", METRICS, {"horizon": 1, "min_train": fc.MIN_TRAIN, "validation": "rolling-origin"},
        param_columns=["series"], notes="annual counts, complete years only", version=version,
    )
    append_runs(records, log_path)
    return table
