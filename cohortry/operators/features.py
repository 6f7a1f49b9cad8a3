"""Derived columns on top of the cleaned table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import cohorts, flags, text


def build_features(clean: DataFrame, as_of: dt.date) -> DataFrame:
    """The cleaned table plus flags, cohort state and age, and size measures."""
    tagged = flags.any_tag_matches(F.col("tags"))
    worded = flags.text_matches(F.col("one_liner"), F.col("long_description"))
    return clean.withColumns({"ai_tag": tagged, "ai_keyword": worded}).withColumns({
        "is_ai": F.col("ai_tag") | F.col("ai_keyword"),
        "batch_status": cohorts.cohort_state(F.col("batch_start"), as_of),
        "years_since_batch": cohorts.cohort_age(F.col("batch_year"), as_of),
        "tag_count": F.size("tags"),
        "team_size_bucket": flags.size_class(F.col("team_size")),
        "description_length": text.text_length(F.col("long_description")),
    })


def latest_date(df: DataFrame, column: str) -> dt.date:
    """Reference date of a table: the date of its latest instant (runs a job of one row)."""
    return df.agg(F.max(F.to_date(column))).first()[0]
