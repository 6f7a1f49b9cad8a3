"""Column expressions over cohort labels such as ``Winter 2012`` and over dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.text import strip

# Season, code letter and approximate first month.
SEASONS = {"Winter": ("W", 1), "Spring": ("X", 4), "Summer": ("S", 6), "Fall": ("F", 9)}
# Fixed value: a cohort younger than this many days is still in progress.
IN_PROGRESS_DAYS = 120

# White space between the words in any script, as in ``clean_text``.
_LABEL = r"^(" + "|".join(SEASONS) + r")(?U:\s)+(\d{4})$"


def parse_cohort(label: Column) -> Column:
    """Struct of season, year, code, start and order; all fields null for other labels."""
    text = strip(label)
    season = F.when(text.rlike(_LABEL), F.regexp_extract(text, _LABEL, 1))
    year_text = F.regexp_extract(text, _LABEL, 2)
    year = F.when(season.isNotNull(), year_text).cast("int")
    letter = F.create_map(*[F.lit(v) for name, (code, _) in SEASONS.items() for v in (name, code)])
    month_of = F.create_map(*[F.lit(v) for name, (_, month) in SEASONS.items() for v in (name, month)])
    month = F.try_element_at(month_of, season)
    return F.struct(
        season.alias("season"),
        year.alias("year"),
        F.concat(F.try_element_at(letter, season), F.substring(year_text, 3, 2)).alias("code"),
        F.make_date(year, month, F.lit(1)).alias("start"),
        (year * 100 + month).alias("order"),
    )


def cohort_state(start: Column, as_of: dt.date) -> Column:
    """unknown, future, in_progress or complete on the reference date."""
    today = F.lit(as_of)
    return (
        F.when(start.isNull(), "unknown")
        .when(start > today, "future")
        .when(F.datediff(today, start) < IN_PROGRESS_DAYS, "in_progress")
        .otherwise("complete")
    )


def cohort_age(year: Column, as_of: dt.date) -> Column:
    return F.lit(as_of.year) - year


def epoch_in_bounds(seconds: Column, earliest: dt.date, as_of: dt.date) -> Column:
    """Condition: the instant lies from ``earliest`` to one day past ``as_of``, both included."""
    first = int(dt.datetime.combine(earliest, dt.time(), dt.UTC).timestamp())
    last = int(dt.datetime.combine(as_of, dt.time(), dt.UTC).timestamp()) + 86400
    return seconds.between(first, last)


def epoch_to_timestamp(seconds: Column) -> Column:
    """Epoch seconds as a UTC time without zone, whatever the session's time zone."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
