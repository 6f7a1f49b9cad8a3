"""Row selection by a value object that becomes one predicate."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longer lists of allowed values are joined, not listed in the condition.
LONGEST_LIST = 500
_LISTS = {"industries": "industry", "statuses": "status", "countries": "primary_country"}
_FLAG_BY_DEFINITION = {"broad": "is_ai", "tag": "ai_tag"}


@dataclass(frozen=True)
class Filters:
    """What to keep.  An empty tuple, None or "All" leaves that dimension open.

    ``ai`` is All, AI or Non-AI under ``ai_definition`` (broad or tag).
    """

    years: tuple[int, int] = (2005, 2100)
    industries: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    team_range: tuple[int, int] | None = None
    include_unknown_team: bool = True
    include_incomplete: bool = False
    ai: str = "All"
    ai_definition: str = "broad"

    def predicate(self) -> Column:
        """One condition of plain comparisons, so that the parts reach the scan."""
        keep = F.col("batch_year").between(*self.years)
        if not self.include_incomplete:
            keep &= F.col("batch_status").isin("complete", "unknown")
        for name, column in _LISTS.items():
            if getattr(self, name):
                keep &= F.col(column).isin(*getattr(self, name))
        if self.ai != "All":
            flagged = F.coalesce(F.col(flag_column(self.ai_definition)), F.lit(False))
            keep &= flagged if self.ai == "AI" else ~flagged
        if self.team_range is not None:
            sized = F.col("team_size").between(*self.team_range)
            keep &= (sized | F.col("team_size").isNull()) if self.include_unknown_team else sized
        return keep


def flag_column(definition: str) -> str:
    return _FLAG_BY_DEFINITION[definition]


def apply_filters(df: DataFrame, spec: Filters, allowed: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Rows that pass ``spec`` and whose columns hold a value of the tables in ``allowed``.

    ``allowed`` maps a column to a table with that column, of any size; repeated and null values there change nothing.
    Lists in ``spec`` with over ``LONGEST_LIST`` values are joined the same way: a longer condition would no longer reach
    the scan and would be shipped with every task.  Spark broadcasts such a table if it measures it as small.
    """
    short, tables = spec, dict(allowed or {})
    for name, column in _LISTS.items():
        values = getattr(spec, name)
        if len(values) > LONGEST_LIST:
            short = replace(short, **{name: ()})
            given = df.sparkSession.createDataFrame([(v,) for v in sorted(set(values))], f"{column} string")
            df = df.join(given, column, "left_semi")
    for column, values in tables.items():
        df = df.join(values.select(column), column, "left_semi")
    return df.filter(short.predicate())
