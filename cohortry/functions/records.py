"""Struct helpers for use inside list functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record(**fields: Column) -> Column:
    """A struct whose field names are known before the surrounding expression is resolved."""
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])

