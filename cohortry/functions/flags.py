"""Column expressions for derived flags and size classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: words in tags and in descriptions that set the flag.
TAG_PATTERN = (
    r"\bai\b|artificial intelligence|machine learning|deep learning|computer vision|\bnlp\b|generative|\bllm"
)
KEYWORD_PATTERN = (
    r"\bai\b|\ba\.i\.|artificial intelligence|machine learning|deep learning|\bllms?\b|large language model|"
    r"\bgpt\b|generative|neural network|computer vision|\bnlp\b"
)

# Every alternative of the two patterns starts with one of these letters; looking ahead for one skips most positions.
_FIRST_LETTER = "(?=[acdglmn])"

# Upper edges (included) of the size classes and their labels.
SIZE_EDGES = (1, 2, 5, 10, 50, 200)
SIZE_LABELS = ("1", "2", "3-5", "6-10", "11-50", "51-200", "200+")


def _matches(text: Column, pattern: str) -> Column:
    first = _FIRST_LETTER if pattern in (TAG_PATTERN, KEYWORD_PATTERN) else ""
    return text.rlike(f"(?iU){first}(?:{pattern})")


def any_tag_matches(tags: Column, pattern: str = TAG_PATTERN) -> Column:
    return F.exists(tags, lambda tag: _matches(tag, pattern))


def text_matches(one_liner: Column, description: Column, pattern: str = KEYWORD_PATTERN) -> Column:
    text = F.concat(F.coalesce(one_liner, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    return _matches(text, pattern)


def size_class(size: Column) -> Column:
    """Label of the right-closed class; null for null and for sizes below the first class."""
    label = F.when(size <= 0, F.lit(None).cast("string"))
    for edge, text in zip(SIZE_EDGES, SIZE_LABELS):
        label = label.when(size <= edge, text)
    return label.when(size.isNotNull(), SIZE_LABELS[-1])
