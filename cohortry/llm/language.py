"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of one to three characters, words
padded by a mark on both sides.  A document's profile is compared with each
language's by out-of-place distance: how far each of its n-grams stands from its
place in the language's list, or the most if it is not there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.bytes import slices, whole
from cohortry.session import ship_package

PLACES = 400
# Languages whose profiles may be fetched and told to the tasks; more is an error, not a cut.
MOST_LANGUAGES = 5000
UNKNOWN = "und"
_MARK = np.uint64(1)
# What a task counts before it hands its counts on.
_HELD = 400_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Up to three n-grams ending at each letter or word end, 0 for none, as numbers; and where each text's begin (one more than texts)."""
    lowered = [text.lower() for text in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    chars = np.where(letter, points, 1)[kept].astype(np.uint64)
    ends = np.cumsum([len(x) + 1 for x in lowered])
    first = np.concatenate([[1], np.cumsum(kept)[ends]])
    found = np.zeros((len(chars), 3), np.uint64)
    found[:, 0] = np.where(chars == _MARK, 0, chars)
    found[1:, 1] = chars[:-1] << np.uint64(21) | chars[1:]
    found[1:, 1][(chars[:-1] == _MARK) & (chars[1:] == _MARK)] = 0
    found[2:, 2] = np.where(chars[1:-1] == _MARK, 0, chars[:-2] << np.uint64(42) | chars[1:-1] << np.uint64(21) | chars[2:])
    return found, first


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(found, return_counts=True)
    return (keys[1:], counts[1:]) if len(keys) and keys[0] == 0 else (keys, counts)


def profiles(docs: DataFrame, places: int = PLACES) -> list[tuple[str, list[int]]]:
    """For each non-null ``lang``, its most frequent n-grams in order (equal counts by number), over all rows and whole texts.

    Tasks count per language before anything is shuffled, so a language of most
    rows costs no more than others.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts, langs = whole(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs[lo:hi], texts.slice(lo, hi - lo).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, some in by.items():
                    keys, counts = _counted(ngrams(some)[0])
                    if lang in held:
                        old_keys, old = held[lang]
                        both, place = np.unique(np.concatenate([old_keys, keys]), return_inverse=True)
                        keys, counts = both, np.bincount(place, np.concatenate([old, counts])).astype(np.int64)
                    held[lang] = (keys, counts)
                if sum(len(k) for k, _ in held.values()) > _HELD:
                    yield from flush()
        yield from flush()

    rows = docs.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).filter(F.col("place") <= places).select("lang", "place", "gram")
    found = top.orderBy("lang", "place").limit(MOST_LANGUAGES * places + 1).collect()
    out: dict[str, list[int]] = {}
    for row in found:
        out.setdefault(row.lang, []).append(row.gram)
    if len(found) > MOST_LANGUAGES * places:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return sorted(out.items())


class Ranker:
    """Places of n-grams in every language's profile."""

    def __init__(self, known: list[tuple[str, list[int]]], places: int = PLACES):
        self.names, self.places = [name for name, _ in known], places
        self.grams = np.unique(np.array([g for _, grams in known for g in grams], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(known)), places, np.int32)
        for k, (_, grams) in enumerate(known):
            self.ranks[np.searchsorted(self.grams, np.array(grams, np.int64).view(np.uint64)), k] = np.arange(len(grams))

    def predict(self, found: np.ndarray) -> tuple[str, float]:
        """Language and likeness (1: every n-gram in its place) from a text's n-grams; ties go to the first name."""
        keys, counts = _counted(found)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        own = keys[np.argsort(-counts, kind="stable")[: self.places]]
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        apart = np.where(ranks == self.places, self.places, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.names[best], 1.0 - float(apart[best]) / (self.places * len(own))


def predict(docs: DataFrame, known: list[tuple[str, list[int]]], places: int = PLACES) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; ``und`` and 0 for null texts, texts without letters, and without profiles."""
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(told.value, places)
        for batch in batches:
            texts = whole(batch.column(1))
            for lo, hi in slices(texts):
                found, first = ngrams(texts.slice(lo, hi - lo).to_pylist())
                rows = [ranker.predict(found[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def is_held_out(doc_id: Column) -> Column:
    """Rows not learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
