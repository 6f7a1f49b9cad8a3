"""Document fingerprints by locally consistent parsing.

A text is parsed again and again into phrases.  First a run of one name becomes
one name.  Then deterministic coin tossing reduces neighbouring names, all
different, to labels below six that still differ: a label is the place and value
of the lowest bit in which a name differs from the one before it, taken four
times more over the labels.  Phrases begin where a label exceeds both its
neighbours, so where they begin depends on a few names around, not on the offset,
and equal substrings share all their phrases but a few at their ends.  A phrase's
name is a hash of its names, and the sequence of phrases is the next level's text.

A fingerprint holds the last name, for three levels the number of phrases, and a
sketch of the set of phrase names: the least hash in each of 64 slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.bytes import mix, stream, whole
from cohortry.session import ship_package

LEVELS = 3
SLOTS = 64
# Likeness is read from the highest level at which both texts have so many phrases.
ENOUGH = 16
_CHARS = 1 << 18
_EMPTY = np.uint64((1 << 64) - 1)


def _toss(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which the values differ, plus its value."""
    low = (values ^ before) & (~(values ^ before) + values.dtype.type(1))
    return (2 * np.bitwise_count(low - values.dtype.type(1)) + ((values & low) != 0)).astype(np.uint8)


def _table(size: int) -> np.ndarray:
    before, value = np.meshgrid(np.arange(size, dtype=np.uint8), np.arange(size, dtype=np.uint8), indexing="ij")
    return _toss(value, before)


# Labels of 64-bit names are at most 129; each table maps (label before, label) to the next label.
_TABLES = [_table(size) for size in (130, 18, 18, 18)]
_WEIGHTS = stream(31, 64)


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of phrases, and the place of each text's first (one more than texts).  Every text has names."""
    begins = first[:-1]
    same = np.zeros(len(names), bool)
    same[1:] = names[1:] == names[:-1]
    same[begins] = False
    if same.any():
        starts = np.flatnonzero(~same)
        size = np.diff(np.append(starts, len(names)))
        first = np.searchsorted(starts, first)
        names, begins = names[starts], first[:-1]
        long = np.flatnonzero(size > 1)
        names[long] = mix(names[long] + mix(size[long].astype(np.uint64)))
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[begins] = names[begins] ^ np.uint64(1)
    label = _toss(names, before)
    for table in _TABLES:
        last = np.empty_like(label)
        last[1:] = label[:-1]
        last[begins] = label[begins] ^ 1
        label = table[last, label]
    ends = first[1:] - 1
    more = np.ones(len(label), bool)
    more[:-1] = label[:-1] > label[1:]
    more[ends] = True
    top = np.ones(len(label), bool)
    top[1:] = label[1:] > label[:-1]
    top &= more
    top[begins] = True
    starts = np.flatnonzero(top)
    size = np.diff(np.append(starts, len(names)))
    place = np.arange(len(names)) - np.repeat(starts, size)
    return mix(np.add.reduceat(names * _WEIGHTS[np.minimum(place, 63)] + place.astype(np.uint64), starts) + size.astype(np.uint64)), np.searchsorted(starts, first)


def _sketch(names: np.ndarray, text: np.ndarray, texts: int, level: int) -> np.ndarray:
    key = mix(names + np.uint64(level + 1))
    out = np.full(texts * SLOTS, _EMPTY)
    np.minimum.at(out, text * SLOTS + (key >> np.uint64(58)).astype(np.int64), key & np.uint64((1 << 58) - 1))
    return np.where(out == _EMPTY, 0, mix(out) % np.uint64(65535) + np.uint64(1)).astype(">u2").reshape(texts, SLOTS)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text, as hexadecimal digits; the empty text has one too."""
    sizes = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    roots = np.zeros(len(texts), ">u8")
    counts = np.zeros((len(texts), LEVELS), ">u4")
    sketches = [np.zeros((len(texts), SLOTS), ">u2") for _ in range(LEVELS)]
    alive = np.flatnonzero(sizes)
    first = np.concatenate([[0], np.cumsum(sizes[alive])])
    names = mix(points.astype(np.uint64) + np.uint64(1))
    level = 0
    while len(alive):
        names, first = parse(names, first)
        size = np.diff(first)
        if level < LEVELS:
            text = np.repeat(np.arange(len(alive)), size)
            counts[alive, level] = size
            sketches[level][alive] = _sketch(names, text, len(alive), level)
        level += 1
        done = size == 1
        roots[alive[done]] = mix(names[first[:-1][done]] + np.uint64(level))
        if done.any():
            names = names[np.repeat(~done, size)]
            alive = alive[~done]
            first = np.concatenate([[0], np.cumsum(size[~done])])
    held = [roots.reshape(-1, 1).view(np.uint8), counts.view(np.uint8), *[s.view(np.uint8) for s in sketches]]
    return [row.tobytes().hex() for row in np.concatenate(held, 1)]


def likeness(a: str, b: str) -> float:
    """Shared phrases as a share of both texts' (0 to 1), estimated from two fingerprints; equal texts give 1."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    if x[:8] == y[:8]:
        return 1.0
    m, n = np.frombuffer(x[8 : 8 + 4 * LEVELS], ">u4"), np.frombuffer(y[8 : 8 + 4 * LEVELS], ">u4")
    level = max([k for k in range(LEVELS) if min(m[k], n[k]) >= ENOUGH], default=0)
    at = 8 + 4 * LEVELS + 2 * SLOTS * level
    u, v = np.frombuffer(x[at : at + 2 * SLOTS], ">u2"), np.frombuffer(y[at : at + 2 * SLOTS], ">u2")
    used = int(((u > 0) | (v > 0)).sum())
    shared = int(((u == v) & (u > 0)).sum()) / used if used else 0.0
    return 2 * shared / (1 + shared)


def _with_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for row, text in enumerate(texts):
        if held and held + len(text) > _CHARS:
            yield start, row
            start, held = row, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for each row; null texts are empty.  Nothing is shuffled."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = whole(batch.column(1)).to_pylist()
            for lo, hi in _with_blocks(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in texts[lo:hi]], pa.int64()), pa.array(fingerprints(texts[lo:hi]))],
                    ["doc_id", "n_chars", "fingerprint"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_FIRST = np.iinfo(np.int64).min
_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(docs: DataFrame) -> DataFrame:
    """Documents in ascending order over partitions, each partition followed by the first document of the next.

    Cut points are quantiles of ``doc_id`` alone, one for each shuffle partition.
    The first id of each part (as many numbers) tells which rows also go to the
    part before; after the last comes the first.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(_FIRST)).cast("long").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    quantiles = [k / parts for k in range(1, parts)] or [0.5]
    cuts = np.unique(np.array(rows.agg(F.percentile_approx("place", quantiles, 10_000 + 20 * parts)).first()[0] or [], np.int64))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy()
            part = np.searchsorted(cuts, place, side="left")
            found = np.unique(part, return_inverse=True)
            least = np.full(len(found[0]), np.iinfo(np.int64).max)
            np.minimum.at(least, found[1], place)
            yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), pa.array(least)], ["part", "least"])

    heads = rows.select("place").mapInArrow(numbered, "part int, least long").groupBy("part").agg(F.min("least").alias("least")).orderBy("part").collect()
    order = {row.least: heads[k - 1].part for k, row in enumerate(heads)}
    told = spark.sparkContext.broadcast((cuts, order))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, order = told.value
        heads = np.array(sorted(order), np.int64)
        for batch in batches:
            place = batch.column(1).to_numpy()
            part = pa.array(np.searchsorted(cuts, place, side="left").astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, pa.array(np.zeros(len(place), bool)), *batch.columns], ["part", "next", *batch.schema.names])
            again = np.flatnonzero(np.isin(place, heads))
            if len(again):
                part = pa.array([order[k] for k in place[again].tolist()], pa.int32())
                copied = [column.take(pa.array(again)) for column in batch.columns]
                yield pa.RecordBatch.from_arrays([part, pa.array(np.ones(len(again), bool)), *copied], ["part", "next", *batch.schema.names])

    both = rows.mapInArrow(dealt, "part int, next boolean, doc_id long, place long, text string")
    return both.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("next", "place", "text")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document against its edited form and against the next document by ascending ``doc_id``.

    The edited form has its last half (rounded down) replaced by as many of the
    next document's first code points, or all it has.  Null ids come first, rows
    of one id follow each other by text, and a single document is its own next.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            names, after, texts = batch.column("doc_id").to_pylist(), batch.column("next").to_pylist(), batch.column("text").to_pylist()
            if True in after:  # only the first of these is anyone's next
                names, after, texts = (x[: after.index(True) + 1] for x in (names, after, texts))
            for lo, hi in _with_blocks(texts):
                own = list(zip(names[lo:hi], after[lo:hi], texts[lo:hi], fingerprints(texts[lo:hi]), strict=True))
                chain = [last, *own] if last else own
                last = chain[-1]
                edited = [a[2][: len(a[2]) - len(a[2]) // 2] + b[2][: len(a[2]) // 2] for a, b in zip(chain, chain[1:], strict=False)]
                marks = fingerprints(edited)
                rows = [
                    (a[0], len(a[2]), hashlib.sha256(text.encode()).hexdigest(), a[3], mark, likeness(a[3], mark), likeness(a[3], b[3]))
                    for a, b, text, mark in zip(chain, chain[1:], edited, marks, strict=False)
                ]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], _COLUMNS)
            if last and last[1]:
                return

    return _neighbours(docs).select("doc_id", "next", "text").mapInArrow(run, _SCHEMA)
