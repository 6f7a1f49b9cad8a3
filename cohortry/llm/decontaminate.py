"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by every document's windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.bytes import _LOWER, lean, runs, slices, utf8, whole, words
from cohortry.session import ship_package, stage, unstage

WINDOW = 10
# Windows reach the tasks in blocks of at most about this many bytes; each block is one more pass over a task's rows.
BLOCK_BYTES = 16 << 20

# 0-9, a-z (after lower-casing) and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, length: int) -> bytes:
    return b" ".join([low[a:b].tobytes() for a, b in zip(starts[first : first + length].tolist(), ends[first : first + length].tolist(), strict=True)])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, length, hash, window`` for each distinct window of each item; null ids, null texts and wordless texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = whole(batch.column(1))
            for lo, hi in slices(texts):
                data, offsets = utf8(texts.slice(lo, hi - lo))
                hashes, starts, ends, first = words(data, offsets, _WORD)
                low, rows = _LOWER[data], []
                for k, name in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    a, b = int(first[k]), int(first[k + 1])
                    length = min(WINDOW, b - a)
                    if name is not None and length:
                        found = runs(hashes[a:b], length).view(np.int64).tolist()
                        rows += {(name, length, h, _spelled(low, starts, ends, a + i, length)) for i, h in enumerate(found)}
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["item_id", "length", "hash", "window"])

    found = benchmark.select("item_id", "text").mapInArrow(lean(run), "item_id long, length int, hash long, window binary")
    return found.distinct()


class Windows:
    """One block of windows by hash, with their words and items."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        self.items: dict[bytes, list[int]] = {}
        hashes: dict[int, set[int]] = {}
        for item, length, h, window in rows:
            self.items.setdefault(bytes(window), []).append(item)
            hashes.setdefault(length, set()).add(h & (1 << 64) - 1)
        self.hashes = {length: np.sort(np.array(list(held), np.uint64)) for length, held in hashes.items()}
        self.maybe = {}
        for length, held in self.hashes.items():
            self.maybe[length] = np.zeros(1 << 20, bool)
            self.maybe[length][(held >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, low: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
        """Text, first word, number of words and items of each occurrence; equal hashes are confirmed word for word."""
        for length, held in self.hashes.items():
            found = runs(hashes, length)
            at = np.flatnonzero(self.maybe[length][(found >> np.uint64(44)).astype(np.int64)])
            at = at[held[np.minimum(np.searchsorted(held, found[at]), len(held) - 1)] == found[at]]
            text = np.searchsorted(first, at, side="right") - 1
            inside = at + length <= first[text + 1]
            for k, row in zip(at[inside].tolist(), text[inside].tolist(), strict=True):
                items = self.items.get(_spelled(low, starts, ends, k, length))
                if items:
                    yield row, k, length, items


def _merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "n_words long, word_hits array<array<int>>, items array<long>"


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """The bytes of one text without these spans of its words."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at : starts[a]].tobytes())
        at = int(ends[b - 1])
    return (b"".join(kept) + data[at:].tobytes()).decode()


def _scan(told, rest: int, cut: bool = False):
    """One pass: ``rest`` further columns, the text, and what earlier blocks found; with ``cut`` spans are cut out and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(told.value)
        for batch in batches:
            for lo, hi in slices(whole(batch.column(rest))):
                part = batch.slice(lo, hi - lo)
                data, offsets = utf8(whole(part.column(rest)))
                hashes, starts, ends, first = words(data, offsets, _WORD)
                spans, items = part.column(rest + 2).to_pylist(), [set(x) for x in part.column(rest + 3).to_pylist()]
                for row, k, length, found in windows.hits(_LOWER[data], hashes, starts, ends, first):
                    begin = k - int(first[row])
                    if spans[row] and spans[row][-1][0] <= begin <= spans[row][-1][1]:
                        spans[row][-1][1] = max(spans[row][-1][1], begin + length)
                    else:
                        spans[row].append([begin, begin + length])
                    items[row].update(found)
                spans = [_merged(x) for x in spans]
                columns = [pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
                if not cut:
                    yield pa.RecordBatch.from_arrays([*part.columns[: rest + 1], *columns], batch.schema.names)
                    continue
                texts, gone = part.column(rest).to_pylist(), [0] * (hi - lo)
                for row, found in enumerate(spans):
                    if found:
                        here, at = slice(first[row], first[row + 1]), offsets[row]
                        text = _kept(data[at : offsets[row + 1]], starts[here] - at, ends[here] - at, found)
                        gone[row], texts[row] = len(texts[row]) - len(text), text
                columns = [pa.array(texts, pa.string()), *columns, pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:rest], *columns], [*batch.schema.names, "removed"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``word_hits`` (merged spans of words inside an occurrence) and ``items``.

    ``benchmark`` has ``item_id`` and ``text``.  Its windows are cut into as many
    blocks as their bytes need, so what is broadcast is bounded whatever the
    benchmark's size; documents are never shuffled.  Null texts have no words.
    Repeated rows stay; columns of these names in ``docs`` are replaced.  With ``cut``,
    ``text`` and ``removed`` are those of ``without_hits``, by the same Python task.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("n_words", "word_hits", "items", *["removed"] * cut)
    windows = stage(item_windows(benchmark), "windows")
    size = windows.agg(F.sum(F.length("window") + 120)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    columns = [c for c in docs.columns if c != "text"]
    out = docs.select(*columns, "text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<array<int>>)").alias("word_hits"),
                      F.expr("cast(array() as array<long>)").alias("items"))
    for block in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == block).collect()
        last, kinds = cut and block == blocks - 1, out.schema
        if last:
            kinds = T.StructType([*kinds.fields, T.StructField("removed", T.LongType())])
        out = out.mapInArrow(lean(_scan(spark.sparkContext.broadcast([tuple(r) for r in rows]), len(columns), last)), kinds)
    unstage(windows)
    return out


def n_hit() -> Column:
    """Words inside occurrences, from ``word_hits``."""
    return F.aggregate("word_hits", F.lit(0).cast("long"), lambda n, span: n + span[1] - span[0])


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from the rows of ``find``."""
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("word_hits") > 0).alias("contaminated"),
    )


def without_hits(found: DataFrame) -> DataFrame:
    """The rows of ``find`` with hit spans cut out of ``text``; ``removed`` tells how many characters went."""
    columns = [c for c in found.columns if c not in ("text", "word_hits", "n_words", "items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(len(columns)).to_pylist(), []
            for row, spans in enumerate(batch.column(len(columns) + 1).to_pylist()):
                gone.append(0)
                if spans:
                    data = np.frombuffer(texts[row].encode(), np.uint8)
                    _, starts, ends, _ = words(data, np.array([0, len(data)]), _WORD)
                    text = _kept(data, starts, ends, spans)
                    gone[-1], texts[row] = len(texts[row]) - len(text), text
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(texts, pa.string()), pa.array(gone, pa.int64())], [*columns, "text", "removed"])

    held = found.select(*columns, "text", "word_hits")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    return held.mapInArrow(lean(run), f"{kinds}, removed long")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CHECKING_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS size, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
texts AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
places AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM texts, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (win, size)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY 1),
hit_items AS (
    SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY 1)
SELECT t.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit_words h ON h.doc_id = t.doc_id LEFT JOIN hit_items x ON x.doc_id = t.doc_id"""
