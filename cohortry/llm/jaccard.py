"""N-gram Jaccard join by T-occurrence search in the manner of DivideSkip.

A document's set holds its distinct word 5-grams; two documents link when the
sets' Jaccard similarity reaches 0.8.  A partner of a set of ``n`` shingles must
occur in at least ``T = ceil(0.8 n)`` of its ``n`` inverted lists.  DivideSkip
leaves long lists out of the merge and probes them afterwards: lists are ordered
short before long, a partner must then occur in one of the first ``n - T + 1``
lists, and only these are merged (a shuffle by shingle).  What they propose is
probed in the rest by binary search in the partner's sorted set.

Which lists count as long comes from exact counts over all documents; the table
of the longest ones that tasks get has a fixed size bound.  Any such table gives
the same result, since all sets are ordered by the same rule.  Two sets whose
sizes are known need ``T = ceil(4 (m + n) / 9)`` shared shingles, so the first one
they share stands at place ``n - T`` or before in both; other meetings are passed
over.

Equal sets are one class and stand in the lists once.  A list of many near
copies never becomes all its pairs: each round compares a list's members with one
of them and merges what links, and only members of different components meet
again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.bytes import lean, mix, runs, slices, stream, utf8, whole, words
from cohortry.llm.components import components
from cohortry.llm.sieve import passes, sieve
from cohortry.session import ship_package, stage, unstage

WORDS = 5
# A list with so many sets is long; of these, at most so many (the longest) are told to the tasks, 12 bytes each.
LONG_LIST = 4
LONG_LISTS = 1 << 18
# Keys are counted by buckets of their upper bits; a task sorts so many keys at a time.
COUNT_BUCKETS = 1 << 12
COUNTED_KEYS = 1 << 21
# Rounds that compare each list with one member before the rest is compared in full.
HUB_ROUNDS = 3

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def merged_lists(n: np.ndarray | int):
    """How many lists of a set of ``n`` shingles are merged: n - T + 1."""
    return n - (4 * n + 4) // 5 + 1


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for lo, hi in slices(column, 1 << 18):
        data, offsets = utf8(column.slice(lo, hi - lo))
        hashes, _, _, first = words(data, offsets, _WORD)
        five = runs(hashes, WORDS)
        for start, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if end - start >= WORDS:
                yield np.unique(five[start : end - WORDS + 1])
            else:
                yield runs(hashes[start:end], end - start) if end > start else np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    """Rows in blocks of bounded text: the other columns and the texts."""
    for batch in batches:
        texts = whole(batch.column(batch.num_columns - 1))
        for lo, hi in slices(texts, limit):
            yield [batch.column(k).slice(lo, hi - lo) for k in range(batch.num_columns - 1)], texts.slice(lo, hi - lo)


def _keys(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """Equal for equal sets."""
    return np.array([int(mix(x ^ np.uint64(seed)).sum()) for x in sets], np.uint64).view(np.int64)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The upper halves of the texts' shingle hashes; counted instead of whole ones to halve what is shuffled."""
    for _, texts in _blocks(batches):
        for x in shingle_sets(texts):
            yield (x >> np.uint64(32)).astype(np.uint32)


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    """Sorted distinct 32-bit keys with their counts, a row for each bucket that has any."""
    keys, counts = np.unique(keys, return_counts=True)
    bucket, counts = (keys // np.uint32((1 << 32) // COUNT_BUCKETS)).astype(np.int32), counts.astype(np.uint32)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*starts[1:].tolist(), len(keys)]
    held = [keys[lo:hi].tobytes() + counts[lo:hi].tobytes() for lo, hi in zip(starts.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(held, pa.binary())], ["bucket", "held"])


def _summed(held: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of one bucket that were counted ``least`` times or more, with their counts."""
    parts = [np.frombuffer(x, np.uint32).reshape(2, -1).astype(np.uint64) for x in held]
    both = np.sort(np.concatenate([x[0] << np.uint64(32) | x[1] for x in parts]))
    keys = (both >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.add.reduceat((both & np.uint64(0xFFFFFFFF)).astype(np.int64), starts)
    return keys[starts][counts >= least].view(np.int32), counts[counts >= least]


def key_counts(df: DataFrame, keys, least: int) -> DataFrame:
    """``t, c``: the 32-bit keys that occur ``least`` times or more, and how often.

    ``keys`` gives the arrays of keys in a task's batches.  Most keys are distinct, so that a row for each would cost far more
    than the counting: tasks sort and count blocks of them and shuffle the counts by bucket, where they are added up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for x in keys(batches):
            parts.append(x)
            n += len(x)
            if n >= COUNTED_KEYS:
                yield _counted(np.concatenate(parts))
                parts, n = [], 0
        if n:
            yield _counted(np.concatenate(parts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, n = None, [], [], 0
        for batch in batches:
            for bucket, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    out.append(_summed(held, least))
                    held, n = [], n + len(out[-1][0])
                    if n >= 1 << 16:
                        yield _joined(out)
                        out, n = [], 0
                now = bucket
                held.append(counts.as_py())
        if held:
            out.append(_summed(held, least))
        if out:
            yield _joined(out)

    return df.mapInArrow(lean(count), "bucket int, held binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(add), "t int, c long")


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["t", "c"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The keys of one column of lists."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        yield (x >> 32 if x.dtype == np.int64 else x).astype(np.int32).view(np.uint32)


def _ordered(long_keys: np.ndarray, long_sizes: np.ndarray):
    maybe = np.zeros(1 << 22, bool)
    maybe[long_keys >> np.uint32(10)] = True

    def order(x: np.ndarray) -> np.ndarray:
        """The lists to merge: short ones by hash, then long ones by length."""
        top = (x >> np.uint64(32)).astype(np.uint32)
        hit = np.flatnonzero(maybe[top >> np.uint32(10)])
        want = merged_lists(len(x))
        if not len(hit) or not len(long_keys):
            return x[:want]
        at = np.minimum(np.searchsorted(long_keys, top[hit]), len(long_keys) - 1)
        size = np.zeros(len(x), np.int64)
        size[hit] = np.where(long_keys[at] == top[hit], long_sizes[at], 0)
        return x[np.argsort(size, kind="stable")[:want]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in _blocks(batches):
            sets = list(shingle_sets(texts))
            n, keys = pa.array([len(x) for x in sets], pa.int64()), [pa.array(_keys(sets, seed)) for seed in (0, 77)]
            yield pa.RecordBatch.from_arrays([ids, n, *keys, _lists([order(x) for x in sets])], ["doc_id", "n", "k1", "k2", "merged"])

    return run


def _parity(x: np.ndarray) -> bytes:
    """A bitmap of at least 4 bits a shingle holding the parity of the shingles that fall on each bit."""
    bits = max(64, 1 << int(4 * len(x) - 1).bit_length())
    odd = np.bincount((mix(x) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _packed(x: np.ndarray) -> bytes:
    """The upper five bytes of each hash; enough to compare two sets of the same pair."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(held, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.int64)


def _whole_sets(bitmap: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (ids,), texts in _blocks(batches):
        kept = pa.array(ids.is_valid().to_numpy(zero_copy_only=False) & passes(bitmap, ids.fill_null(0).to_numpy()))
        ids, sets = ids.filter(kept), list(shingle_sets(texts.filter(kept)))
        n, key = pa.array([len(x) for x in sets], pa.int64()), pa.array(_keys(sets, 0))
        held = [pa.array([f(x) for x in sets], pa.binary()) for f in (_parity, _packed)]
        yield pa.RecordBatch.from_arrays([ids, n, key, *held], ["rep", "n", "k1", "bits", "shingles"])


def may_link(a: bytes, b: bytes, total: int) -> bool:
    """False only if the sets differ in more shingles than linked sets of together ``total`` shingles can."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * 9 <= total


def overlap(a: bytes, b: bytes) -> int:
    """Shared shingles: the smaller set's probed in the larger by binary search."""
    x, y = _unpacked(a), _unpacked(b)
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def _kept(test):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = zip(part.column("x").to_pylist(), part.column("y").to_pylist(), part.column("total").to_pylist(), strict=True)
                kept = pa.array([test(x, y, n) for x, y, n in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(kept) for k in ("a", "b", "total")], ["a", "b", "total"])

    return run


def _sifted(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows whose first column may be in the bitmap."""
    told = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(told.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(lean(run), rows.schema)


def _probe(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs ``(a, b)``, those that link: first by the bitmaps' bound, then by the sets themselves."""

    def with_sides(pairs: DataFrame, sets: DataFrame, column: str, total: Column) -> DataFrame:
        left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col(column).alias("x"))
        right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", total.alias("total"), "x", "y")

    sided = with_sides(pairs, sets, "bits", F.col("na") + F.col("nb"))
    near = stage(sided.mapInArrow(lean(_kept(may_link)), "a long, b long, total long").distinct(), "near")
    needed = sieve(near.select(F.explode(F.array("a", "b")).alias("rep")))
    full = with_sides(near, _sifted(sets.select("rep", "n", "shingles"), needed), "shingles", F.col("total"))
    test = _kept(lambda x, y, n: len(x) + len(y) == 5 * n and 9 * overlap(x, y) >= 4 * n)
    found = stage(full.mapInArrow(lean(test), "a long, b long, total long").select("a", "b").distinct(), "found")
    unstage(near)
    return found


def _sizes_fit(n: Column, m: Column) -> Column:
    return (F.least(n, m) * 100 >= F.greatest(n, m) * 80)


def _may_meet(n: Column, at: Column, m: Column, other_at: Column) -> Column:
    """Whether sets of these sizes, which share the shingles at these places, can link with these as the first they share."""
    least = F.ceil((n + m) * 4 / 9)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * 80) & (at <= n - least) & (other_at <= m - least)


def _located(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("comp", F.col("rep"))
    named = labels.select(F.col("node").alias("rep"), "component")
    return lists.join(named, "rep", "left").select("h", "rep", "n", "at", F.coalesce("component", "rep").alias("comp"))


def _hub_pairs(here: DataFrame, turn: int) -> DataFrame:
    """Each list's members against one of them: first the one with least before the shared shingle, later any."""
    order = F.struct(F.col("at") if turn == 0 else F.lit(0), F.xxhash64("rep", F.lit(turn)).alias("o"))
    hub = (
        here.groupBy("h")
        .agg(F.min(F.struct(order.alias("order"), "rep", "n", "at", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo <> hi").select("h", "hub")
    )
    fits = _may_meet(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"))
    met = here.join(hub, "h").filter((F.col("comp") != F.col("hub.comp")) & fits)
    return met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def _rest_pairs(here: DataFrame) -> DataFrame:
    """All pairs of different components that may meet within a list, one side outside the list's largest component."""
    counts = here.groupBy("h", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
    members = here.join(main, "h")
    few = members.filter("comp <> main").select("h", F.col("rep").alias("r"), F.col("n").alias("m"), F.col("at").alias("r_at"), F.col("comp").alias("other"))
    met = members.join(few, "h").filter((F.col("comp") != F.col("other")) & _may_meet(F.col("n"), F.col("at"), F.col("m"), F.col("r_at")))
    return met.select(F.least("rep", "r").alias("a"), F.greatest("rep", "r").alias("b")).distinct()


def long_lists(tops: DataFrame, least: int = LONG_LIST, most: int = LONG_LISTS, keys=_flat) -> tuple[np.ndarray, np.ndarray]:
    """The longest lists (upper halves of the shingle hashes, sorted) with their lengths; at most ``most`` are fetched."""
    rows = key_counts(tops, keys, least).orderBy(F.desc("c"), "t").limit(most).toArrow()
    keys = rows["t"].to_numpy().astype(np.int32).view(np.uint32)
    order = np.argsort(keys)
    return keys[order], rows["c"].to_numpy()[order]


def jaccard_components(docs: DataFrame, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id``.

    Null and empty texts have no shingles and link with nothing.  Rows that
    repeat a ``doc_id`` are one document with the links of all its texts.  A null
    ``doc_id`` keeps its row and takes part in no component (its own is null).
    Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select("doc_id", "text")
    told = spark.sparkContext.broadcast(long_lists(docs, keys=_tops))

    def ordered(batches):
        return _ordered(*told.value)(batches)

    merged = stage(docs.mapInArrow(lean(ordered), "doc_id long, n long, k1 long, k2 long, merged array<long>"), "merged")
    classes = merged.filter("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    ids = stage(
        merged.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2", "n"], "left")
        .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes"
    )
    repeated = ids.count() > ids.select("doc_id").distinct().count()
    reps = ids.filter("n > 0 and doc_id = rep").select("rep").distinct()
    shared = stage(key_counts(merged.select("merged"), _flat, 2).select("t"), "shared")
    met = spark.sparkContext.broadcast(sieve(shared))

    def lists_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("merged")
            h, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = passes(met.value, h >> np.int64(32))
            rows = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([pa.array(h[kept]), batch.column("doc_id").take(rows), batch.column("n").take(rows), pa.array(at[kept])], ["h", "rep", "n", "at"])

    rows = merged.filter("doc_id is not null").select("doc_id", "n", "merged").mapInArrow(lean(lists_met), "h long, rep long, n long, at long")
    rows = rows.withColumn("t", F.shiftright("h", 32).cast("int")).join(shared, "t").join(reps, "rep").select("h", "rep", "n", "at")
    lists = stage(rows.distinct() if repeated else rows, "lists")
    unstage(merged, shared)
    members = spark.sparkContext.broadcast(sieve(lists.select("rep")))
    sets = stage(docs.mapInArrow(lean(lambda batches: _whole_sets(members.value, batches)), "rep long, n long, k1 long, bits binary, shingles binary"), "sets")
    if repeated:  # its copies would multiply in the joins
        once = stage(sets.dropDuplicates(["rep", "n", "k1"]), "sets")
        unstage(sets)
        sets = once

    labels = None
    for turn in range(hub_rounds + 1):
        here = _located(lists, labels)
        pairs = _hub_pairs(here, turn) if turn < hub_rounds else _rest_pairs(here)
        found = _probe(pairs, sets)
        if not found.isEmpty():
            labels = components(found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    unstage(sets, lists)
    if labels is None:
        return ids.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    named = labels.select(F.col("node").alias("rep"), "component")
    return ids.join(named, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but the smallest ``doc_id`` of each component; rows without an id stay."""
    found = jaccard_components(docs)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


CHECKING_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(r.low, t.doc_id)) AS component_id
FROM texts t LEFT JOIN sizes ON sizes.doc_id = t.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) r ON r.a = t.doc_id"""
