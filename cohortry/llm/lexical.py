"""Ranked lexical search by the Best Position Algorithm over impact lists.

A pass over the documents keeps, in segments, how often each holds a term of the queries, and counts what weights need
from all documents.  A task then makes the impact lists of a segment (a term's documents by falling impact) and answers
every query on them: lists are read from the top in step (sorted access), every document met is scored in full at once
from its own terms (direct access), and all its places in the query's lists count as seen.  A list's best position is the
end of its seen places without a gap; no document unseen can exceed the sum of the impacts that follow them.  Reading
stops when that sum is strictly below the score of the k-th document found, so ties are complete.  A task's later segments
start from the k documents it has.  The best of all tasks are merged by one window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.session import ship_package, stage, unstage

BEST = 10
# Postings in a segment, and bytes of query text that are answered in one pass; more queries take more passes.
SEGMENT_POSTINGS = 1 << 20
BLOCK_BYTES = 4 << 20
_FIRST_DEPTH = 16
_NO_ID = np.iinfo(np.int64).min
# What is no part of a term becomes a space, A-Z lower case; bytes above 0x7F are of terms.
_TERM_BYTES = bytes(b if b > 0x7F or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_SEGMENT = pa.schema([
    ("documents", pa.int64()), ("words", pa.int64()), ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("ends", pa.binary()),
    ("terms", pa.binary()), ("counts", pa.binary()),
])
_SEGMENT_SQL = "documents long, words long, doc_ids binary, sizes binary, ends binary, terms binary, counts binary"


def terms(text: str | None) -> list[bytes]:
    """The text's terms in order, as UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _segments(docs: DataFrame, vocabulary) -> DataFrame:
    """Documents as segments: ids, sizes in terms, and the queries' terms they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        ids, sizes, ends, found, counts, words, documents = [], [], [], [], [], 0, 0

        def packed() -> pa.RecordBatch:
            arrays = [np.array(ids, "<i8"), np.array(sizes, "<i8"), np.array(ends, "<i8"), np.array(found, "<i4"), np.array(counts, "<i8")]
            values = [[documents], [words], *[[a.tobytes()] for a in arrays]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = terms(text.as_py())
                documents, words = documents + bool(held), words + len(held)
                each = Counter(held)
                common = known.keys() & each.keys()
                if not common:
                    continue
                ids.append(_NO_ID if doc_id is None else doc_id)
                sizes.append(len(held))
                found.extend(known[t] for t in common)
                counts.extend(each[t] for t in common)
                ends.append(len(found))
                if len(found) >= SEGMENT_POSTINGS:
                    yield packed()
                    ids, sizes, ends, found, counts, words, documents = [], [], [], [], [], 0, 0
        if documents:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, _SEGMENT_SQL)


def _holding(segments: DataFrame) -> DataFrame:
    """``term, df``: in how many documents each term of the queries stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                term, df = np.unique(np.frombuffer(row.as_py(), "<i4"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df.astype(np.int64))], ["term", "df"])

    return segments.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class ImpactLists:
    """A segment's documents, forward (by document) and as lists by falling impact, equal impacts by ascending id."""

    def __init__(self, doc_ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, term: np.ndarray, count: np.ndarray, documents: int, words: int, vocabulary: int) -> None:
        length = 10 + (90 * sizes * documents) // words
        held = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(doc_ids)), held)
        self.doc_ids, self.begin, self.end, self.term = doc_ids, ends - held, ends, term
        self.impact = (1_000_000_000 * count) // (1000 * count + 8 * length[doc])
        order = np.lexsort((doc_ids[doc], -self.impact, term))
        self.doc, self.falling = doc[order], self.impact[order]
        self.first = np.searchsorted(term[order], np.arange(vocabulary + 1))
        # Where each document's term stands in its list.
        self.place = np.empty(len(term), np.int64)
        self.place[order] = np.arange(len(term)) - self.first[term[order]]

    def direct(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of these documents, and to which of them each belongs."""
        sizes = self.end[docs] - self.begin[docs]
        owner = np.repeat(np.arange(len(docs)), sizes)
        before = np.cumsum(sizes) - sizes
        return np.arange(len(owner)) - before[owner] + self.begin[docs][owner], owner


def best(lists: ImpactLists, query: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of documents and their scores, with the k best of the segment among them, and how many were scored.

    ``floor``: documents below this score are of no use (0: every one above 0 is).
    """
    query = query[(weights[query] > 0) & (lists.first[query + 1] > lists.first[query])]
    first, sizes = lists.first[query], (lists.first[query + 1] - lists.first[query])
    slot = np.full(len(weights), -1)
    slot[query] = np.arange(len(query))
    seen = [np.zeros(n + 1, bool) for n in sizes]  # the last place is never seen: it stands behind the list
    position = np.zeros(len(query), np.int64)
    met = np.zeros(len(lists.doc_ids), bool)
    docs, scores, depth, read = np.empty(0, np.int64), np.empty(0, np.int64), _FIRST_DEPTH, 0
    while len(query):
        fresh = [lists.doc[a + min(read, n) : a + min(depth, n)] for a, n in zip(first, sizes, strict=True)]
        new = np.unique(np.concatenate(fresh))
        new = new[~met[new]]
        met[new] = True
        at, owner = lists.direct(new)
        which = slot[lists.term[at]]
        at, owner, which = at[which >= 0], owner[which >= 0], which[which >= 0]
        total = np.zeros(len(new), np.int64)
        np.add.at(total, owner, weights[lists.term[at]] * lists.impact[at])
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, total])
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(query) + 1))
        bound = 0
        for i in range(len(query)):
            seen[i][lists.place[at[order[cuts[i] : cuts[i + 1]]]]] = True
            position[i] += np.argmin(seen[i][position[i] :])
            if position[i] < sizes[i]:
                bound += int(weights[query[i]]) * int(lists.falling[first[i] + position[i]])
        kth = max(floor, int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0)
        if bound < kth or bound == 0:
            break
        read, depth = depth, depth * 2
    return docs, scores, len(docs)


def _answers(segments: DataFrame, told, k: int) -> DataFrame:
    """``query, doc_id, score, scored`` of the k best of each task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, words = told.value
        held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]
        scored = np.zeros(len(queries), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                kinds = ("<i8", "<i8", "<i8", "<i4", "<i8")
                lists = ImpactLists(*[np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in enumerate(kinds)], documents, words, len(weights))
                for q, query in enumerate(queries):
                    ids, values = held[q]
                    docs, scores, n = best(lists, query, weights, k, int(values[-1]) if len(values) >= k else 0)
                    scored[q] += n
                    ids, values = np.concatenate([ids, lists.doc_ids[docs]]), np.concatenate([values, scores])
                    order = np.lexsort((ids, -values))[:k]
                    order = order[values[order] > 0]
                    held[q] = ids[order], values[order]
        sizes = [len(ids) for ids, _ in held]
        ids = np.concatenate([ids for ids, _ in held]) if held else np.empty(0, np.int64)
        columns = [
            pa.array(np.repeat(np.arange(len(queries), dtype=np.int32), sizes)), pa.array(ids, mask=ids == _NO_ID),
            pa.array(np.concatenate([v for _, v in held]) if held else np.empty(0, np.int64)), pa.array(np.repeat(scored, sizes)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score", "scored"])

    return segments.select("doc_ids", "sizes", "ends", "terms", "counts").mapInArrow(run, "query int, doc_id long, score long, scored long")


def _blocks(items: DataFrame, block_bytes: int) -> Iterable[DataFrame]:
    """Items in blocks of at most so many bytes of text (or one item), by a hash of the row."""
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    count = -(-2 * size // block_bytes)
    if count <= 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b) for b in range(count)]


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's k highest-scoring documents with a score above 0.

    Queries are the distinct terms of ``items.text``; those of one block travel to every task, so a pass is bounded by
    ``block_bytes`` and not by the table.  Null texts, and texts without terms, find nothing and are found by nothing.
    Equal scores stand by ascending id, null first; repeated rows are documents, and items, of their own.  Empty tables
    give an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select("doc_id", "text")
    parts = []
    for block in _blocks(items.select("item_id", "text"), block_bytes):
        rows = block.collect()
        asked = [sorted(set(terms(r["text"]))) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted({t for each in asked for t in each}))}
        if not vocabulary:
            continue
        words = spark.sparkContext.broadcast(vocabulary)
        segments = stage(_segments(docs, words), "impact-segments")
        total = segments.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
        documents, length = total["documents"] or 0, total["words"] or 0
        weights = np.zeros(len(vocabulary), np.int64)
        for row in _holding(segments).collect():  # at most one row for each term of the block
            weights[row["term"]] = weight(documents, row["df"])
        queries = [np.array([vocabulary[t] for t in each], np.int64) for each in asked]
        told = spark.sparkContext.broadcast((queries, weights, documents, length))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        found = _answers(segments, told, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query int, item_id {dict(items.dtypes)['item_id']}")
        parts.append(stage(found.join(names, "query").select("item_id", "rank", "doc_id", "score"), "impact-answers"))
        unstage(segments)
    if not parts:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


CHECKING_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), held AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM doc WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM held),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id,
    sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN df USING (term), total t(docs, words) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
