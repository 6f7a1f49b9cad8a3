"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are its own and its neighbours'; the
chain's transitions let a line borrow evidence from the lines around it.  A
document's score is the mean of its lines' forward-backward marginals, weighted
by their length.  Labels belong to documents; in training every line carries its
document's label, and documents weigh the same whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.bytes import lean, mix, slices, utf8, whole, words
from cohortry.session import ship_package

# At most so many labelled documents (those with the smallest id hashes) are fetched to fit the few weights.
SAMPLE_DOCUMENTS = 3000
STEPS = 120
RIDGE = 1e-3
ACCEPT = 0.7

_LINE = np.ones(256, bool)
_LINE[10] = False
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def _kind(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_UPPER = _kind(bytes(range(65, 91)))
_LOWERS = _kind(bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _kind(b"0123456789")
_PLAIN = _kind(b".,;:'\"-()?")
_MARK = _kind(b"!#$%&*+/<=>@[\\]^_`{|}~")
FEATURES = ("size", "upper", "lower", "digit", "plain", "mark", "words", "word_size", "same_as_last", "distinct", "ends_sentence", "starts_upper", "seen_before")


def line_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: the features of each line that is not empty, the bytes of each, and the lines of each text."""
    for lo, hi in slices(column):
        data, offsets = utf8(column.slice(lo, hi - lo))
        line_hash, begin, end, first = words(data, offsets, _LINE)
        n = len(begin)
        if not n:
            yield np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), np.diff(first)
            continue
        size = (end - begin).astype(np.float64)
        share = [np.add.reduceat(kind[data], begin, dtype=np.int64) / size for kind in (_UPPER, _LOWERS, _DIGIT, _PLAIN, _MARK)]
        word_hash, at, to, _ = words(data, offsets, _WORD)
        line = np.searchsorted(begin, at, side="right") - 1
        count = np.maximum(np.bincount(line, minlength=n), 1)
        letters = np.bincount(line, to - at, minlength=n)
        same = np.bincount(line[1:], (word_hash[1:] == word_hash[:-1]) & (line[1:] == line[:-1]), minlength=n) if len(line) else np.zeros(n)
        _, once = np.unique(mix(word_hash + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        distinct = np.bincount(line[once], minlength=n)
        text = np.searchsorted(first, np.arange(n), side="right") - 1
        seen = np.ones(n)
        seen[np.unique(mix(line_hash + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] = 0
        last = data[end - 1]
        columns = [np.log1p(size), *share, np.log1p(count), letters / count, same / count, distinct / count, np.isin(last, list(b".!?")), _UPPER[data[begin]], seen]
        yield np.stack(columns, 1).astype(np.float32), size, np.diff(first)


def with_neighbours(own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after; beyond the ends they are zero, which two flags tell."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[sizes > 0]
    ends = ends[sizes > 0] - 1
    edge = np.zeros((len(own), 2), own.dtype)
    before[begins], after[ends] = 0, 0
    edge[begins, 0], edge[ends, 1] = 1, 1
    return np.concatenate([own, before, after, edge], 1)


def marginals(score: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of the given sizes.

    ``score`` is the log weight of good against bad for each line, ``step`` the
    log weights of transitions (from, to).  Returns each line's probability of
    good, and for each chain the expected transitions.
    """
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    weight = np.ones((len(score), 2))
    weight[:, 1] = np.exp(np.clip(score, -30, 30))
    move = np.exp(step)
    ahead, back = np.empty_like(weight), np.ones_like(weight)
    for t in range(longest):
        at = begins[: active[t]] + t
        here = weight[at] if t == 0 else weight[at] * (ahead[at - 1] @ move)
        ahead[at] = here / here.sum(1, keepdims=True)
    pairs = np.zeros((len(sizes), 2, 2))
    for t in range(longest - 2, -1, -1):
        at = begins[: active[t + 1]] + t
        later = weight[at + 1] * back[at + 1]
        joint = ahead[at][:, :, None] * move[None] * later[:, None, :]
        pairs[order[: active[t + 1]]] += joint / joint.sum((1, 2), keepdims=True)
        here = later @ move.T
        back[at] = here / here.sum(1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(1), pairs


@dataclass
class Model:
    """A fitted field: a few hundred numbers."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray

    def lines(self, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The probability of good for each line."""
        near = with_neighbours((own - self.centre) / self.scale, sizes)
        return marginals(near @ self.weights + self.bias, sizes, self.step)[0]

    def documents(self, own: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The length-weighted mean for each text; texts without lines get 0."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(text, weight, minlength=len(sizes))
        found = np.bincount(text, weight * self.lines(own, sizes), minlength=len(sizes))
        return np.clip(np.where(total > 0, found / np.maximum(total, 1e-9), 0.0), 0.0, 1.0)


def train(own: np.ndarray, sizes: np.ndarray, good: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Maximise the chains' conditional likelihood with a ridge, by Adam from zero; deterministic."""
    own = own.astype(np.float64)
    centre, scale = (own.mean(0), own.std(0) + 1e-3) if len(own) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    near = with_neighbours((own - centre) / scale, sizes)
    share = np.repeat(1.0 / np.maximum(sizes, 1), sizes) / max(1, len(sizes))
    truth = np.repeat(good.astype(np.float64), sizes)
    within = np.zeros((2, 2))
    for label in (0, 1):
        within[label, label] = ((sizes - 1) / np.maximum(sizes, 1))[(good == label) & (sizes > 0)].sum() / max(1, len(sizes))
    theta = np.zeros(near.shape[1] + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1 if len(own) else 1):
        step = theta[-4:].reshape(2, 2)
        found, pairs = marginals(near @ theta[:-5] + theta[-5], sizes, step)
        error = share * (truth - found)
        moves = within - (pairs / np.maximum(sizes, 1)[:, None, None]).sum(0) / len(sizes)
        slope = np.concatenate([near.T @ error, [error.sum()], moves.ravel()]) - ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta += 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return Model(centre, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


def is_held_out(doc_id: Column) -> Column:
    """The rows whose labels are kept from training: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS) -> Model:
    """Fit on labelled rows that are not held out: at most ``most`` documents, by smallest id hash.

    Of repeated labels the lower counts, and a document's lines are used whole.
    Null ids and labels are left out; without any label all scores are 0.5.
    """
    ship_package(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    chosen = known.filter(~is_held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for own, _, sizes in line_features(whole(batch.column(1))):
                ends = np.cumsum(sizes)
                cut = [own[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), batch.column(2).slice(at, len(sizes)), pa.array(cut, pa.binary())], ["doc_id", "good", "own"])
                at += len(sizes)

    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "text", F.col("good").cast("int").alias("good")).mapInArrow(lean(run), "doc_id long, good int, own binary").limit(2 * most).toPandas()
    rows = rows.sort_values(["doc_id", "own"], ignore_index=True)
    own = np.frombuffer(b"".join(rows["own"]), np.float32).reshape(-1, len(FEATURES))
    sizes = rows["own"].map(len).to_numpy(np.int64) // (4 * len(FEATURES))
    return train(own, sizes, rows["good"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1) in place of any column of that name; null and empty texts get 0.

    Nothing is shuffled; repeated rows stay.  Only ``text`` is an input of the score.
    """
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.drop("score")
    at = held.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [told.value.documents(*part) for part in line_features(whole(batch.column(at)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*found, np.zeros(0)]))], [*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return held.mapInArrow(lean(run), f"{kinds}, score double")


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The rows whose score reaches ``least``."""
    return score(docs, model).filter(F.col("score") >= least).select(*docs.columns)
