"""Token counts by dynamic programming over a trie of distinct words.

A word's best segmentation under unigram scores is found left to right: the best
score of each prefix from those of shorter ones.  Words that share a prefix share
these scores, so each task keeps its distinct words in a trie whose nodes hold the
best score and the number of tokens of their prefix.  A word's count then stands
at its last node.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortry.llm.bytes import slices, whole
from cohortry.session import ship_package

WORD_START = "▁"
# A character outside the vocabulary becomes its UTF-8 bytes, each at this log score.
BYTE_SCORE = -20.0
# The trie is dropped when it has so many nodes.
MOST_NODES = 250_000
# What a task remembers of distinct words, twice over.
MOST_WORDS = 300_000


def zipf_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model with unigram log scores.

    A BPE model stores merge ranks instead of probabilities; Zipf's law over the
    ranks stands for them.  Control, unknown and byte pieces are left out.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    total = math.log(sum(1 / (k + 2.7) for k in range(len(pieces))))
    return {piece: -math.log(k + 2.7) - total for k, piece in enumerate(pieces)}


class Pieces:
    """All pieces that end at a place, found while a word is read: an automaton over the vocabulary.

    A state is [states after each character, the state of its longest proper end, (length, score) of the pieces that
    end here, shortest first].
    """

    def __init__(self, scores: dict[str, float]):
        self.start: list = [{}, None, ()]
        for piece, score in scores.items():
            state = self.start
            for char in piece:
                state = state[0].setdefault(char, [{}, None, ()])
            if piece:
                state[2] = ((len(piece), score),)
        level = [self.start]
        while level:
            below = []
            for state in level:
                for char, after in state[0].items():
                    after[1] = self.after(state[1], char) if state[1] else self.start
                    after[2] = after[1][2] + after[2]
                    below.append(after)
            level = below

    def after(self, state: list | None, char: str) -> list:
        while state is not None:
            found = state[0].get(char)
            if found is not None:
                return found
            state = state[1]
        return self.start


class Trie:
    """Best scores and token counts of prefixes; nodes are numbered, children found by number and character."""

    def __init__(self, scores: dict[str, float]):
        self._pieces = Pieces(scores)
        self.tokens: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self._older: tuple[dict[str, int], dict[str, float]] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        self._children: dict[int, int] = {}
        self._scores, self._tokens, self._states = [0.0], [0], [self._pieces.start]

    def insert(self, word: str) -> tuple[int, float]:
        """The number of tokens of the word's best segmentation, and its score; of equal scores, the shortest last piece."""
        children, scores, tokens, states = self._children, self._scores, self._tokens, self._states
        path, node, start = [0], 0, self._pieces.start
        for char in word:
            key = node << 21 | ord(char)
            after = children.get(key)
            if after is None:
                state = states[node]
                below = state[0].get(char)
                while below is None and state is not start:
                    state = state[1]
                    below = state[0].get(char)
                state = start if below is None else below
                size = 1 if char < "\x80" else len(char.encode())
                best, count = scores[node] + size * BYTE_SCORE, tokens[node] + size
                for length, score in state[2]:
                    before = path[-length]
                    found = scores[before] + score
                    if found > best:
                        best, count = found, tokens[before] + 1
                after = children[key] = len(scores)
                scores.append(best)
                tokens.append(count)
                states.append(state)
            node = after
            path.append(node)
        return tokens[node], scores[node]

    def learn(self, words: set[str]) -> None:
        """Insert, with the word mark, what is not known yet.

        Before a slice of words the trie is dropped if it has more than ``MOST_NODES`` nodes, and of the results those
        that were not asked for while ``MOST_WORDS`` others were.
        """
        if len(self._scores) > MOST_NODES:
            self._reset()
        if len(self.tokens) > MOST_WORDS:
            self._older, self.tokens, self.score = (self.tokens, self.score), {}, {}
        older, old_score = self._older
        for word in sorted(words.difference(self.tokens)):
            count = older.get(word)
            self.tokens[word], self.score[word] = self.insert(WORD_START + word) if count is None else (count, old_score[word])


@functools.lru_cache(maxsize=2)
def _trie(pieces: tuple[tuple[str, float], ...]) -> Trie:
    return Trie(dict(pieces))


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """``doc_id, n_words, n_tokens, log_score`` for each row: words between white space, each with a leading word mark.

    Nothing is shuffled.  ``scores`` is a vocabulary of fixed size, told to every
    task.  Null and empty texts count 0; repeated rows stay.
    """
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(tuple(sorted(scores.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(told.value)
        for batch in batches:
            texts = whole(batch.column(1))
            for lo, hi in slices(texts):
                split = [text.split() for text in texts.slice(lo, hi - lo).to_pylist()]
                trie.learn(set().union(*split))
                tokens, score = trie.tokens.__getitem__, trie.score.__getitem__
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in split], pa.int64()), pa.array([sum(map(tokens, x)) for x in split], pa.int64()),
                     pa.array([float(sum(map(score, x))) for x in split], pa.float64())],
                    ["doc_id", "n_words", "n_tokens", "log_score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_score double")
