"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

For every prefix of a piece the BPE encoding has one last token, and a sequence
of tokens is an encoding exactly if each neighbouring pair is the encoding of
its own bytes.  A state is therefore the last emitted token and the bytes not yet
emitted.  While those bytes begin a vocabulary entry nothing can be emitted, so
such states are shared by all last tokens.  Beyond that, what is emitted depends
on the last token only through which first tokens may follow it, and states that
agree on these are one.  When all places where a later token may still begin
share the first tokens of their chains, the transducer emits them: it never looks
further ahead than the longest vocabulary entry.  States and transitions are made
when a text first needs them; when a task has as many as it may keep, all are
dropped and made anew as needed.  The tokens that end at a place are found by one
automaton over the vocabulary.
"""

from __future__ import annotations

import base64
import codecs
import functools
import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.bytes import lean, slices, whole
from cohortry.session import ship_package

# Bounds of what a task keeps between pieces; states and their transitions are counted together.
MOST_STATES = 300_000
MOST_PAIRS = 400_000
MOST_PIECES = 250_000
LONGEST_KEPT_PIECE = 48

# White space as the public tokenizers' own matcher takes it (fixed values); Python's \s also takes U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def matcher(pattern: str) -> regex.Pattern:
    """Compile a splitting pattern with the white space above."""
    inside = regex.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace("\\s", SPACE), pattern)
    return regex.compile(inside.replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read on the driver to be sent to the tasks."""
    with open(path, "rb") as file:
        return file.read()


class _Suffix(dict):
    """The longest end of some bytes that begins a vocabulary entry; as a dictionary, the entries' next bytes.

    ``link``: the next shorter such end.  ``rank``: of the entry these bytes are, or -1.  ``ends``: size and rank of all
    reachable tokens that end here.  ``open``: sizes of these ends that an entry goes beyond.
    """

    __slots__ = ("depth", "link", "rank", "ends", "open")

    def __init__(self, depth: int):
        self.depth, self.link, self.rank, self.ends, self.open = depth, None, -1, None, None


_NO_TOKEN = -2
_UNSEEN: tuple[int, ...] = ()


class _State(dict):
    """Bytes not yet emitted, with the tokens that may begin them; as a dictionary, the states after one byte more.

    ``up``: the state without the last byte.  ``last``: the token that ends here; ``back``: the state where it begins.
    ``rank``: of the entry that all these bytes are, or -1.  Where there is one, this state stands for the last tokens that
    it may follow, ``other`` for those that it may not.  ``emitted``: what is emitted here, None for nothing, with
    ``target``, the state of what is held then; ``_UNSEEN`` until a text comes here.
    """

    __slots__ = ("up", "depth", "suffix", "last", "back", "rank", "other", "emitted", "target")

    def __init__(self, up: _State | None, suffix: _Suffix):
        self.up, self.suffix, self.depth = up, suffix, 0 if up is None else up.depth + 1
        self.last, self.back, self.rank, self.other, self.target = _NO_TOKEN, None, -1, None, None
        # While the bytes begin a longer entry, nothing can be emitted.
        self.emitted = None if suffix.depth == self.depth and suffix else _UNSEEN


class Transducer:
    """From the bytes of one piece to its tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self._own: dict[int, bool] = {}
        self._made: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self.start = _State(None, self._suffixes())
        self._states: list[_State] = []

    def _suffixes(self) -> _Suffix:
        start = _Suffix(0)
        for token, rank in self.ranks.items():
            state = start
            for depth, byte in enumerate(token, 1):
                after = state.get(byte)
                if after is None:
                    after = state[byte] = _Suffix(depth)
                state = after
            state.rank = rank
        start.ends, start.open = (), ()
        level = [start]
        while level:
            below = []
            for state in level:
                for byte, after in state.items():
                    after.link = start if state is start else self._after(state.link, byte)
                    below.append(after)
            level = below
        return start

    @staticmethod
    def _after(state: _Suffix, byte: int) -> _Suffix:
        while True:
            found = state.get(byte)
            if found is not None:
                return found
            if state.link is None:
                return state
            state = state.link

    def _look(self, state: _Suffix) -> None:
        """Fill ``ends`` and ``open`` of a state, longest first."""
        link = state.link
        if link.ends is None:
            self._look(link)
        state.ends = ((state.depth, state.rank), *link.ends) if state.rank >= 0 and self._reachable(state.rank) else link.ends
        state.open = (state.depth, *link.open) if state else link.open

    def merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """Lowest rank first, leftmost first, down to ``least`` parts; for pieces of a few tokens."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > least:
            best = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _reachable(self, rank: int) -> bool:
        found = self._own.get(rank)
        if found is None:
            token = self.bytes[rank]
            found = self._own[rank] = self.merge(token) == [token]
        return found

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a single byte."""
        found = self._made.get(rank, ())
        if found == ():
            parts = self.merge(self.bytes[rank], 2)
            found = self._made[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return found

    def _follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between the two tokens alone.

        The merges on both sides are undone, latest first.  At each moment the
        two neighbours of the border must not have had an earlier merge open.
        """
        if a < 0:
            return True
        key = a << 32 | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > MOST_PAIRS:
                self._pairs.clear()
            undone, found = (1 << 60, 0), True
            while True:
                joined = self.ranks.get(self.bytes[a] + self.bytes[b])
                # A merge across the border comes before one of equal rank on its right, not before one on its left.
                if joined is not None and (joined, 0) < undone:
                    found = False
                    break
                left, right = self._halves(a), self._halves(b)
                if left is None and right is None:
                    break
                if right is None or left is not None and a > b:
                    undone, a = (a, 0), left[1]
                else:
                    undone, b = (b, 1), right[0]
            self._pairs[key] = found
        return found

    def _grow(self, state: _State, byte: int) -> _State:
        """The state after one byte more; if all that is held is an entry, the one for last tokens that it may follow."""
        suffix = self._after(state.suffix, byte)
        if suffix.ends is None:
            self._look(suffix)
        after = state[byte] = _State(state, suffix)
        self._states.append(after)
        ends = suffix.ends
        if ends and ends[0][0] == after.depth:
            after.rank = after.last = ends[0][1]
            after.back = self.start
        else:
            self._end(after, ends)
        return after

    def _refuse(self, state: _State) -> _State:
        """The state of the same bytes for last tokens that the entry may not follow."""
        other = state.other = _State(state.up, state.suffix)
        self._states.append(other)
        self._end(other, state.suffix.ends[1:])
        return other

    def _end(self, state: _State, ends: tuple[tuple[int, int], ...]) -> None:
        """Find the token that ends here, of these that begin after the first held byte."""
        if not ends:
            return
        pairs, way = self._pairs, [state]
        for _ in range(ends[0][0]):
            way.append(way[-1].up)
        for size, rank in ends:
            left = way[size].last
            if left != _NO_TOKEN:
                found = pairs.get(left << 32 | rank)
                if found or found is None and self._follows(left, rank):
                    state.last, state.back = rank, way[size]
                    return

    @staticmethod
    def _chain(state: _State) -> list[_State]:
        """The states where the tokens that lead to this one end, in order."""
        places = []
        while state.depth:
            places.append(state)
            state = state.back
        places.reverse()
        return places

    def _move(self, state: _State, byte: int, before: int) -> _State:
        """The state after one byte more, when ``before`` was emitted last."""
        after = state.get(byte)
        if after is None:
            after = self._grow(state, byte)
        if after.rank >= 0 and not self._follows(before, after.rank):
            after = self._refuse(after) if after.other is None else after.other
        return after

    def _settle(self, state: _State, held: bytes) -> tuple[int, ...] | None:
        """What all places share where a later token may still begin is emitted; ``held``: the bytes of the state."""
        if len(self._states) >= MOST_STATES:
            self._drop(state)
        state.emitted, size = None, state.depth
        shared = self._chain(state)
        for k in state.suffix.open:
            place = state
            for _ in range(k):
                place = place.up
            if place.last != _NO_TOKEN:
                same = 0
                for a, b in zip(shared, self._chain(place), strict=False):
                    if a is not b:
                        break
                    same += 1
                del shared[same:]
                if not shared:
                    return None
        state.emitted = tuple([place.last for place in shared])
        target, before = self.start, state.emitted[-1]
        for byte in held[len(held) - size + shared[-1].depth :]:
            target = self._move(target, byte, before)
        state.target = target
        return state.emitted

    def _drop(self, state: _State) -> None:
        """Forget all states but this one and those that lead to it; without links down there are no cycles."""
        for old in self._states:
            old.clear()
            old.other = old.target = None
            old.emitted = old.emitted and _UNSEEN
        self.start.clear()
        self._states = [state]
        gc.unfreeze()
        gc.collect()

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece, in one pass."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        pairs, state, before, out = self._pairs, self.start, -1, []
        for at, byte in enumerate(piece, 1):
            after = state.get(byte)
            if after is None:
                after = self._grow(state, byte)
            rank = after.rank
            if rank >= 0 and before >= 0:
                found = pairs.get(before << 32 | rank)
                if not found and (found is not None or not self._follows(before, rank)):
                    after = self._refuse(after) if after.other is None else after.other
            emitted = after.emitted
            if emitted is None:
                state = after
                continue
            if emitted is _UNSEEN:
                emitted = self._settle(after, piece[at - after.depth : at])
            if emitted:
                out += emitted
                before, state = emitted[-1], after.target
            else:
                state = after
        return out + [place.last for place in self._chain(state)]


def read_table(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}


class Encoder:
    """Whole texts: each match of the pattern goes through the transducer by itself; frequent ones are remembered."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.transducer, self.pieces = Transducer(read_table(rank_file)), matcher(pattern)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers in this machine's order."""
        split = [self.pieces.findall(text) for text in texts]
        if len(self._known) > MOST_PIECES:
            self._older, self._known = self._known, {}
        known, older, encode = self._known, self._older, self.transducer.encode
        long: dict[str, bytes] = {}
        gc.disable()  # none of the many states made here is garbage before all are dropped, so the collector never visits them
        try:
            # In order, so that pieces that begin alike find the same states near each other.
            for piece in sorted(set().union(*split).difference(known)):
                ids = older.get(piece)
                if ids is None:
                    ids = array("i", encode(piece.encode())).tobytes()
                (known if len(piece) <= LONGEST_KEPT_PIECE else long)[piece] = ids
        finally:
            gc.freeze()
            gc.enable()
        if not long:
            return [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        return [b"".join([known.get(piece) or long[piece] for piece in pieces]) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_all([text])[0]).tolist()


class Decoder:
    """Tokens in, text out as soon as its code points are complete; the rest waits for the next tokens."""

    def __init__(self, table: dict[int, bytes]):
        self.table = table
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        table = self.table
        return self._utf8.decode(b"".join([table[k] for k in ids]), last)


@functools.lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, decoded: bool = False, kept: bool = True) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row of ``docs``, with ``decoded`` also ``text``, decoded from the ids.

    The rank file (about 1 MB, whatever the input) goes to the tasks as it is.
    Null and empty texts have no ids and decode to the empty text.  Other columns
    are not read; repeated rows stay.  With ``kept`` a worker keeps its encoder for its
    next tasks; else each task makes one and gives its memory back, which other steps on
    the same executors need.
    """
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*told.value) if kept else None
        for batch in batches:
            if encoder is None:
                encoder = Encoder(*told.value)
            texts = whole(batch.column(1))
            for lo, hi in slices(texts):
                ids = encoder.encode_all(texts.slice(lo, hi - lo).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                columns, names = [batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "ids"]
                if decoded:
                    columns.append(_decoded(lists, encoder.transducer.bytes))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run if kept else lean(run), "doc_id long, ids array<int>" + ", text string" * decoded)


def _decoded(column: pa.ListArray, table: dict[int, bytes]) -> pa.Array:
    """The text of each row's ids, fed in blocks to a streaming decoder; null ids give null."""
    texts = []
    for ids in column:
        if not ids.is_valid:
            texts.append(None)
            continue
        decoder, values = Decoder(table), ids.values.to_numpy()
        blocks = [decoder.feed(values[k : k + 65536].tolist()) for k in range(0, len(values), 65536)]
        texts.append("".join(blocks) + decoder.feed([], True))
    return pa.array(texts, pa.string())


@functools.lru_cache(maxsize=2)
def _bytes(rank_file: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in read_table(rank_file).items()}


def decode(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """``doc_id, ids, text`` from ``doc_id, ids``; an id outside the vocabulary is an error."""
    ship_package(encoded.sparkSession)
    told = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(1), _bytes(told.value))], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` from ``doc_id, ids, text``."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
