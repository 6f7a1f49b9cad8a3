"""Token ids in directly addressable codes, written in document order and read back.

Ids are cut into chunks of ``CHUNK`` bits.  A level holds one chunk of every id
that reaches it and a bitmap of those that go on; a directory holds the number
of set bits before each block of the bitmap.  The chunk of id ``i`` on the next
level stands at the rank of bit ``i``, so any id is read from as many places as it
has chunks, without decoding its neighbours.

A file is a Parquet table of segments.  A segment holds whole documents: their
ids, sizes and one code over all their tokens.  ``bucket`` and ``part`` give the
order of segments, which is the ascending order of ``doc_id``.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.bytes import slices, whole
from cohortry.session import ship_package

CHUNK = 8
BLOCK = 512
# A segment is closed when it holds so many tokens (a longer document is one segment).
SEGMENT_TOKENS = 1 << 20
# Texts are encoded in slices of about this many bytes: each of a slice's words is looked up once.
SLICE_BYTES = 8 << 20
# What a task remembers of the tokens of distinct words, twice over.
MOST_WORDS = 350_000

SEGMENT = "bucket int, part int, n_docs long, n_tokens long, doc_ids binary, sizes binary, code array<binary>"
_ROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                  ("doc_ids", pa.binary()), ("sizes", pa.binary()), ("code", pa.list_(pa.binary()))])
_NO_ID = np.iinfo(np.int64).min


def pack(ids: np.ndarray) -> list[bytes]:
    """Three byte strings for each level: chunks, bitmap of ids that go on, rank directory."""
    rest, out = ids.astype(np.uint32), []
    while len(rest) or not out:
        on = rest >> np.uint32(CHUNK) > 0
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, np.uint8)
        bits[: len(rest)] = on
        before = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(1, dtype=np.uint64))]).astype("<u8")
        out += [(rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), before.tobytes()]
        rest = rest[on] >> np.uint32(CHUNK)
    return out


def unpack(code: list[bytes]) -> np.ndarray:
    """All ids of a code."""
    ids: np.ndarray = np.zeros(0, np.uint32)
    for level in reversed(range(0, len(code), 3)):
        here = np.frombuffer(code[level], np.uint8).astype(np.uint32)
        on = np.unpackbits(np.frombuffer(code[level + 1], np.uint8), bitorder="little")[: len(here)].astype(bool)
        here[on] |= ids << np.uint32(CHUNK)
        ids = here
    return ids


def access(code: list[bytes], place: int) -> int:
    """The id at one place, from one chunk a level."""
    found, shift = 0, 0
    for level in range(0, len(code), 3):
        chunks, bits, before = code[level : level + 3]
        if not 0 <= place < len(chunks):
            raise IndexError(place)
        found |= chunks[place] << shift
        if not bits[place >> 3] >> (place & 7) & 1:
            break
        block = place // BLOCK
        inside = int.from_bytes(bits[block * BLOCK // 8 : (place >> 3) + 1], "little") & ((1 << place % BLOCK) - 1)
        place = int.from_bytes(before[8 * block : 8 * block + 8], "little") + inside.bit_count()
        shift += CHUNK
    return found


# White space as the tokenizer takes it (fixed values); Python also takes U+001C to U+001F.
_SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


_CLOSING = ".,;:!?"


def _parts(word: str) -> tuple[str, ...]:
    """A closing mark after a letter or digit is a token run of its own; case does not matter to the tokenizer."""
    if word.isascii():
        word = word.lower()
        return (word[:-1], word[-1]) if word[-1] in _CLOSING and word[-2:-1].isalnum() else (word,)
    # As the tokenizer sees it, normalised and in lower case, some letters end in a mark that would join what follows.
    if word[-1] in _CLOSING and unicodedata.normalize("NFC", word[-2]).lower().isalnum():
        return (*_parts(word[:-1]), word[-1])
    return (word.lower() if _PLAIN.fullmatch(word) else word,)


# Letters that are composed already and have one lower-case letter each, whatever follows.
_PLAIN = regex.compile("[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
# Words of such letters, digits and marks, and their runs in lower case (the split pattern below, for these characters).
_SIMPLE = regex.compile("[!-~\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_RUN = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\\[-`{-~]+")
# What a tokenizer does before its merges if a run of such characters, in lower case, reaches them as its bytes (fixed values).
_LETTERS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
# Byte-level vocabularies write a byte as a character: visible ones as themselves, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {byte: 0x100 + k for k, byte in enumerate(sorted(set(range(256)).difference(_VISIBLE)))}


def _reaches_merges(spec: dict) -> bool:
    steps = [(spec.get(kind) or {}).get(inner, []) for kind, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    if tuple([x["type"] for x in found] for found in steps) != _LETTERS[:2]:
        return False
    split, level = steps[1]
    return split["pattern"] == {"Regex": _LETTERS[2]} and not level["add_prefix_space"] and not level["use_regex"]


class WordEncoder:
    """A tokenizer that drops case and white space and splits there, so each word between spaces is encoded once and remembered.

    The runs of a word of plain letters, digits and marks go to its merges at once, every other word through all its steps.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer)
        self._added = sorted({x.content.lower() for x in self._tokenizer.get_added_tokens_decoder().values()})
        self._merges = self._tokenizer.model if _reaches_merges(json.loads(tokenizer)) else None
        self._known: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}

    def _holds_added(self, text: str) -> bool:
        """The tokenizer finds added tokens' contents before it drops case: a word that holds one in any case is left as it is."""
        lower = text.lower()
        return any(content in lower for content in self._added)

    def _run(self, run: str) -> bytes:
        """The ids of one run; also remembered as a word."""
        found = self._known.get(run)
        if found is None:
            held = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_CHARS)
            found = self._known[run] = array("I", [x.id for x in self._merges.tokenize(held)]).tobytes()
        return found

    def _learn(self, new: list[str]) -> None:
        known, run, others, odd = self._known, self._run, {}, self._holds_added("\0".join(new))
        for word in new:
            simple = word.isprintable() if word.isascii() else _SIMPLE.fullmatch(word)
            if not simple or self._merges is None or odd and self._holds_added(word):
                others[word] = [part for each in _SPACE.split(word) if each for part in ((each,) if odd and self._holds_added(each) else _parts(each))]
                continue
            low = word.lower()
            if low.isalpha():
                known[word] = run(low)
            elif low[:-1].isalpha():
                known[word] = run(low[:-1]) + run(low[-1])
            else:
                known[word] = b"".join(map(run, _RUN.findall(low)))
        asked = list({part for parts in others.values() for part in parts}.difference(known))
        for part, found in zip(asked, self._tokenizer.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            known[part] = array("I", found.ids).tobytes()
        for word, parts in others.items():
            known[word] = b"".join([known[part] for part in parts])

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """The ids of each text with the end id, as little-endian 32-bit numbers."""
        split = pc.ascii_split_whitespace(texts)  # other white space stays in its word until that is learnt
        words = split.flatten().dictionary_encode()
        if len(self._known) > MOST_WORDS:
            self._older, self._known = self._known, {"": b""}
        known, older, new = self._known, self._older, []
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        for word in distinct:
            if word not in known:
                found = older.get(word)
                if found is None:
                    new.append(word)
                else:
                    known[word] = found
        if new:
            self._learn(new)
        ids = pa.array(list(map(known.__getitem__, distinct)), pa.large_binary()).take(words.indices)
        places = ids.buffers()
        ends = np.frombuffer(places[1], np.int64)[ids.offset : ids.offset + len(ids) + 1][np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        data, last = memoryview(places[2]) if places[2] is not None else memoryview(b""), array("I", [end]).tobytes()
        return [b"".join((data[a:b], last)) for a, b in zip(ends, ends[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer: str) -> WordEncoder:
    return WordEncoder(tokenizer)


def _segment(bucket: int, part: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    sizes = np.array([len(x) // 4 for x in ids], "<i8")
    names = np.array([_NO_ID if x is None else x for x in doc_ids], "<i8")
    code = pack(np.frombuffer(b"".join(ids), "<u4"))
    values = [[bucket], [part], [len(ids)], [int(sizes.sum())], [names.tobytes()], [sizes.tobytes()], [code]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _ROW, strict=True)], schema=_ROW)


def write(docs: DataFrame, tokenizer: str, end: int, path: str) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write segments in ascending ``doc_id`` order to ``path``.

    ``tokenizer`` is the tokenizer's JSON, at most a few MB whatever the input.
    It must drop case and white space, never join what white space divides, and
    keep a closing mark apart from the letters before it.  Its added tokens (those
    with an entry of their own, such as an end mark) are found as the library does
    by default, wherever a text holds their content.  Texts are
    shuffled once, by range of ``doc_id``.  Null texts are empty and get the end
    id alone; null ids come first; equal ids follow each other by text.
    """
    ship_package(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast((tokenizer, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(told.value[0]), told.value[1]
        bucket, part, names, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            texts = whole(batch.column(1))
            for lo, hi in slices(texts, SLICE_BYTES):
                found = encoder.encode(texts.slice(lo, hi - lo), last)
                for name, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), found, strict=True):
                    if n and n + len(ids) // 4 > SEGMENT_TOKENS:
                        yield _segment(bucket, part, names, held)
                        part, names, held, n = part + 1, [], [], 0
                    names.append(name)
                    held.append(ids)
                    n += len(ids) // 4
        if held:
            yield _segment(bucket, part, names, held)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The written segments with ``start``, the number of ids before each.

    Sums over one bucket are windows of that bucket; over buckets (as many as
    the writing job had tasks), one window.
    """
    rows = spark.read.schema(SEGMENT).parquet(path)
    sums = rows.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("bucket_start"))
    within = rows.select("bucket", "part", "n_tokens").select(
        "bucket", "part", (F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n_tokens")).alias("part_start")
    )
    starts = within.join(before, "bucket").select("bucket", "part", (F.col("bucket_start") + F.col("part_start")).alias("start"))
    return rows.join(F.broadcast(starts) if _is_small(starts) else starts, ["bucket", "part"])


def _is_small(starts: DataFrame, most: int = 1 << 18) -> bool:
    """At most about 8 MB: 32 bytes a row."""
    return starts.count() <= most


def read(found: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian 32-bit numbers) of each document in a table of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, sizes, code, start = (batch.column(k)[row].as_py() for k in ("doc_ids", "sizes", "code", "start"))
                names, sizes = np.frombuffer(doc_ids, "<i8"), np.frombuffer(sizes, "<i8")
                ends = np.cumsum(sizes)
                ids = unpack(code).astype("<u4")
                for lo in range(0, len(names), 256):
                    hi = min(len(names), lo + 256)
                    parts = [ids[a:b].tobytes() for a, b in zip((ends - sizes)[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[lo:hi], mask=names[lo:hi] == _NO_ID), pa.array(start + (ends - sizes)[lo:hi]), pa.array(sizes[lo:hi]), pa.array(parts, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return found.select("doc_ids", "sizes", "code", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    """The same checksum outside Spark."""
    return zlib.crc32(ids.astype("<u4").tobytes())
