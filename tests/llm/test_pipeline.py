"""The pipeline's rows against its stages by brute force, and each stage on odd and empty tables."""

import base64
import gc
import hashlib
import re
import weakref
import zlib

import public_tokenizers
import pytest
import tiktoken
from test_documents import RANKS, SF, base_spans, brute_components, plain_words, texts_of

import corpus_pipeline
from cohortry.llm import bpe, decontaminate, pii, quality
from cohortry.llm.bytes import lean

COLUMNS = list(corpus_pipeline.COLUMNS)


def windows(items):
    out = set()
    for _, text in items:
        words = plain_words(text)
        size = min(10, len(words))
        out |= {tuple(words[k : k + size]) for k in range(len(words) - size + 1 if size else 0)}
    return out


_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def without(text, held):
    words, at = plain_words(text), [(m.start(), m.end()) for m in _WORD.finditer(text)]
    hit = {k + j for size in {len(w) for w in held} for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in held for j in range(size)}
    if hit and len(hit) == len(words):
        return None
    out, last = "", 0
    for k in sorted(hit):
        begin = at[k][0] if k - 1 not in hit else last
        out += text[last:begin]
        last = at[k][1]
    return out + text[last:]


def masked(text):
    out, last = "", 0
    for start, kind, end in base_spans(text):
        if start >= last:
            out += text[last:start] + f"[{pii.KINDS[kind].upper()}]"
        last = max(last, end)
    return out + text[last:]


def test_rows_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = [(r["doc_id"], r["text"]) for r in quality.score(docs, model).filter("score >= 0.7").collect()]
    kept = [(i, t) for (i, t), found in zip(sorted(scored), brute_components(sorted(scored)), strict=True) if found[2] == i]
    items = texts_of(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    held = windows(items)
    cut = [(i, without(t, held)) for i, t in kept]
    final = {i: masked(t) for i, t in cut if t is not None}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(final) and 0 < len(rows) < docs.count()
    for doc_id, text in final.items():
        assert rows[doc_id]["n_tokens"] == len(library.encode_ordinary(text))
        assert rows[doc_id]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("step", [step for _, step in corpus_pipeline.STAGES], ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, step):
    rows = [(1, "Some ordinary words in a line.\nAnother line.", "en", "s", 44), (2, None, None, None, None), (None, "x", "en", "s", 1), (3, "", "en", None, 0), (1, "Some ordinary words in a line.\nAnother line.", "en", "s", 44)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        out = step(spark, df, SF)
        assert out.count() <= df.count()
        if step is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == COLUMNS


def test_decontamination_needs_one_python_task_at_once(spark):
    """A second one in the same stage leaves idle Python workers behind, and each later fills its own caches."""
    rows = [(k, text, "en", "s", 1) for k, text in enumerate(["Say: the quick, brown fox! ran", None, "", "nothing of it", "THE quick\xa0brown fox", "é the quick brown fox, the quick brown fox é"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    out = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    bench = spark.createDataFrame([(7, "the quick brown fox"), (8, "ran")], "item_id long, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 130):
        found = decontaminate.find(docs, bench, block_bytes)
        cut = decontaminate.find(docs, bench, block_bytes, cut=True)
        parts = decontaminate.without_hits(found)
        assert cut.select(parts.columns).collect() == parts.collect()
        assert cut.select("n_words", "word_hits", "items").collect() == found.select("n_words", "word_hits", "items").collect()
    assert [r["removed"] for r in cut.collect()] == [25, 0, 0, 0, 0, 40]


def test_stages_are_the_named_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE encoding and decoding"]
    assert zlib.crc32(b"1") % 4 in range(4)


def test_tokens_leave_no_encoder_in_the_workers(spark, monkeypatch):
    """Idle workers outnumber the cores, so that encoders kept between tasks would add up in an executor."""

    def kept(*_):
        raise AssertionError("an encoder that outlives its task")

    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string")
    before = bpe.digests(bpe.encode(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN, decoded=True)).collect()
    monkeypatch.setattr(bpe, "_encoder", kept)
    assert corpus_pipeline.byte_level_bpe(spark, docs, SF).collect() == before


def test_lean_tasks_give_back_what_only_the_collector_frees():
    class Held:
        pass

    seen = []

    def run(batches):
        held = Held()
        held.itself = held
        seen.append(weakref.ref(held))
        gc.freeze()
        yield from batches

    assert list(lean(run)(iter([1, 2]))) == [1, 2] and seen[0]() is None
