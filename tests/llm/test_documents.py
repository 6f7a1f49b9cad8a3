"""The operators on documents against brute force and exact round trips, on odd rows and on the given tables."""

import base64
import gc
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import bpe, dac, decontaminate, fingerprints, language, licences, pii, quality, queries, token_counts
from cohortry.llm.components import components
from cohortry.llm.jaccard import jaccard_components, keep_one, long_lists, may_link, merged_lists, overlap

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, score double, part int, removed string, h long, `_id` string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns that clash with names used inside."""
    long = " ".join(f"word{k % 977} and" for k in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. " * 3), (1, "The quick brown fox jumps over the lazy dog. " * 3),
        (2, None), (3, ""), (4, " \n\t "), (None, "Mail ann@example.org today"), (None, None), (5, long), (6, long + " end"),
        (7, "日本語 \U0001f600 naïve İstanbul \x1c odd\x1fspace"), (7, "another text under a used id"),
        (8, "a" * 20_000), (9, "\n".join(["same line here"] * 50)), (10, "one"), (11, "one"),
    ]
    return spark.createDataFrame([(i, t, None, 3, None, 7, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- near duplicates
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def brute_components(rows):
    sets, lists, parent = {}, defaultdict(list), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, text) in enumerate(rows):
        sets[k], parent[k] = shingles(text), k
        for s in sets[k]:
            lists[s].append(k)
    for k in sets:
        shared = defaultdict(int)
        for s in sets[k]:
            for other in lists[s]:
                if other < k:
                    shared[other] += 1
        for other, n in shared.items():
            if 100 * n >= 80 * (len(sets[k]) + len(sets[other]) - n):
                a, b = sorted((root(k), root(other)), key=lambda x: rows[x][0])
                parent[b] = a
    return sorted((rows[k][0], len(sets[k]), rows[root(k)][0]) for k in sets)


def found_components(df, **more):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, **more).collect())


def test_components_match_brute_force(documents):
    assert found_components(documents) == brute_components(texts_of(documents))


def variants(seed, n):
    """Near copies of one text with borderline likeness, and short texts that share most shingles."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        words = base[: rng.choice((60, 60, 58, 50))]
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            words = [*words]
            words[rng.randrange(len(words))] = f"x{rng.randrange(4)}"
        rows.append((k, " ".join(words)))
    return rows + [(n + k, " ".join(base[: 3 + k % 4])) for k in range(8)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_large_groups_lose_no_link(spark, rounds):
    rows = variants(rounds, 150)
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hub_rounds=rounds) == brute_components(rows)


def one_shared_list():
    """Texts of nine shingles each: a, b and c are merged in one common list only, where it stands first; b and c link, a with nobody."""
    import pyarrow as pa

    from cohortry.llm.jaccard import shingle_sets

    rng = random.Random(11)

    def merged(words):
        return next(shingle_sets(pa.array([" ".join(words)])))[: merged_lists(9)].tolist()

    while True:
        base = [f"v{rng.randrange(10**6)}" for _ in range(12)]
        near = [[*base, f"z{k}"] for k in range(60)]
        firsts = [merged(words) for words in near]
        hot = next(shingle_sets(pa.array([" ".join(base)])))[0]
        alone = [words for words, (first, second) in zip(near, firsts, strict=True) if first == hot and sum(second in f for f in firsts) == 1]
        if len(alone) >= 2:
            break
    five = next(words for k in range(8) if next(shingle_sets(pa.array([" ".join(words := base[k : k + 5])])))[0] == hot)
    other = next(words for k in range(1000) if merged(words := [*five, *[f"y{k}x{j}" for j in range(8)]])[0] == hot)
    return [" ".join(words) for words in (other, *alone[:2])]


@pytest.mark.parametrize("rounds", [1, 3])
def test_a_hub_without_links_does_not_end_the_search(spark, rounds):
    """The first hub of the only common list links with nobody, two other members do."""
    ids = [r["i"] for r in spark.range(3).select(F.col("id").alias("i")).orderBy(F.xxhash64("i", F.lit(0))).collect()]
    rows = list(zip(ids, one_shared_list(), strict=True))
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 2
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string"), hub_rounds=rounds) == want


def test_component_operator_on_odd_rows(odd, nothing):
    found = jaccard_components(odd).collect()
    assert len(found) == 15
    by = defaultdict(set)
    for r in found:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[10] == {(1, 10)} and by[11] == {(1, 10)}
    assert {c for _, c in by[5] | by[6]} == {5} and {c for _, c in by[None]} == {None} and by[7] == {(2, 7)}
    kept = [r["doc_id"] for r in keep_one(odd).collect()]
    assert 11 not in kept and 6 not in kept and kept.count(None) == 2 and set(kept) == {None, 1, 2, 3, 4, 5, 7, 8, 9, 10}
    assert jaccard_components(nothing).isEmpty() and keep_one(nothing).columns == nothing.columns


@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1))
@settings(max_examples=60, deadline=None)
def test_bound_and_probe(a, b):
    from cohortry.llm.bytes import mix
    from cohortry.llm.jaccard import _packed, _parity

    x, y = (np.sort(mix(np.array(sorted(s), np.uint64))) for s in (a, b))
    assert overlap(_packed(x), _packed(y)) == len(a & b)
    if 9 * len(a & b) >= 4 * (len(a) + len(b)):
        assert may_link(_parity(x), _parity(y), len(a) + len(b))


def test_merged_lists():
    for n in range(1, 300):
        least = -(-4 * n // 5)
        assert merged_lists(n) == n - least + 1


def test_long_lists_are_bounded(spark):
    df = spark.createDataFrame([(list(range(1, 9)),)] * 5 + [([9],)], "tops array<int>")
    keys, sizes = long_lists(df, 2, 3)
    assert keys.tolist() == [1, 2, 3] and sizes.tolist() == [5, 5, 5]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 90)] + [(200, 200 + k) for k in range(1, 80)] + [(500, 501), (501, 500), (7, 7)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(91)} | {k: 200 for k in range(200, 280)} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# ---------------------------------------------------------------- tokens
@pytest.fixture(scope="module")
def encoders():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), library


def test_pieces_match_the_library(encoders, monkeypatch):
    mine, library = encoders
    rng = random.Random(8)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "thersonaied ", "éèü日本語рус ", "0123456789 .,!?'\n\t  ", "aab"]
    some = ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(60))) for _ in range(3000)] + ["ab" * 30_000, "　 \x1c\x1f", "<|endoftext|>"]
    want = [library.encode_ordinary(text) for text in some]
    assert [mine.encode(text) for text in some] == want
    monkeypatch.setattr(bpe, "MOST_STATES", 2_000)  # states are dropped again and again
    monkeypatch.setattr(bpe, "MOST_PIECES", 10)
    small = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    assert [small.encode(text) for text in some] == want


def test_dropped_states_need_no_collector(encoders, monkeypatch):
    """States are freed as soon as they are dropped, and the collector never walks over those that are kept."""
    monkeypatch.setattr(bpe, "MOST_STATES", 500)
    small = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("thersonaidßé", k=rng.randrange(4, 14))) for _ in range(400)) for _ in range(10)]
    held = lambda: sum(type(x) is bpe._State for x in gc.get_objects())
    gc.unfreeze()
    gc.collect()
    before = held()
    assert small.encode_all(texts) and not held() > before
    monkeypatch.setattr(bpe.gc, "collect", lambda: 0)
    want = [encoders[1].encode_ordinary(text) for text in texts]
    assert [np.frombuffer(ids, np.int32).tolist() for ids in small.encode_all([text.upper() for text in texts] + texts)[10:]] == want
    gc.unfreeze()
    assert held() - before < 1_000


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_round_trip(encoders, text):
    mine, library = encoders
    ids = mine.encode(text)
    decoder = bpe.Decoder(mine.transducer.bytes)
    assert ids == library.encode_ordinary(text)
    assert "".join(decoder.feed([k]) for k in ids) + decoder.feed([], True) == text


def test_byte_bpe_query(spark, documents, odd, nothing, encoders):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op8_byte_bpe"](spark, SF).collect()}
    for doc_id, text in texts_of(documents):
        ids = encoders[1].encode_ordinary(text or "")
        r = rows[doc_id]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, bpe.read_ranks(RANKS), public_tokenizers.PATTERN), bpe.read_ranks(RANKS))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=key) == sorted(((i, t or "") for i, t in texts_of(odd)), key=key)
    assert bpe.encode(nothing, bpe.read_ranks(RANKS), public_tokenizers.PATTERN).isEmpty()


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip_and_random_access(ids):
    code = dac.pack(np.array(ids, np.uint32))
    assert dac.unpack(code).tolist() == ids
    for place in {0, 1, 7, 8, 511, 512, 513, len(ids) - 1} & set(range(len(ids))):
        assert dac.access(code, place) == ids[place]
    with pytest.raises(IndexError):
        dac.access(code, len(ids))


def check_codes(rows, df, monkey=None):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.orderBy("start").collect()]
    assert got == want


def test_token_code_query(spark, documents):
    check_codes(texts_of(documents), queries.QUERIES["op6_token_codes"](spark, SF))


def test_token_codes_of_odd_rows(spark, odd, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", 20)
    tokenizer = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    for name, df in (("odd", odd), ("none", nothing)):
        dac.write(df, tokenizer, 1, str(tmp_path / name))
        check_codes(texts_of(df), dac.checksums(dac.read(dac.segments(spark, str(tmp_path / name)))))


def test_words_of_letters_digits_and_marks_go_to_the_merges():
    """Their runs skip the tokenizer's other steps, whatever stands between them; ids are the library's."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), dac.WordEncoder(open(path, encoding="utf-8").read())
    rng = random.Random(6)
    some = ["whst$$$ que,ks", "Don't 'S !'s we've...", "x1y22.", "ÉÀß&&& élan's", "\xa0a\x85b\u3000c", "a\x1cb", "", " \n", "µª²½×÷ ﬁ Σς İ", "日本語. x"]
    some += ["".join(rng.choices("aBé, .'st1$\xa0\x1c\u0301ß²", k=rng.randrange(30))) for _ in range(3000)]
    asked = []

    class Told:
        def encode_batch_fast(self, words, **rest):
            asked.extend(words)
            return library.encode_batch_fast(words, **rest)

    mine._tokenizer = Told()
    column = pa.array(["of other rows", *some, "too"])
    got = [np.frombuffer(ids, "<u4").tolist() for ids in mine.encode(column.slice(1, len(some)), 1)]
    assert got == [[*library.encode(text, add_special_tokens=False).ids, 1] for text in some]
    assert "日本語" in asked and {"whst$$$", "que,ks", "don't", "'s", "éàß&&&"}.isdisjoint(word.lower() for word in asked)


def test_added_tokens_are_found_as_the_library_does(spark, tmp_path):
    """Texts that hold the added tokens' contents, against the library as it comes."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [
        "a <|endoftext|> b", "a <|startoftext|>b, C", "x<|endoftext|>. y", "Word<|endoftext|>Word! <|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>x.",
        "<|startoftext|><|endoftext|>", "<|endoftext|>é. <|endoftext|>\u0301?", "<| endoftext|> <|endoftext|", "plain words, no marks.", "A <|ENDOFTEXT|> a <|endoftext|>",
    ]
    dac.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), open(path, encoding="utf-8").read(), 1, str(tmp_path / "added"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in dac.read(dac.segments(spark, str(tmp_path / "added"))).collect()}
    assert got == {k: [*library.encode(text, add_special_tokens=False).ids, 1] for k, text in enumerate(texts)}
    assert got[0] == [320, 49407, 321, 1]


def test_trie_counts_match_plain_search(spark, odd, nothing):
    scores = token_counts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))
    longest = max(map(len, scores))

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            here = (best[end - 1][0] + size * token_counts.BYTE_SCORE, best[end - 1][1] + size)
            for start in range(max(0, end - longest), end):
                if word[start:end] in scores and best[start][0] + scores[word[start:end]] > here[0]:
                    here = (best[start][0] + scores[word[start:end]], best[start][1] + 1)
            best.append(here)
        return best[-1]

    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for df in (documents, odd, nothing):
        want = []
        for doc_id, text in texts_of(df):
            found = [plain(token_counts.WORD_START + word) for word in (text or "").split()]
            want.append((doc_id or -1, len(found), sum(n for _, n in found), round(sum(s for s, _ in found), 3)))
        got = [(r["doc_id"] or -1, r["n_words"], r["n_tokens"], round(r["log_score"], 3)) for r in token_counts.count_tokens(df, scores).collect()]
        assert sorted(got) == sorted(want)


# ---------------------------------------------------------------- fingerprints
def test_fingerprint_query(spark, documents):
    rows = sorted(texts_of(documents))
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_consistent_parsing"](spark, SF).collect()}
    assert len(got) == len(rows)
    own = {}
    for k, (doc_id, text) in enumerate(rows):
        after, half, r = rows[(k + 1) % len(rows)][1], len(text) // 2, got[doc_id]
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.fingerprints([text])[0] and r["edited_fingerprint"] == fingerprints.fingerprints([edited])[0]
        assert own.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"])
        if text != after and len(text) > 300 and not shingles(text) & shingles(after):
            assert r["near_edited"] > r["near_next"]
    assert len(set(own.values())) == len(own)


def test_phrases_do_not_depend_on_the_offset():
    rng = random.Random(2)
    shared = "".join(rng.choices("abcdefg ", k=3000))
    for start in (1, 17, 400):
        a, b = fingerprints.fingerprints([shared, "".join(rng.choices("hijklmn ", k=start)) + shared])
        assert fingerprints.likeness(a, b) > 0.75
    runs = ["", "a", "aa", "a" * 1000, "ab" * 500, "a" * 999]
    assert len(set(fingerprints.fingerprints(runs))) == len(runs)
    assert fingerprints.likeness(*fingerprints.fingerprints(["", ""])) == 1 and fingerprints.likeness(*fingerprints.fingerprints(["", "abc"])) == 0


def test_neighbours_of_odd_rows(spark, odd, nothing):
    rows = sorted(((i, t or "") for i, t in texts_of(odd)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((str(i), hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    got = sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fingerprints.compare_neighbours(odd).collect())
    assert got == want
    assert fingerprints.compare_neighbours(nothing).isEmpty() and fingerprints.fingerprint(odd).count() == 15
    alone = fingerprints.compare_neighbours(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1


# ---------------------------------------------------------------- personal data
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def fits(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(FORMS[kind], text) if fits(kind, m[0]))


def spans_of(df):
    return [(r["_id"], [tuple(x) for x in r["base"]], [tuple(x) for x in r["added"]]) for r in pii.find(df).collect()]


def test_base_forms_on_random_texts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(a, k=rng.randrange(90))) for a in ("01239 -", "0125.", "a@b.c-%", "+12 ().-3", "+ab1@.-9 25") for _ in range(500)]
    texts += ["4111 1111 1111 1111", "a@b.c%e@f.g", "1.2.3.4.5.6.7.8", "x 0001.255.3.4 300.1.1.1", "+1 (366) 555-9807 ", "1" * 30_000, "a" * 30_000 + "@", "\U0001f600 1.2.3.4", "9.9.9.9 " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for doc_id, base, _ in spans_of(df):
        assert base == base_spans(texts[doc_id]), texts[doc_id][:100]


def test_contexts_reveal_unseen_identifiers(spark):
    """Seeds teach the words before a phone number; a number without the plus sign is found after them, and not after others."""
    seeds = [f"some words here please ring us on +1 (555) 010-{1000 + k} before noon" for k in range(12)]
    others = [f"the lot of about {5550100000 + 7 * k} pieces" for k in range(12)]
    texts = [*seeds, "so please ring us on 555 010 7777 at night", *others, "the lot of about 5550107777 pieces", "clean words only"]
    found = {i: (b, a) for i, b, a in spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    at = texts[12].index("555")
    assert found[12] == ([], [(at, 3, at + 12)])
    assert all(len(found[k][0]) == 1 and not found[k][1] for k in range(12))
    assert not any(found[k][1] for k in range(13, len(texts)))


def test_unseen_identifiers_do_not_speak_against_a_context(spark):
    """As many unseen as seen identifiers in a context; a context beside other tokens teaches nothing."""
    calls = [f"if so call us on +1 (555) 010-{1000 + k} today" for k in range(5)] + [f"if so call us on 555 010 {7000 + k} today" for k in range(5)]
    mails = [f"for more write to person{c}@example.org or visit" for c in "abcde"] + [f"for more write to person{c} [at] example [dot] org or visit" for c in "vwxyz"]
    mixed = [f"this costs about +1 (555) 020-{1000 + k} units" for k in range(5)] + [f"this costs about {n} units" for n in ("9a", "8b", "555 020 7000")]
    texts = [*calls, *mails, *mixed]
    found = {i: (b, a) for i, b, a in spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    for k, text in enumerate(calls[5:], 5):
        assert found[k] == ([], [(text.index("555"), 3, text.index(" today"))])
    for k, text in enumerate(mails[5:], 15):
        assert found[k] == ([], [(text.index("person"), 0, text.index(" or visit"))])
    assert all(len(found[k][0]) == 1 and not found[k][1] for k in (*range(5), *range(10, 15), *range(20, 25)))
    assert not any(found[k][1] for k in range(25, len(texts)))


def test_rounds_go_on_until_one_adds_nothing(spark):
    """Each context shares its known numbers with the one before only, so every further context takes a round of its own."""
    words = "amber birch cedar delta ember".split()
    levels = [[f"+1 (555) 010-{1000 + k}" for k in range(3)]] + [[f"555 010 {7000 + 10 * level + k}" for k in range(3)] for level in range(len(words))]
    texts = [f"the {word} line {number} {word} end" for word, *both in zip(words, levels, levels[1:]) for part in both for number in part]
    found = spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for doc_id, base, added in found:
        assert len(base) + len(added) == 1 and len(base) == ("+1" in texts[doc_id])


def test_masking(spark, odd, nothing):
    text = "Call +1 (555) 010-1234 or ann@example.org, 10.0.0.1; card 4111 1111 1111 1111."
    df = spark.createDataFrame([(1, text, 3), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.masked(df, pii.find(df)).collect()}
    want = "Call [PHONE] or [EMAIL], [IP]; card [CARD]."
    assert got == {1: (want, len(want)), 2: ("clean", 5), 3: (None, None)}
    rows = pii.masked(odd, pii.find(odd)).collect()
    assert len(rows) == 15 and [r["doc_id"] for r in rows if "[EMAIL]" in (r["text"] or "")] == [None]
    assert pii.masked(nothing, pii.find(nothing)).columns == nothing.columns


def test_long_hosts(spark):
    """Hosts of many labels, also written out, neither end the job nor change the spans."""
    texts = ["x@a" + ".a" * 2_000, "x@a" + ".a" * 100_000, "y [at] b" + " [dot] b" * 20_000, "write to z@c.d now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(df)).collect()}
    assert got == {0: f"email:0:{len(texts[0])}", 1: f"email:0:{len(texts[1])}", 2: "", 3: "email:9:14"}


def test_pii_query(spark, documents):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_bootstrapped_pii"](spark, SF).collect()}
    for doc_id, text in texts_of(documents):
        want, r = base_spans(text or ""), rows[doc_id]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest() and set(written) <= set(r["spans"].split(",")) | set()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == kind for _, kind, _ in want) for k in range(4)]


# ---------------------------------------------------------------- quality
def test_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(12)
    sizes = np.array([3, 0, 1, 4])
    score, step = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs = quality.marginals(score, sizes, step)
    at = 0
    for chain, n in enumerate(sizes):
        total, good, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(score[at + k] for k in range(n) if labels[k]) + sum(step[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            good += weight * np.array(labels)
            for a, b in itertools.pairwise(labels):
                moves[a, b] += weight
        assert np.allclose(got[at : at + n], good / total) and np.allclose(pairs[chain], moves / total)
        at += n


def test_quality_query_separates_held_out_rows(spark):
    rows = queries.QUERIES["op3_line_crf"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert rows.count() == 1000 and rows.filter("score < 0 or score > 1 or score is null").isEmpty()
    checked = rows.filter("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in checked)
    assert len(checked) > 50 and right / len(checked) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows.collect())


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (2, None), (5, 1), (5, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows) and {r["score"] for r in rows if not (r["text"] or "").strip("\n")} == {0.0}
    again = quality.fit(odd, labels)
    assert np.array_equal(model.weights, again.weights)
    untaught = quality.fit(nothing, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(odd, untaught).collect() if (r["text"] or "").strip()} == {0.5}
    assert quality.score(nothing, model).isEmpty()


# ---------------------------------------------------------------- decontamination
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORDS.findall((text or "").translate(_LOWER))


def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            if item is not None:
                windows[tuple(words[k : k + size])].add(item)
    out = []
    for doc_id, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                found = windows.get(tuple(words[k : k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    names |= found
        listed = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        out.append((str(doc_id), len(words), len(hit), len(names), listed, bool(hit)))
    return sorted(out)


def reported(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(df).collect())


def test_decontamination_query(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op7_decontamination"](spark, SF).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute_hits(texts_of(documents), items)
    assert any(r["contaminated"] for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_decontamination_of_odd_rows(spark, odd, nothing, block_bytes):
    """Also with the windows cut into several blocks."""
    items = [(1, "Quick BROWN fox"), (2, "jumps over, the lazy dog! The quick brown fox jumps over the"), (3, None), (4, "..."), (None, "one"), (5, "same line here same line"), (6, "quick brown fox")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert reported(decontaminate.find(odd, bench, block_bytes)) == brute_hits(texts_of(odd), items)
    assert reported(decontaminate.find(nothing, bench)) == []
    assert reported(decontaminate.find(odd, bench.limit(0))) == brute_hits(texts_of(odd), [])
    cut = decontaminate.without_hits(decontaminate.find(spark.createDataFrame([(1, "Say: the quick, brown fox! ran")], "doc_id long, text string"), bench, block_bytes)).first()
    assert cut["text"] == "Say: the ! ran" and cut["removed"] == len("quick, brown fox")


# ---------------------------------------------------------------- licences and languages
def test_licence_forms(spark, odd, nothing):
    from cohortry.llm.licence_texts import TEXTS

    mit = dict(TEXTS)["MIT"]
    changed = "Copyright (c) 2019 Somebody\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace("SOFTWARE", "Software  ")
    rows = [(1, changed), (2, mit + " and more"), (3, "Intro\nreleased under the  MIT Licence\nEnd"), (4, "released under the MIT License yesterday"), (5, None)]
    found = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known(spark)).collect()}
    assert (found[1]["licence"], found[2]["licence"], found[3]["licence"]) == ("MIT", None, None)
    assert (found[3]["line_licences"], found[3]["n_licence_lines"], found[4]["line_licences"], found[5]["n_licence_lines"]) == ("MIT", 1, "", 0)
    assert licences.scan(odd, licences.known(spark)).count() == 15 and licences.scan(nothing, licences.known(spark)).isEmpty()
    assert licences.scan(odd, licences.known(spark).limit(0)).filter("licence is not null").isEmpty()


def test_licence_query_equals_sql(spark):
    from oracle import compare, connect

    assert compare(spark, connect(SF), queries.QUERIES["op5_licence_digests"], queries.ORACLES["op5_licence_digests"], SF) == ""


def brute_profile(texts):
    counts = defaultdict(int)
    for text in texts:
        word = ""
        for char in text.lower() + "\n":
            if char.isalpha():
                word += char
            elif word:
                padded = "\x01" + word + "\x01"
                for n in (1, 2, 3):
                    for k in range(len(padded) - n + 1):
                        if n > 1 or padded[k] != "\x01":
                            counts[padded[k : k + n]] += 1
                word = ""
    return counts


def number(gram):
    value = 0
    for char in gram:
        value = value << 21 | ord(char)
    return value


def test_profiles_match_plain_counts(spark):
    rows = [("x", "Hello World, hello"), ("x", "O été"), ("y", "1234 ..."), (None, "not counted"), ("z", None), ("y", "Wort")]
    found = dict(language.profiles(spark.createDataFrame(rows, "lang string, text string"), 20))
    for lang in ("x", "y"):
        counts = brute_profile([t for k, t in rows if k == lang])
        assert found[lang] == [number(g) for g in sorted(counts, key=lambda g: (-counts[g], number(g)))[:20]]
    assert set(found) == {"x", "y"}


def test_language_query_finds_held_out_languages(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op10_rank_order_language"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    checked = rows.filter("held_out").join(truth, "doc_id").collect()
    assert rows.count() == 1000 and sum(r["lang_pred"] == r["lang"] for r in checked) / len(checked) >= 0.97
    known = [("b", [1, 2]), ("a", [1, 2])]
    found = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd, known).collect()}
    assert (2, "und", 0.0) in found and (4, "und", 0.0) in found and {f[1] for f in found} <= {"und", "b"}
    assert language.predict(nothing, known).isEmpty() and language.predict(odd, []).filter("lang_pred <> 'und'").isEmpty()


def test_key_counts_are_exact(spark, monkeypatch):
    """Counts over many tasks, blocks and buckets, keys with the upper bit set, very frequent ones; no row for each key."""
    from collections import Counter

    from cohortry.llm import jaccard

    monkeypatch.setattr(jaccard, "COUNTED_KEYS", 50)
    rng = random.Random(8)
    rows = [([rng.choice([7, -7, -(1 << 31), (1 << 31) - 1, rng.randrange(-(1 << 31), 1 << 31), rng.randrange(60)]) for _ in range(rng.randrange(40))],) for _ in range(300)]
    df = spark.createDataFrame([*rows, ([],)], "tops array<int>").repartition(5)
    want = Counter(t for (tops,) in rows for t in tops)
    for least in (1, 2, 4):
        found = jaccard.key_counts(df, jaccard._flat, least)
        assert sorted(tuple(r) for r in found.collect()) == sorted((t, c) for t, c in want.items() if c >= least)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert jaccard.key_counts(df.limit(0), jaccard._flat, 1).isEmpty()
