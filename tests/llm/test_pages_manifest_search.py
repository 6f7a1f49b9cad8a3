"""Page extraction, manifest and lexical search against brute force, on odd rows and on the given tables."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm import lexical, merkle, pages, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, n string, leaf string, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, one source with over 256 rows, one row alone in its source, clashing names."""
    rows = [(i, "hot", "en", 5, f"Text {i} of the Hot source") for i in range(300)]
    rows += [(i, None, None, None, None if i % 2 else "null SOURCE") for i in range(1000, 1018)]
    rows += [(7, "b", "de", 1, "")] * 3 + [(None, "b", "de", 1, "no id"), (8, "é alone", "fr", 10, "Ünï CODE \U0001f600 " * 30_000)]
    return spark.createDataFrame([(*r, 1, "x", "y", 0.5) for r in rows], SCHEMA)


# ---------------------------------------------------------------- manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_digest(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_manifest(rows):
    def climb(nodes):
        """The root and each node's siblings, as (left, right) by level."""
        ways, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            made, joined = [], []
            for k in range(0, len(nodes), 16):
                run = nodes[k : k + 16]
                for j in range(len(run)):
                    for i in groups[k + j]:
                        ways[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                made.append(sha(*run))
                joined.append([i for g in groups[k : k + 16] for i in g])
            nodes, groups = made, joined
        return nodes[0], ways

    by = defaultdict(list)
    for r in rows:
        fields = [r[c] for c in merkle.FIELDS]
        changed = fields[:-1] + [fields[-1].translate(LOWER) if fields[-1] is not None else None]
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, field_digest(fields), field_digest(changed) if hit else field_digest(fields)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: climb([x[2] for x in sorted(by[s])]) for s in order}
    root, high = climb([low[s][0] for s in order])
    out = []
    for s, top in zip(order, high, strict=True):
        for (known, doc_id, leaf, used), way in zip(sorted(by[s]), low[s][1], strict=True):
            for left, right in way + top:
                used = sha(left, used, right)
            proof = sha(*[x for pair in way + top for x in pair])
            out.append((doc_id if known else None, leaf, low[s][0], root, proof, used, used == root))
    return Counter(out)


def test_manifest(spark, odd):
    for df in (odd, odd.filter("doc_id = 8"), odd.filter("source = 'b'"), odd.filter("source is null or doc_id < 17"), spark.read.parquet(f"{SF}/documents.parquet")):
        got = Counter(map(tuple, merkle.report(merkle.proofs(merkle.build(df, merkle.tampered_leaf()))).collect()))
        assert got == brute_manifest([r.asDict() for r in df.collect()])
    none = merkle.build(odd.filter("false"))
    assert merkle.proofs(none).count() == 0 and none.root.count() == 0


def test_manifest_without_changes_verifies(odd):
    made = merkle.build(odd)
    assert merkle.proofs(made).filter("folded_root <> root or folded_root is null").count() == 0
    assert made.root.first()["root"] == merkle.proofs(made).first()["root"]


# ---------------------------------------------------------------- search
def brute_search(docs, items, k=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(find.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n, total, df = len(bags), sum(sum(c.values()) for _, c in bags), Counter(t for _, c in bags for t in c)
    out = Counter()
    for item, text in items:
        asked, scores = set(find.findall((text or "").translate(LOWER))), []
        for doc_id, bag in bags:
            m, score = 10 + (90 * sum(bag.values()) * n) // total, 0
            for t in asked & bag.keys():
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, known, doc_id) in enumerate(sorted(scores)[:k], 1):
            out[(item, rank, doc_id if known else None, -score)] += 1
    return out


def test_search(spark, odd):
    given = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = spark.createDataFrame([("a", "hot SOURCE 17 299"), ("b", None), ("c", "..."), (None, "unï code"), ("a", "hot SOURCE 17 299"), ("z", "zzz")], "item_id string, text string")
    for docs, asked in (given, (odd, items)):
        want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in asked.collect()])
        assert Counter(map(tuple, lexical.search(docs, asked).collect())) == want
    assert Counter(map(tuple, lexical.search(odd, items, block_bytes=150).collect())) == want
    assert lexical.search(odd.filter("false"), items).count() == lexical.search(odd, items.filter("false")).count() == 0


def test_best_positions_stop_early_and_lose_nothing():
    rng = np.random.default_rng(5)
    n, vocabulary = 4000, 12
    held = rng.random((n, vocabulary)) < 0.3
    doc, term = np.nonzero(held)
    count, sizes = rng.integers(1, 4, len(doc)), rng.integers(5, 400, n)
    lists = lexical.ImpactLists(np.arange(n) * 3, sizes, np.cumsum(held.sum(1)), term.astype("<i4"), count, n, int(sizes.sum()), vocabulary)
    weights = rng.integers(1, 2000, vocabulary)
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, np.where(term < 2, weights[term] * lists.impact, 0))
    docs, scores, scored = lexical.best(lists, np.arange(2), weights, 10)
    order, want = np.lexsort((docs, -scores))[:10], np.lexsort((np.arange(n), -full))[:10]
    assert docs[order].tolist() == want.tolist() and scores[order].tolist() == full[want].tolist()
    assert scored < (full > 0).sum() / 2
    assert lexical.best(lists, np.arange(2), weights, 10, floor=int(full.max()) + 1)[2] <= scored


# ---------------------------------------------------------------- pages
def page(k, body, tail="</body></html>"):
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body><header class=site><a href=/>Home</a></header>"
        f"<nav><ul><li>Menu {k}<li>About</ul></nav><div class='cookie-notice'>We use cookies</div><div id=\"sidebar\"><p>Seen {k}</p></div>{body}"
        f"<div class=comments><p>Reader {k} says hello and quite a lot more words than the article has itself, again and again and again</p></div>"
        f"<form><p>Your mail</p><input></form><footer>&copy; site {k}</footer>{tail}"
    )


def test_pages(spark):
    rows, want = [], {}
    for k in range(30):  # a site that names its article
        body = f"<article><header><h1>Title &amp; {k}</h1></header><p>First   para\n{k} <b>bold</b>&nbsp;end<p>Second&#33; {k}<div class='ad-box'>Buy {k}</div><ul><li>one {k}</li><li>two {k}</li></ul><p>Follow us everywhere</p></article>"
        rows.append((k, f"http://a.example/{k}", page(k, body, "" if k % 3 else "</body></html>")))
        want[k] = f"Title & {k}\nFirst para {k} bold end\nSecond! {k}\none {k}\ntwo {k}"
    for k in range(100, 120):  # one that does not
        body = f"<div id=wrap><div class=post><h2>Head {k}</h2><p>{'Words of the page ' * 9}{k}</p><blockquote>Quoted {k}</blockquote></div><div class=related>More {k}</div></div>"
        rows.append((k, f"https://B.example:80/{k}", page(k, body)))
        want[k] = f"Head {k}\n{('Words of the page ' * 9)}{k}\nQuoted {k}"
    rows += [(200, None, None), (201, "http://few.example/", ""), (202, "x", "just <b>text</b> &lt;here&gt;"), (203, None, "<p>unclosed <i>a<p>b<!-- c"), (203, None, "<p>unclosed <i>a<p>b<!-- c")]
    rows += [(204, "http://few.example/1", "<html><body><nav>n</nav><main><p>" + "long word " * 50_000 + "</p></main></body>"), (205, "http://few.example/2", '<div a="x>y" b=\'">\'>kept</div> < 3')]
    want |= {200: "", 201: "", 202: "just text <here>", 203: "unclosed a\nb", 204: ("long word " * 50_000).strip(), 205: "kept\n< 3"}
    df = spark.createDataFrame([(*r, "s", 1, "m") for r in rows], "page_id long, url string, html string, site string, page int, main string")
    got = pages.extract(df).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["url"] for r in got} == {r[1] for r in rows}
    empty = pages.extract(df.filter("false"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_pages_query(spark):
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op11_template_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
