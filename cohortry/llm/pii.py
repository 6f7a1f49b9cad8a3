"""Personal data: fixed forms, and further identifiers found by bootstrapped contexts.  DataFrame operations only.

The fixed forms are seeds.  Every token that looks like an identifier (it holds
a digit or an at sign) is an instance; the words around it are its patterns.
Rounds alternate: a pattern is trusted for a kind when it stands beside enough
different known instances of that kind and beside little that contradicts it
(seeds of another kind, tokens that do not have the kind's shape), and an unknown
instance of a fitting shape is accepted when its trusted patterns leave little
doubt.  Unknown instances of a fitting shape speak neither for nor against a
pattern.  Rounds go on until one adds nothing.  Both sides are tables that are
counted, joined and written each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.session import stage, unstage

KINDS = ("email", "ip", "card", "phone")
# A pattern needs so many different known instances and this share of known and contradicting ones; an instance needs this score.
LEAST_SUPPORT = 3.0
LEAST_SHARE = 0.8
LEAST_SCORE = 0.8

# The four forms.  They find what the plain forms find from the left: possessive parts lose nothing, since what
# follows cannot stand in the part before, and the looks back only bar starts inside a run that has failed already.
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of 14 to 19 digits alone; a shorter or longer run is one failing match of the plain form.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# What may be an identifier: written-out or bare addresses, groups of digits, any other token with a digit or an at sign.
_AT, _DOT = r"(?:@|\s?[\[(]at[\])]\s?)", r"(?:\.|\s?[\[(]dot[\])]\s?)"
CANDIDATE = (
    rf"(?:\G|(?<!\S))(?:[\"'(<:]*+)(?:{_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+|\+?[(]?[0-9][0-9 ().-]{{5,40}}[0-9](?!\w)|[^\s0-9@]*+[0-9@]\S*+)"
)
SHAPES = {
    "email": rf"^{_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+$",  # possessive: a host of a million labels needs no stack
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})$",
    "card": r"^[0-9](?:[ .-]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[ ().-]{0,3}[0-9]){6,14}$",
}

# What a text must hold for a form to be worth trying.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "any": r"[0-9@]|[\[(]at[\])]"}

_BLOCK = 128
_CHUNK = 512
_SPAN = "array<struct<start:int,end:int,hit:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a plain expression would be worked out anew inside every lambda that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join) -> Column:
    """Running sums or maxima of an array of ints, in blocks so that long arrays do not cost their square."""

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), join)

    def of_blocks(parts: Column) -> Column:
        ahead = _let(F.transform(parts, fold), lambda totals: F.transform(totals, lambda _, b: fold(F.slice(totals, F.lit(1), b))))
        return F.flatten(F.zip_with(parts, ahead, lambda part, start: F.transform(part, lambda _, i: join(start, fold(F.slice(part, F.lit(1), i + 1))))))

    def blocks(v: Column) -> Column:
        count = F.ceil((F.size(v) - 1) / F.lit(_BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))

    whole = _let(values, lambda v: _let(blocks(v), of_blocks))
    return F.when(F.size(values) > 0, whole).otherwise(F.expr("cast(array() as array<int>)"))


def _located(df: DataFrame, text: str, forms: dict[str, str]) -> DataFrame:
    """Add, for each name, where its form matches from the left: code points, end exclusive."""
    names = list(forms)
    empty = F.expr("cast(array() as array<string>)")
    hits = {f"_h_{n}": F.when(F.col(text).rlike(_HINTS[n]), F.regexp_extract_all(text, F.lit(forms[n]), F.lit(0))).otherwise(empty) for n in names}
    df = df.withColumns(hits)
    # What stands before each match, by splitting at the matches.
    before = {n: F.slice(F.split(F.col(text), forms[n], -1), F.lit(1), F.size(f"_h_{n}")) for n in names}
    sizes = {
        f"_s_{n}": F.when(F.size(f"_h_{n}") > 0, F.zip_with(before[n], f"_h_{n}", lambda p, h: F.length(p) + F.length(h))).otherwise(F.expr("cast(array() as array<int>)"))
        for n in names
    }
    df = df.withColumns(sizes)
    df = df.withColumns({f"_e_{n}": _running(F.col(f"_s_{n}"), lambda a, b: a + b) for n in names})
    spans = {
        n: F.zip_with(f"_e_{n}", f"_h_{n}", lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit"))).cast(_SPAN) for n in names
    }
    return df.withColumns(spans).drop(*[f"_{k}_{n}" for k in "hse" for n in names])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled with its digits added."""
    digits = F.reverse(F.split(_digits(hit), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _marks(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _written(marks: Column) -> Column:
    """Spans as ``kind:start:end`` by start, then kind as listed, then end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(marks), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _spans(rows: DataFrame) -> DataFrame:
    """``_id, _key, base`` and ``tokens``: each identifier-like token with its place and the text around it.

    One pass over the texts.  The result must be written before it is filtered:
    a filter would be moved below and find everything anew.
    """
    found = _located(rows, "_text", FORMS | {"any": CANDIDATE})

    def test(kind: str):
        return lambda x: _passes(kind, x["hit"])

    base = F.array_sort(reduce(F.concat, [_marks(k, F.filter(k, test(k))) for k in KINDS]))

    # Contexts are cut from short chunks: a cut from the whole text would walk it from its start for every token.
    chunks = F.when(F.size("any") > 0, F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{_CHUNK}}}"), F.lit(0)))
    found = found.withColumn("_chunks", chunks)

    def cut(start: Column, size: Column) -> Column:
        place = F.floor(start / _CHUNK).cast("int")
        two = F.concat(F.coalesce(F.get("_chunks", place), F.lit("")), F.coalesce(F.get("_chunks", place + 1), F.lit("")))
        return F.lower(F.substring(two, start - place * _CHUNK + 1, size))

    def around(x: Column) -> Column:
        low = F.greatest(F.lit(0), x["start"] - 60)
        return F.struct(x["start"].alias("start"), x["hit"].alias("hit"), cut(low, x["start"] - low).alias("left"), cut(x["end"], F.lit(40)).alias("right"))

    return found.select("_id", "_key", base.cast(_MARKS).alias("base"), F.transform("any", around).alias("tokens"))


_MARKS = "array<struct<start:int,kind:int,end:int>>"


def _instances(spans: DataFrame) -> DataFrame:
    """One row for each identifier-like token: its place, its normal form, the kind of the seed it is (or null), its contexts."""
    rows = spans.select("_id", "_key", "base", F.explode("tokens").alias("c"))
    # Leading quotes and the like belong to the context; so does closing punctuation.
    ahead = F.length(F.regexp_extract("c.hit", r"^[\"'(<:]*(?=[^\"'(<:])", 0))
    rows = rows.select("*", (F.col("c.start") + ahead).alias("start"), F.regexp_replace(F.substring(F.col("c.hit"), ahead + 1, F.length("c.hit")), r"[^\w)]+$", "").alias("hit"))
    rows = rows.filter(F.length("hit") > 0).withColumn("end", F.col("start") + F.length("hit"))
    over = F.filter("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    words = F.regexp_extract("c.left", r"(\S+)\s+(\S+)\s*$", 0)
    one = F.regexp_extract("c.left", r"(\S+)\s*$", 0)
    after = F.regexp_extract("c.right", r"^\s*(\S+)", 0)
    return rows.select(
        "_id", "_key", "start", "end", F.lower(F.regexp_replace("hit", r"\s+", " ")).alias("instance"), F.get(over, F.lit(0))["kind"].alias("seed"),
        F.array(F.concat(F.lit("2 "), F.trim(words)), F.concat(F.lit("w "), F.trim(one), F.lit(" _ "), F.trim(after))).alias("patterns"),
        F.array_compact(F.array(*[F.when(F.col("hit").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)])).alias("shapes"),
    )


def bootstrap(tokens: DataFrame, rounds: int | None = None) -> DataFrame:
    """``instance, kind`` of the identifiers that contexts reveal, from ``instance, seed, shapes, patterns``.

    The graph's edges are distinct (pattern, instance) pairs, counted before
    anything is joined, so a pattern or instance that fills a third of all rows
    is small.  Seeds are known from the start and never lost; an instance keeps
    the kind it is accepted for.  Each round adds an instance or is the last one;
    ``rounds`` ends them sooner.
    """
    edges = stage(
        tokens.select(F.explode("patterns").alias("pattern"), "instance", "seed", "shapes").filter(F.length("pattern") > 2)
        .groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("shapes").alias("shapes")), "edges"
    )
    contradicts = [F.coalesce(F.col("seed") != i, ~F.array_contains("shapes", i)) for i in range(len(KINDS))]
    against = edges.groupBy("pattern").agg(F.array(*[F.count_if(c) for c in contradicts]).alias("against"))
    known = stage(edges.filter("seed is not null").select("instance", F.col("seed").alias("kind")).distinct(), "known")
    seeds, done = known, 0
    while rounds is None or done < rounds:
        held = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("s"))
        share = F.col("s") / (F.col("s") + F.get("against", F.col("kind")))
        trusted = held.filter(F.col("s") >= LEAST_SUPPORT).join(against, "pattern").filter(share >= LEAST_SHARE)
        trusted = trusted.select("pattern", "kind", (share * F.col("s") / (F.col("s") + 0.5)).alias("trust"))
        open_edges = edges.filter("seed is null").filter(F.size("shapes") > 0)
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999)))))
        fresh = (
            open_edges.join(trusted, "pattern").filter(F.array_contains("shapes", F.col("kind")))
            .groupBy("instance", "kind").agg((1 - doubt).alias("score")).filter(F.col("score") >= LEAST_SCORE)
        )
        best = fresh.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        best = stage(best.join(known, "instance", "left_anti"), "fresh")
        if best.isEmpty():
            unstage(best)
            break
        after = stage(known.unionByName(best), "known")
        unstage(best, *([known] if known is not seeds else []))
        known, done = after, done + 1
    found = stage(known.join(seeds, "instance", "left_anti"), "found")
    unstage(edges, seeds, *([known] if known is not seeds else []))
    return found


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``_id, _key, base, added``, both arrays of (start, kind, end) in order.

    ``_key`` is a hash of the text; rows equal in id and text get equal spans.
    Null texts are empty.  Spans are in code points, ends exclusive; ``kind`` is
    a place in ``KINDS``.  Added spans never overlap base ones.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), text.alias("_text")).withColumn("_key", F.xxhash64("_text"))
    spans = stage(_spans(rows), "spans")
    held = stage(_instances(spans), "identifiers")
    revealed = bootstrap(held.select("instance", "seed", "shapes", "patterns"), rounds)
    added = (
        held.filter("seed is null").select("_id", "_key", "start", "end", "instance").join(revealed, "instance")
        .groupBy(F.col("_id").alias("_aid"), F.col("_key").alias("_akey"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).cast(_MARKS).alias("added"))
    )
    both = spans.select("_id", "_key", "base").join(added, F.col("_id").eqNullSafe(F.col("_aid")) & (F.col("_key") == F.col("_akey")), "left")
    return both.select("_id", "_key", "base", F.coalesce("added", F.expr(f"cast(array() as {_MARKS})")).alias("added"))


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (of the fixed forms), ``base_sha256, spans, n_added``."""

    def of(kind: int):
        return lambda x: x["kind"] == kind

    counts = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        F.col("_id").alias("doc_id"), *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def masked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets and ``n_chars`` recounted if there; overlapping spans become one.

    Rows meet their spans by id and text hash.  The columns of ``docs`` travel in one struct, so none of their names can
    clash with one used here; an empty table gives an empty one.
    """
    marks = found.select(
        F.col("_id"), F.col("_key"), F.array_sort(F.concat("base", "added")).alias("_marks")
    ).filter(F.size("_marks") > 0).dropDuplicates(["_id", "_key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row")["text"]
    rows = rows.withColumn("_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    rows = rows.join(marks, F.col("_row")["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")), "left")
    rows = rows.withColumn("_ends", F.coalesce(F.transform("_marks", lambda x: x["end"]), F.expr("cast(array() as array<int>)")))
    rows = rows.withColumn("_reach", _running(F.col("_ends"), lambda a, b: F.greatest(a, b)))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    since = F.concat(F.array(F.lit(0)), F.col("_reach"))
    parts = F.zip_with(
        "_marks", F.slice(since, F.lit(1), F.size("_marks")),
        lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.get(names, x["kind"]))).otherwise(""),
    )
    tail = F.substring(text, F.element_at("_reach", -1) + 1, F.length(text))
    put = rows.withColumn("_text", F.when(F.size("_ends") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text))
    new = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_ends") > 0, F.length("_text").cast("long")).otherwise(new["n_chars"])
    return put.select(*[value.alias(c) for c, value in new.items()])
