"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its block elements, each named by its path of elements with their classes and ids, and its text
blocks.  Tokens that occur equally often on every page of a host (equal occurrence vectors, told by a hash that adds up
over pages) form a class.  A class of tokens found once on most pages is valid if its tokens stand in one order on all
pages; a class of repeated tokens is valid if all its occurrences lie in one slot between two tokens of the former, and is
nested there.  The valid classes are the host's template; what lies between its tokens are slots.  Menus, adverts and the
like are slots below elements that say so; of the other slots, the main text is what the innermost element of the once-per-
page class encloses that holds most of the host's words outside such elements.  Text blocks that are themselves tokens of
the once-per-page class (the same words on every page) belong to the template.

Hosts with few pages have too little to compare: all of them together are treated as one site.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.session import ship_package, stage, unstage

# A host is compared with itself from so many pages on; repeated text counts as template from so many on.
LEAST_PAGES = 8
LEAST_REPEATS = 20
# Share of a host's pages on which a class must occur, and of its words that the main element must hold.
SUPPORT = 0.6
MOST_WORDS = 0.7
# Hosts above this share of all pages are joined in so many parts (at most 1 / share hosts).
HOT_SHARE = 0.002
HOT_PARTS = 64

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
_VOID = frozenset("area base col embed hr link meta param source track".split())
# Elements whose content is no text of the page.
_SILENT = "script style title textarea iframe noscript template select button svg math canvas object audio video xmp noembed noframes"
_BOILER = frozenset("nav footer aside form menu dialog head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    (
        "ad ads advert advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
        "subscribe subscription signup nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar related recommended recommendations share sharing social comment "
        "comments disqus respond reply replies footer masthead toolbar widget widgets copyright login searchform"
    ).split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body html article section div main".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({_SILENT.replace(' ', '|')})(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Block:
    """A block's text with the path it stands in; ``kept`` is whether no enclosing element is boilerplate."""

    __slots__ = ("kept", "path", "text")

    def __init__(self, path: tuple[str, ...], kept: bool, text: str) -> None:
        self.path, self.kept, self.text = path, kept, text


def _named(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """An element's token and whether it is boilerplate; in an article, its own header is not."""
    label, words, role = name, set(), ""
    if attributes and not attributes.isspace():
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = html.unescape("".join(values))
            if key.lower() == "role":
                role = value.strip().lower()
                continue
            parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            words.update(parts)
            label += ("#" if key.lower() == "id" else ".") + "-".join(parts)
    if name in ("html", "body", "main", "article"):
        return label, False
    return label, name in _BOILER or (name == "header" and not inside) or role in _ROLES or not _WORDS.isdisjoint(words)


def parse(page: str | None) -> tuple[list[tuple[str, ...]], list[Block]]:
    """Block elements as they open, by their paths, and the text blocks in page order, white space made one and trimmed."""
    opened: list[tuple[str, ...]] = []
    blocks: list[Block] = []
    names: list[str] = []  # of open elements
    marks: list[bool] = []  # whether one at or above each is boilerplate
    path: tuple[str, ...] = ()
    held: list[str] = []
    page = page or ""

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append(Block(path, not (marks and marks[-1]), text))

    at = 0
    for match in _MARKUP.finditer(page):
        if match.start() > at:
            held.append(page[at : match.start()])
        at = match.end()
        if match[1]:
            if match[1].lower() not in ("button", "select", "object", "svg", "math", "canvas"):
                end()
            continue
        name = match[3] or match[6]
        if not name:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "br":
                held.append(" ")
            continue
        end()
        if name in _VOID:
            continue
        if match[2] or match[5]:
            if name in names:
                keep = len(names) - 1 - names[::-1].index(name)
                del names[keep:], marks[keep:]
                path = path[:keep]
            continue
        closes = _CLOSES.get(name, ())
        for k in range(len(names) - 1, -1, -1):  # an open paragraph ends before any block; items end before the next one
            if names[k] == "p" or names[k] in closes:
                del names[k:], marks[k:]
                path = path[:k]
                break
            if names[k] in _SCOPES:
                break
        label, boiler = _named(name, match[4] if match[4] is not None else match[7] or "", "article" in names or "main" in names)
        names.append(name)
        marks.append(boiler or bool(marks and marks[-1]))
        path = (*path, label)
        opened.append(path)
    held.append(page[at:])
    end()
    return opened, blocks


def _token(path: tuple[str, ...]) -> str:
    return "/".join(path)


def _block_token(block: Block) -> str:
    return f"{_token(block.path)} {xxhash.xxh64_hexdigest(block.text.encode())}"


_SKELETON = "site string, page long, token string, n int, first int, words long, kept boolean, block boolean"


def _skeletons(pages: DataFrame) -> DataFrame:
    """``site, page, token, n, first, words, kept, block``: each page's distinct tokens, how often and where first they stand, the words directly in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for site, page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                opened, blocks = parse(source.as_py())
                rows: dict[str, list] = {}
                for k, path in enumerate(opened):
                    rows.setdefault(_token(path), [0, k, 0, True, False])[0] += 1
                for block in blocks:
                    at = rows.setdefault(_token(block.path), [0, len(opened), 0, True, False])
                    at[2] += len(block.text.split())
                    at[3] = block.kept
                    if block.kept:
                        rows.setdefault(_block_token(block), [0, len(opened), 0, True, True])[0] += 1
                values = list(zip(*[(site, page, token, *row) for token, row in rows.items()], strict=True)) or [[]] * 8
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _SKELETON.split(", ")])

    return pages.select("site", "page", "html").mapInArrow(run, _SKELETON)


def _classes(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """``site, token, block, vector, support, pages, once``: tokens by occurrence vector, those on most of a site's pages."""
    vector = F.bit_xor(F.xxhash64("page", "n"))
    found = tokens.groupBy("site", "token", "block").agg(vector.alias("vector"), F.count("*").alias("support"), F.max("n").alias("most"), F.min("first").alias("early"))
    found = found.join(sizes, "site").filter(F.col("support") >= SUPPORT * F.col("pages"))
    found = found.filter(~F.col("block") | ((F.col("support") == F.col("pages")) & (F.col("most") == 1) & (F.col("pages") >= LEAST_REPEATS)))
    return found.select("site", "token", "block", "vector", "support", "pages", (F.col("most") == 1).alias("once"), "early")


def _templates(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per site: ``main``, the paths of valid classes; ``texts``, text tokens of the template.

    A class of once-per-page elements is valid if its tokens have one order on all pages (a page's order as a hash, the
    same everywhere).  Elements that repeat are nested: their path tells the slot, and their once-per-page ancestor must be valid.
    """
    elements = tokens.filter(~F.col("block")).join(classes.filter("once and not block").select("site", "token", "vector"), ["site", "token"])
    orders = elements.groupBy("site", "vector", "page").agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("first", "token")))["token"]).alias("order"))
    valid = orders.groupBy("site", "vector").agg((F.min("order") == F.max("order")).alias("ordered")).filter("ordered").select("site", "vector")
    once = classes.filter("once and not block").join(valid, ["site", "vector"], "left_semi")
    texts = classes.filter("block").groupBy("site").agg(F.collect_set("token").alias("texts"))
    # Words of each path count for all paths above it.
    held = tokens.filter("not block and kept and words > 0").groupBy("site", "token").agg(F.sum("words").alias("words"))
    parts = F.split("token", "/")
    above = held.select("site", "words", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("token"))
    totals = above.groupBy("site", "token").agg(F.sum("words").alias("words"))
    site_words = held.groupBy("site").agg(F.sum("words").alias("site_words"))
    depth = F.size(F.split("token", "/"))
    names = F.regexp_extract(F.element_at(F.split("token", "/"), -1), r"^[a-z0-9]+", 0)
    named = names.isin("article", "main").cast("int")
    choice = once.join(totals, ["site", "token"]).join(site_words, "site").filter((F.col("words") >= MOST_WORDS * F.col("site_words")) & ~names.isin("p", "li", "td", "tr", "blockquote", "h1", "h2", "h3"))
    order = Window.partitionBy("site").orderBy(named.desc(), depth.desc(), F.col("token"))
    main = choice.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("site", F.col("token").alias("main"))
    return main.join(texts, "site", "full").select("site", "main", "texts")


def _own_main(blocks: list[Block]) -> str:
    """The main element of a page that lacks its site's, by its own words; empty if all of the page."""
    totals: dict[tuple[str, ...], int] = {}
    whole = 0
    for block in blocks:
        if block.kept:
            n = len(block.text.split())
            whole += n
            for k in range(1, len(block.path) + 1):
                totals[block.path[:k]] = totals.get(block.path[:k], 0) + n
    named = [p for p in totals if re.match(r"(article|main)(?![a-z])", p[-1])]
    found = [p for p in (named or totals) if totals[p] >= MOST_WORDS * whole and not re.match(r"(p|li|td|tr|blockquote|h[1-6])(?![a-z0-9])", p[-1])]
    return _token(max(found, key=len)) if found else ""


def main_text(page: str | None, main: str | None, texts: frozenset[str]) -> str:
    """The slots of the main element, block by block, without those of boilerplate and without template texts."""
    opened, blocks = parse(page)
    if main is None or not any(_token(path) == main for path in opened):
        main = _own_main(blocks)
    inside = [b for b in blocks if b.kept and (not main or _token(b.path) == main or _token(b.path).startswith(main + "/"))]
    return "\n".join(b.text for b in inside if not texts or _block_token(b) not in texts)


def _site(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages`` (``page_id, url, html``): one row for each row.

    Null or empty html, and pages without main text, give an empty text.  Repeated rows get equal texts; a null url
    belongs to no host of its own.  An empty table gives an empty one; other columns play no part.  Character references
    are decoded, white space in a block is one space, blocks are joined by line feeds; every block of the main element is
    kept whole.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select("page_id", "url", "html", _site(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    hosts = stage(rows.groupBy("host").agg(F.count("*").alias("pages")), "page-hosts")
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    few = hosts.filter(F.col("pages") < LEAST_PAGES).select(F.col("host").alias("_few"))
    sites = hosts.select("host", F.when(F.col("pages") < LEAST_PAGES, F.lit("")).otherwise(F.col("host")).alias("site"))
    # At most 1 / HOT_SHARE hosts.
    hot = [r["host"] for r in hosts.filter((F.col("pages") >= LEAST_PAGES) & (F.col("pages") > HOT_SHARE * total)).select("host").collect()]
    part = F.when(F.col("host").isin(hot), F.pmod(F.col("page"), F.lit(HOT_PARTS))).otherwise(0).cast("int") if hot else F.lit(0)
    salted = sites.withColumn("part", F.explode(F.when(F.col("host").isin(hot), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))))
    raw = stage(_skeletons(rows.withColumnRenamed("host", "site")), "page-tokens")
    tokens = raw.join(few, F.col("site") == F.col("_few"), "left").withColumn("site", F.when(F.col("_few").isNotNull(), F.lit("")).otherwise(F.col("site"))).drop("_few")
    sizes = sites.join(hosts, "host").groupBy("site").agg(F.sum("pages").alias("pages"))
    classes = stage(_classes(tokens, sizes), "page-classes")
    templates = stage(_templates(tokens, classes), "page-templates")
    known = salted.join(templates, "site", "left").select(F.col("host").alias("_host"), F.col("part").alias("_part"), "main", "texts")
    joined = rows.withColumn("part", part).join(known, (F.col("host") == F.col("_host")) & (F.col("part") == F.col("_part")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset[str]] = {}
        for batch in batches:
            found = []
            for source, main, texts in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                key = tuple(texts or ())
                if key not in sets:
                    sets[key] = frozenset(key)
                found.append(main_text(source.as_py(), main, sets[key]))
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    out = joined.select("page_id", "url", "html", "main", "texts").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
    unstage(raw, classes)
    return out
