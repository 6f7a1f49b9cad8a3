"""A Merkle tree over a table: one subtree per source, one tree over the subtrees' roots, and proofs by a recursive query.

Rows become leaves, every sixteen consecutive nodes one node of the next level.  The levels are stored as rows, one for
each run of up to sixteen nodes, with its children's digests, its own digest and a link to the run it stands in.  Proofs
come from a recursive query: its anchor is each run of leaves, which shares its way to the root; each step joins the run
above, folds every leaf's digest into it and appends the siblings.  Digests are kept as 32 bytes and hashed as hex text.

A run near the root is met by very many rows, so it is stored in as many copies as keep the rows for one copy few.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortry.session import stage, unstage

RUN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The tree over the subtrees' roots.
TOP = -1


@dataclass
class Manifest:
    """``runs``: each run of leaves with ``ids, leaves, others`` (digests given beside the leaves); ``nodes``: the runs above,
    in copies; ``trees``: ``source, subroot``; ``root``: one row, or none for an empty table."""

    runs: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: DataFrame
    copies: int

    def drop(self) -> None:
        """Delete the stored tables."""
        unstage(self.runs, self.nodes, self.trees)


def leaf(*fields: Column) -> Column:
    """Hex digest of the fields: ``-`` for null, else the length in bytes, a colon and the value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` written in range partitions in this order, with ``part`` and ``row``, the place within it.

    Equal rows go to one partition: their order makes no difference, but nothing splits them.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return stage(placed.select(*rows.columns, F.shiftright("_at", 33).cast("int").alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("row")), "merkle-order")


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Leaves with ``tree`` (the source's place, nulls first), ``pos`` and ``n`` (of the tree); sources with their tree; what to unstage.

    Positions come from counts per partition and source, about as many rows as there are partitions and sources.
    """
    ordered = _numbered(leaves, "source", "id", "leaf")
    parts = ordered.groupBy("part", "source").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("source")
    parts = parts.select(
        "part", "source", (F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        "first", F.sum("rows").over(own).alias("n"),
    )
    sources = _numbered(parts.select("source").distinct(), "source")
    sizes = sources.groupBy("part").agg(F.count("*").alias("rows"))
    ahead = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    trees = sources.join(ahead, "part").select("source", (F.col("before") + F.col("row")).alias("tree"))
    heads = parts.join(trees.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("part").alias("_part"), "_source", "tree", "n", (F.coalesce("before", F.lit(0)) - F.col("first")).alias("shift")
    )
    placed = ordered.join(heads, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return placed.select("tree", (F.col("row") + F.col("shift")).alias("pos"), "n", "id", "leaf", "other"), trees, [ordered, sources]


def _above(trees: int) -> list[Column]:
    """Of a run (``tree, level, run, n``, ``n`` counting the nodes it and its neighbours are made of): the run its node stands in, and where."""
    last = F.col("n") <= RUN
    in_top = last & (F.col("tree") != TOP) & F.lit(trees > 1)
    node = F.when(in_top, F.col("tree")).when(~last, F.col("run"))
    return [
        F.when(in_top, F.lit(TOP)).when(~last, F.col("tree")).cast("long").alias("up_tree"),
        F.when(in_top, F.lit(1)).when(~last, F.col("level") + 1).cast("int").alias("up_level"),
        F.floor(node / RUN).cast("long").alias("up_run"), (node % RUN).cast("int").alias("up_at"),
    ]


def _joined(nodes: DataFrame) -> DataFrame:
    """Nodes (``tree, pos, n, digest``) of one level as runs of the next."""
    kids = F.array_sort(F.collect_list(F.struct("pos", "digest")))["digest"]
    runs = nodes.groupBy("tree", F.floor(F.col("pos") / RUN).cast("long").alias("run")).agg(F.max("n").alias("n"), F.array_join(F.transform(kids, _hex), "").alias("kids"))
    return runs.select("tree", "run", "n", F.unhex("kids").alias("kids"), _digest(F.col("kids")).alias("digest"))


def build(docs: DataFrame, other: Column | None = None, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", tree_column: str = "source") -> Manifest:
    """The tree of ``docs``; ``other`` is a hex digest per row that proofs fold in place of the leaf (none: the leaf).

    Leaves of a source ascend by id, rows of one id by digest; null ids and the null source come first.  Repeated rows are
    leaves of their own.  A source of one row has that leaf as its root.  An empty table has no rows and no root.
    Columns other than ``fields`` play no part, whatever their names.
    """
    spark = docs.sparkSession
    own = leaf(*[F.col(f"`{c}`") for c in fields])
    rows = docs.select(F.col(tree_column).alias("source"), F.col(id_column).alias("id"), F.unhex(own).alias("leaf"), F.unhex(other if other is not None else F.lit(None).cast("string")).alias("other"))
    placed, trees, used = _placed(rows)
    group = F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", "other")))
    runs = placed.groupBy("tree", F.floor(F.col("pos") / RUN).cast("long").alias("run")).agg(F.max("n").alias("n"), group.alias("leaves"))
    text = F.array_join(F.transform("leaves", lambda x: _hex(x["leaf"])), "")
    made = F.when(F.col("n") > 1, _digest(text)).otherwise(F.get("leaves", F.lit(0))["leaf"])
    runs = stage(runs.withColumn("level", F.lit(1)).withColumn("digest", made), "merkle-runs")
    trees = stage(trees, "merkle-trees")
    unstage(*used)
    count, most = trees.count(), runs.agg(F.max("n")).first()[0] or 0

    levels: list[DataFrame] = []

    def climbed(nodes: DataFrame, size: int, level: int) -> DataFrame:
        """Runs above ``nodes`` until each tree has one node; returns those last nodes (``tree, digest``)."""
        ends = [nodes.filter("n = 1").select("tree", "digest")]
        while size > 1:
            made = stage(_joined(nodes.filter("n > 1")).withColumn("level", F.lit(level)), "merkle-level")
            levels.append(made)
            nodes = made.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / RUN).cast("long").alias("n"), "digest")
            ends.append(nodes.filter("n = 1").select("tree", "digest"))
            size, level = -(-size // RUN), level + 1
        return reduce(DataFrame.unionByName, ends)

    first = runs.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / RUN).cast("long").alias("n"), "digest")
    subroots = climbed(first, -(-most // RUN), 2)
    subroots = trees.join(subroots, "tree")
    root = climbed(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest"), count, 1)

    copies = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = spark.createDataFrame([], "tree long, run long, n long, kids binary, digest binary, level int")
    nodes = reduce(DataFrame.unionByName, levels, empty).select("tree", "level", "run", "kids", "digest", *_above(count))
    nodes = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), _copies(F.col("tree"), F.col("level"), copies) - 1)))
    kept = stage(nodes, "merkle-nodes")
    trees_kept = stage(subroots.select("source", _hex(F.col("digest")).alias("subroot")), "merkle-subroots")
    answer = spark.createDataFrame(root.select(_hex(F.col("digest")).alias("root")).collect(), "root string")  # one row
    unstage(trees, *levels)
    return Manifest(runs.select("tree", "run", "level", "n", "leaves", "digest", *_above(count)), kept, trees_kept, answer, copies)


def _copies(tree: Column, level: Column, most: int) -> Column:
    """A run of level 2 is met by 16 runs of leaves, each level above by 16 times more, the top tree's by any number."""
    return F.when(tree == TOP, F.lit(most)).otherwise(F.least(F.lit(most), F.pow(F.lit(RUN), F.least(level - 2, F.lit(6))))).cast("int")


# One row per run of leaves and level.  The copy to meet follows from the run's number, so that rows spread over all copies.
_CLIMB = """
WITH RECURSIVE climb(tree, run, up_tree, up_level, up_run, up_at, folded, proof, subroot, root) AS (
  SELECT tree, run, up_tree, up_level, up_run, up_at, folded, CAST('' AS BINARY), CASE WHEN n <= {run} THEN digest END, digest
  FROM {start}
  UNION ALL
  SELECT c.tree, c.run, m.up_tree, m.up_level, m.up_run, m.up_at,
    transform(c.folded, f -> unhex(sha2(concat(
      lower(hex(substring(m.kids, 1, 32 * c.up_at))), lower(hex(f)), lower(hex(substring(m.kids, 32 * c.up_at + 33)))), 256))),
    concat(c.proof, substring(m.kids, 1, 32 * c.up_at), substring(m.kids, 32 * c.up_at + 33)),
    CASE WHEN c.subroot IS NULL AND (m.up_tree IS NULL OR m.up_tree <> m.tree) THEN m.digest ELSE c.subroot END, m.digest
  FROM climb c JOIN {nodes} m
    ON c.up_tree = m.tree AND c.up_level = m.level AND c.up_run = m.run
    AND m.copy = pmod(c.run, CASE WHEN c.up_tree = {top} THEN {copies} ELSE CAST(least({copies}, pow({run}, least(c.up_level - 2, 6))) AS INT) END)
)
SELECT tree, run, folded, proof, subroot, root FROM climb WHERE up_tree IS NULL
"""


@contextmanager
def _recursion(spark: SparkSession) -> Iterator[None]:
    """No limit on the rows of a recursive query, whose default would end large inputs (the levels end by themselves), and no
    coalescing: the query's rows come in as many partitions as its largest step, which small steps would make one."""
    put = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key, None) for key in put}
    for key, value in put.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def proofs(made: Manifest) -> DataFrame:
    """Per row: ``id, leaf, subroot, root, proof`` (siblings as hex, level by level, left to right), ``folded_root``.

    ``folded_root`` is recomputed from the row's other digest, or its leaf where there is none, and the stored siblings.
    """
    spark = made.runs.sparkSession
    used = F.transform("leaves", lambda x: F.coalesce(x["other"], x["leaf"]))
    every = F.transform("leaves", lambda x: x["leaf"])

    def hexed(digests: Column) -> Column:
        return F.array_join(F.transform(digests, _hex), "")

    def without(i: Column) -> Column:
        return F.concat(hexed(F.slice("kids", F.lit(1), i)), hexed(F.slice("kids", i + 2, F.lit(RUN))))

    start = made.runs.withColumn("kids", every).withColumn("used", used)
    folded = F.transform("used", lambda u, i: _digest(F.concat(hexed(F.slice("kids", F.lit(1), i)), _hex(u), hexed(F.slice("kids", i + 2, F.lit(RUN))))))
    start = start.withColumn("folded", F.when(F.col("n") > 1, folded).otherwise(F.col("used")))
    start = start.select("tree", "run", "n", "digest", "up_tree", "up_level", "up_run", "up_at", "folded")
    with _recursion(spark):
        climbed = stage(spark.sql(_CLIMB, start=start, nodes=made.nodes, run=RUN, top=TOP, copies=made.copies), "merkle-climbs")
    rows = made.runs.select("tree", "run", "leaves").withColumn("kids", every).join(climbed, ["tree", "run"])
    each = rows.select(
        "subroot", "root", "proof", F.transform("leaves", lambda x, i: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), without(i).alias("own"))).alias("each"), "folded",
    )
    each = each.select("subroot", "root", "proof", F.inline(F.zip_with("each", "folded", lambda x, f: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), x["own"].alias("own"), f.alias("folded")))))
    return each.select(
        "id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.concat("own", _hex(F.col("proof"))).alias("proof"), _hex(F.col("folded")).alias("folded_root"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_leaf() -> Column:
    """The leaf with A-Z of ``text`` lower-cased where 5 divides the CRC-32 of ``doc_id``; null elsewhere."""
    fields = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(*fields))


def report(found: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _checking_sql() -> str:
    def hashed(text: str) -> str:
        fields = [text if c == "text" else c for c in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    )
    levels = """
{name}(l, tree, pos, h, n) AS (
  SELECT 0, tree, pos, h, count(*) OVER (PARTITION BY tree) FROM {start}
  UNION ALL
  SELECT l + 1, tree, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), max(n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY l, tree, pos // 16
)"""
    side = "coalesce((SELECT string_agg(k.h, '' ORDER BY k.pos) FROM {t} k WHERE k.l = c.l AND k.tree = c.tree AND k.pos // 16 = c.pos // 16 AND k.pos {op} c.pos), '')"
    climb = """
{name} AS (
  SELECT id, 0 AS l, tree, pos, h, f, n, '' AS proof FROM {start}
  UNION ALL
  SELECT c.id, c.l + 1, c.tree, c.pos // 16, u.h, sha256({lo} || c.f || {hi}), u.n, c.proof || {lo} || {hi}
  FROM {name} c JOIN {t} u ON u.l = c.l + 1 AND u.tree = c.tree AND u.pos = c.pos // 16 WHERE c.n > 1
)"""

    def way(name: str, start: str, table: str) -> str:
        return climb.format(name=name, start=start, t=table, lo=side.format(t=table, op="<"), hi=side.format(t=table, op=">"))

    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {hashed('text')} AS h,
    CASE WHEN {crc} % 5 = 0 THEN {hashed(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {hashed('text')} END AS f FROM documents
), placed AS (
  SELECT row_number() OVER () AS id, doc_id, tree, h, f, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves
), {levels.format(name='low', start='placed')},
subroots AS (SELECT 0 AS tree, low.tree AS pos, low.h FROM low WHERE low.n = 1),
{levels.format(name='top', start='subroots')},
starts AS (SELECT id, tree, pos, h, f, count(*) OVER (PARTITION BY tree) AS n FROM placed),
{way('climb', 'starts', 'low')},
mids AS (SELECT id, 0 AS tree, tree AS pos, h, f, proof, (SELECT count(*) FROM subroots) AS n FROM climb WHERE n = 1),
{way('rise', 'mids', 'top')}
SELECT p.doc_id, p.h AS leaf, m.h AS subroot, r.h AS root, sha256(m.proof || r.proof) AS proof_sha256, r.f AS folded_root, r.f = r.h AS verified
FROM placed p JOIN mids m USING (id) JOIN rise r USING (id) WHERE r.n = 1
"""


CHECKING_SQL = _checking_sql()
