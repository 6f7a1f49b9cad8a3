"""One large file read by many tasks: records of a JSON array, and a hash tree over a file's bytes.

A text file with a line separator of one byte is read in byte ranges, whatever the separator.  Pieces between separators
keep their place (file, start of the range, row in it); running totals over them add the totals of the ranges before,
a few rows for each file, to a window within each range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import stage, unstage

PLACE = ("file", "range", "row")


def pieces(spark: SparkSession, paths: str | Sequence[str], separator: str) -> DataFrame:
    """``file, range, row, value``: the bytes between separators, each in its place; no piece holds the separator."""
    rows = spark.read.option("lineSep", separator).text(paths)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("row"), "value",
    )


def running(placed: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Add totals of all pieces before each one in its file.  ``placed`` must be written: it is read twice."""
    valued = placed.select("*", *[value.cast("long").alias(f"_v_{name}") for name, value in sums.items()])
    ranges = valued.groupBy("file", "range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    ahead = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(F.col("file").alias("_f"), F.col("range").alias("_r"), *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in sums])
    joined = valued.join(before, (F.col("file") == F.col("_f")) & (F.col("range") == F.col("_r")))
    within = Window.partitionBy("file", "range").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*placed.columns, *[(F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0))).alias(n) for n in sums])


# ---------------------------------------------------------------- records of a JSON array
def _balance(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.length(F.translate(text, "}]", "")) - F.length(F.translate(text, "{[", ""))


def array_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, range, row, value``: the text of each object of the JSON arrays in ``paths``, with the place where it begins.

    Pieces end with a closing brace.  Whether one begins inside a string is the parity of the quotes before it (escapes
    never cross a brace); its brackets are counted for both cases beforehand.  An object ends where the depth is back at
    one, outside strings.  What follows the last object comes as one more row unless it only closes the array.
    """
    found = pieces(spark, paths, "}")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)

    def every(k: int) -> Column:
        return F.array_join(F.filter("_parts", lambda _, i: i % 2 == k), "")

    odd = (F.size("_parts") - 1) % 2
    found = found.withColumn("_parts", parts)
    # The closing brace itself counts where the piece ends outside strings.
    placed = stage(found.select(
        *PLACE, "value", odd.alias("quotes"), (_balance(every(0)) - (1 - odd)).alias("out"), (_balance(every(1)) - odd).alias("in"),
    ), "json-pieces")
    inside = running(placed, {"_q": F.col("quotes")}).withColumn("_in", F.col("_q") % 2)
    moved = stage(inside.select(*PLACE, "value", F.when(F.col("_in") == 1, F.col("in")).otherwise(F.col("out")).alias("moved"), ((F.col("_in") + F.col("quotes")) % 2 == 0).alias("ends_out")), "json-depths")
    deep = running(moved, {"_d": F.col("moved")})
    ended = stage(deep.select(*PLACE, "value", (F.col("ends_out") & (F.col("_d") + F.col("moved") == 1)).alias("ends")), "json-ends")
    numbered = running(ended, {"_n": F.col("ends").cast("int")})
    held = F.array_sort(F.collect_list(F.struct("range", "row", "value", "ends")))
    records = numbered.groupBy("file", "_n").agg(held.alias("_p")).select(
        "file", F.col("_p")[0]["range"].alias("range"), F.col("_p")[0]["row"].alias("row"), F.array_join(F.col("_p")["value"], "}").alias("value"),
        F.element_at("_p", -1)["ends"].alias("whole"),
    )
    # Between objects stand the array's opening bracket or a comma.
    bare = F.regexp_replace("value", r"^\s*[\[,]?\s*", "")
    done = records.select(*PLACE, F.when(F.col("whole"), F.concat(bare, F.lit("}"))).otherwise(bare).alias("value"), "whole")
    rows = stage(done.filter(F.col("whole") | ~F.col("value").rlike(r"^[\s,]*\]?\s*$")).select(*PLACE, "value"), "json-records")
    unstage(placed, moved, ended)
    return rows


def read_array(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """The objects of JSON arrays as rows with ``_order`` and ``_corrupt``, as the lines form gives them (runs jobs).

    Text that is no object between two others is kept with the object after it, which then is corrupt.
    """
    rows = array_text(spark, paths)
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return rows.select(read.alias("_x"), F.struct(*PLACE).alias("_order")).select("_x.*", "_order")


# ---------------------------------------------------------------- a hash tree over a file
def tree_hashes(spark: SparkSession, paths: Sequence[str], block: int) -> DataFrame:
    """``path, bytes, sha256`` of files of any size: the hash of their blocks' hex hashes in order.

    A block is the lines that begin in one range of ``block`` bytes, with their line feeds (the last line of a file
    counts as ended).  A task holds one block; the hashes of a file's blocks are 64 bytes each.
    """
    placed = stage(pieces(spark, paths, "\n").withColumn("size", F.octet_length("value") + 1), "file-lines")
    lines = running(placed, {"at": F.col("size")}).withColumn("block", F.floor(F.col("at") / block))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("at", "value")))["value"], "\n")
    blocks = lines.groupBy("file", "block").agg(F.sha2(F.concat(text, F.lit("\n")), 256).alias("hash"), F.sum("size").alias("bytes"))
    hashes = F.array_join(F.array_sort(F.collect_list(F.struct("block", "hash")))["hash"], "")
    out = stage(blocks.groupBy(F.col("file").alias("path")).agg(F.sum("bytes").cast("long").alias("bytes"), F.sha2(hashes, 256).alias("sha256")), "file-hashes")
    unstage(placed)
    return out
