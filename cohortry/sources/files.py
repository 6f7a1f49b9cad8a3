"""Readers and writers: JSON arrays and lines, parquet, CSV, sidecars, table sets, provenance."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.schemas import RAW_SCHEMA
from cohortry.sources import ranges

VERSION_LENGTH = 12
# From this size on a JSON array, or a file to hash, is read by many tasks.
ARRAY_BYTES = 64 << 20
WHOLE_BYTES = 256 << 20
BLOCK_BYTES = 64 << 20


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system its scheme names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


# ---------------------------------------------------------------- JSON records
def largest_file(spark: SparkSession, path: str) -> int | None:
    """Bytes of the largest file, from the listing alone."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]


def read_records(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType = RAW_SCHEMA, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """Raw records with ``_order`` (input position, comparable) and ``_corrupt``.

    A JSON array above ``ARRAY_BYTES`` is read by many tasks (see ``ranges``), smaller ones by one task a file.
    Raises FileNotFoundError when the path is absent.
    """
    if not lines and exists(spark, path) and (largest_file(spark, path) or 0) > array_bytes:
        return ranges.read_array(spark, path, schema)
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    try:
        rows = reader.option("multiLine", not lines).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no raw records at {path}") from error
        raise
    # File, then split, then row: the running id only grows within one split.
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("_order", at)


def read_record_text(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Each record as JSON text in ``value``, for checks on the keys it carries."""
    if lines:
        return spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"))


def require_records(records: DataFrame, key: str = "id") -> None:
    """Raise when there are no records, or some that are no JSON objects (runs one job of one row)."""
    broken = F.col("_corrupt").isNotNull() & F.col(key).isNull()
    found = records.agg(F.count("*").alias("n"), F.count_if(broken).alias("broken")).first()
    if not found["n"]:
        raise ValueError("the source holds no records")
    if found["broken"]:
        raise ValueError(f"the source holds {found['broken']} records that are no JSON objects")


# ---------------------------------------------------------------- tables
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Overwrite; ``sort_by`` clusters rows inside files so that readers can skip row groups."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite in total order by a range shuffle."""
    df.orderBy(*keys).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite as CSV with a header; lists, maps and structs become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        (F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_tables(tables: Mapping[str, DataFrame], root: str, order: Sequence[str]) -> DataFrame:
    """Overwrite every table below ``root`` in the given order; rows (position, table, rows).

    Counts come from the written files' footers.
    """
    counts = None
    for position, name in enumerate(order, 1):
        df = tables[name]
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        part = df.sparkSession.read.parquet(f"{root}/{name}").agg(F.count("*").alias("rows")).select(
            F.lit(position).alias("position"), F.lit(name).alias("table"), "rows"
        )
        counts = part if counts is None else counts.unionByName(part)
    return counts


def read_tables(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def write_jdbc(tables: Mapping[str, DataFrame], order: Sequence[str], url: str, properties: Mapping[str, str]) -> None:
    """Refill the tables of a relational database: children are emptied before their parents, then parents are filled first.

    ``order`` lists parents before children.
    """
    for name in reversed(order):
        tables[name].limit(0).write.option("truncate", "true").jdbc(url, name, mode="overwrite", properties=dict(properties))
    for name in order:
        tables[name].write.option("batchsize", "500").jdbc(url, name, mode="append", properties=dict(properties))


def files_version(manifest: DataFrame) -> str:
    """The hash of one file; of several, that of the sums of their hashes' quarters, whatever their order and number."""
    quarters = [
        F.sum(F.conv(F.substring("sha256", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)
    ]
    whole = F.sha2(F.concat_ws(":", *quarters, F.count("*").cast("string")), 256)
    return manifest.agg(F.when(F.count("*") == 1, F.max("sha256")).otherwise(whole)).first()[0]


# ---------------------------------------------------------------- sidecars
def write_sidecar(spark: SparkSession, path: str, content: Mapping) -> None:
    """One JSON document (a few facts about a dataset) as a one-row table."""
    text = json.dumps(content, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The document, or an empty one when the path is absent."""
    if not exists(spark, path):
        return {}
    return json.loads(spark.read.text(path).first()["value"])


# ---------------------------------------------------------------- provenance
def file_manifest(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (path, bytes, sha256, version) for every file.

    Files up to ``whole_bytes`` have the plain SHA-256 of their content, each in one task; larger ones that of a hash
    tree over blocks of lines (see ``ranges.tree_hashes``), so that no task holds a whole file.
    """
    listed = spark.read.format("binaryFile").load(path)
    small = listed.filter(F.col("length") <= whole_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = [r["path"] for r in listed.filter(F.col("length") > whole_bytes).select("path").collect()]  # names of large files only
    if large:
        sizes = listed.select("path", F.col("length").alias("bytes"))
        small = small.unionByName(sizes.join(ranges.tree_hashes(spark, large, block_bytes).drop("bytes"), "path"))
    return small.withColumn("version", F.substring("sha256", 1, VERSION_LENGTH))


def content_versions(df: DataFrame, text: str, by: str) -> DataFrame:
    """Rows (by, rows, bytes, version): a version of the texts of each group, whatever their order.

    The version is the sum of the texts' hash prefixes modulo 2**48, so tasks
    add up their own share and no group is gathered.
    """
    prefix = F.conv(F.substring(F.sha2(F.col(text), 256), 1, VERSION_LENGTH), 16, 10).cast("decimal(20,0)")
    modulus = F.lit(2 ** (4 * VERSION_LENGTH)).cast("decimal(20,0)")
    return df.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.sum(F.octet_length(text)).cast("long").alias("bytes"),
        F.lower(F.lpad(F.hex((F.sum(prefix) % modulus).cast("long")), VERSION_LENGTH, "0")).alias("version"),
    )
