"""Append-only log of runs: one JSON line per record."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.stats import finite
from cohortry.sources.files import exists

RUN_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("dataset_version", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("notes", T.StringType()),
])


def run_records(
    results: DataFrame, kind: str, metrics: Sequence[str], params: Mapping[str, object] | None = None,
    param_columns: Sequence[str] = (), features: Sequence[str] = (), notes: str = "", version: str = "unknown",
    run: str | None = None,
) -> DataFrame:
    """One record per result row (columns ``model``, the metrics, and the parameter columns).

    Metrics are rounded to four places; NaN and infinities become null.  Ids
    are hashes of the record's content and one run id, so a retried task
    writes the same id again; with ``run`` given, so does a retried job.
    """
    run = run or uuid.uuid4().hex
    now = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
    pairs = [F.lit(w) for k, v in (params or {}).items() for w in (k, str(v))]
    for column in param_columns:
        pairs += [F.lit(column), F.col(column).cast("string")]
    param_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    values = F.create_map(*[c for m in metrics for c in (F.lit(m), F.round(finite(F.col(m)), 4))])
    identity = F.sha2(F.concat_ws("|", F.lit(run), F.lit(kind), F.col("model"), F.to_json(param_map)), 256)
    return results.select(
        F.substring(identity, 1, 10).alias("experiment_id"), F.lit(now).alias("timestamp_utc"),
        F.lit(kind).alias("kind"), F.lit(version).alias("dataset_version"), F.col("model"),
        param_map.alias("params"), F.array(*[F.lit(f) for f in features]).cast("array<string>").alias("features"),
        values.alias("metrics"), F.lit(notes).alias("notes"),
    )


def append_runs(records: DataFrame, path: str) -> None:
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def put_runs(records: DataFrame, path: str, run: str) -> None:
    """Write the records of one run in a folder of its own; writing a run again replaces it."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/run={run}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All records; an absent log is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", "true").json(path)


def metric_names(runs: DataFrame) -> list[str]:
    """Names of the metrics that occur (runs a job; a log knows a few dozen names)."""
    keys = runs.select(F.explode(F.map_keys("metrics")).alias("k")).distinct()
    return sorted(row["k"] for row in keys.collect())


def flatten_runs(runs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Metrics as columns ``m_<name>``."""
    names = metric_names(runs) if names is None else names
    rest = [c for c in runs.columns if c != "metrics"]
    return runs.select(*rest, *[F.try_element_at("metrics", F.lit(n)).alias(f"m_{n}") for n in names])


def newest_first(flat: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, newest record first."""
    ordered = flat.orderBy(F.desc("timestamp_utc"), "experiment_id")
    return ordered.select(*[c for c in wanted if c in flat.columns])
