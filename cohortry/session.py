"""Session settings and the shared staging folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the package relies on.  On a cluster, leave
# spark.sql.shuffle.partitions to the cluster's own value; AQE coalesces.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Recording a call site per Column costs more than building the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "cohortry", **conf: str) -> SparkSession:
    """Get or create a session with the package's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would each see a different one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="cohortry-stage-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the staging folder."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back (runs a job).

    Used where one result feeds many jobs.  The copy survives the loss of
    executors and cuts the lineage.  ``unstage`` removes it.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is a staged table, else staged."""
    return df if "staged_path" in vars(df) else stage(df, name)


def unstage(*frames: DataFrame) -> None:
    """Delete the files behind staged frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


# Rows that Python tasks get at once, unless the session says otherwise: of Spark's 10,000, whole texts take 25 MB and more, held
# several times over (in the JVM's buffers and in Python) by every task.
BATCH_ROWS = 2_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python tasks can import it from any folder.

    A session with Spark's own batch size gets ``BATCH_ROWS``; no result depends on it.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    if getattr(context, "cohortry_shipped", None):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    folder = tempfile.mkdtemp(prefix="cohortry-ship-")  # read by the driver alone, which serves the file to the executors
    with open(os.path.join(folder, "cohortry.zip"), "wb") as out:
        out.write(buffer.getvalue())
    context.addPyFile(os.path.join(folder, "cohortry.zip"))
    context.cohortry_shipped = True
