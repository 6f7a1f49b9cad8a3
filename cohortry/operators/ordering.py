"""Order-dependent results without ever sorting everything in one task.

A window without PARTITION BY, or one over a group that holds a third of all
rows, runs in a single task.  The functions here cut the key range into
buckets first.  Cut points come from a fixed number of keys with the smallest
hashes, which is a uniform and repeatable sample of the keys, so every bucket
holds about the same share whatever the distribution.  Bucket totals (at most
``2 ** bits`` rows per group) give each bucket its starting value; a window per
bucket does the rest.  Results are exact: the sample only balances the work.

The grouped rows are written to the shared folder first, because cut points,
totals and rows would each scan the source again otherwise.  Every size takes the
same path; the number of buckets follows the session's shuffle parallelism.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import held, stage

_SAMPLES_PER_BUCKET = 16


def bucket_bits(df: DataFrame) -> int:
    """Two buckets for each shuffle partition, as a power of two."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, (2 * parts - 1).bit_length())


def with_bucket(df: DataFrame, key: Column, bits: int | None = None) -> DataFrame:
    """Add ``_key`` and ``_bucket``; buckets are numbered in key order, 0 .. 2**bits - 1."""
    bits = bucket_bits(df) if bits is None else bits
    buckets = 2 ** bits
    sample = (
        df.select(key.alias("_key"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(buckets * _SAMPLES_PER_BUCKET)
        .agg(F.sort_array(F.collect_list("_key")).alias("keys"))
    )
    cuts = sample.select(
        F.transform(
            F.sequence(F.lit(1), F.lit(buckets - 1)),
            lambda i: F.try_element_at(
                F.col("keys"), F.greatest(F.lit(1), (i * F.size("keys") / buckets).cast("int"))
            ),
        )
    ).scalar()
    steps = F.array(*[F.lit(2 ** bit) for bit in reversed(range(bits))])
    position = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            F.try_element_at(F.col("_cuts"), at + step) < F.col("_key"), at + step
        ).otherwise(at),
    )
    keyed = df.select("*", key.alias("_key"), cuts.alias("_cuts"))
    return keyed.select(*df.columns, "_key", position.alias("_bucket"))


def running_totals(
    df: DataFrame, key: Column, sums: Mapping[str, Column], by: Sequence[str] = (), bits: int | None = None
) -> DataFrame:
    """Add inclusive running totals in key order, per group where ``by`` is given (runs a job).

    ``df`` must hold one row per (group, key): aggregate first, so that no hot
    key travels as many rows.
    """
    by = list(by)
    valued = held(df, "totals").select("*", *[value.alias(f"_v_{name}") for name, value in sums.items()])
    parts = with_bucket(valued, key, bits)
    totals = parts.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_b_{b}") for b in by],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    # Without groups the offsets are at most 2**bits rows, a few for each shuffle partition: a proven bound.
    joined = parts.join(offsets if by else F.broadcast(offsets), _same_bucket(by))
    within = Window.partitionBy(*by, "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(within)).alias(n) for n in sums],
    )


def _same_bucket(by: Sequence[str]) -> Column:
    same = F.col("_bucket") == F.col("_b")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    return same


def dense_number(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Number rows 1..n in the order of a unique key, as a BIGINT column in front (runs a job)."""
    numbered = running_totals(df, key, {name: F.lit(1).cast("long")})
    return numbered.select(name, *df.columns)


def exact_quantiles(
    df: DataFrame, value: Column, probs: Mapping[str, float], by: Sequence[str] = (), bits: int | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, one row per group with known values (runs a job).

    Equal values are counted before anything moves; only the buckets that hold a
    wanted rank are sorted.
    """
    by = list(by)
    counted = stage(
        df.select(*by, F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count("*").alias("_n")),
        "values",
    )

    def ranks(p: float) -> tuple[Column, Column]:
        at = (F.col("_all") - 1) * F.lit(float(p))
        return F.floor(at), F.ceil(at)

    group = Window.partitionBy(*by)
    parts = with_bucket(counted, F.col("_v"), bits).drop("_key")
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_in")).select(
        "*", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"), F.sum("_in").over(group).alias("_all")
    )
    wanted = F.lit(False)
    for p in probs.values():
        for rank in ranks(p):
            wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in")))
    totals = totals.filter(wanted).select(
        *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_bucket").alias("_b"), "_before", "_all"
    )
    # Without groups at most two buckets per quantile are left: a proven bound.
    hit = parts.join(totals if by else F.broadcast(totals), _same_bucket(by))
    within = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = hit.withColumn("_upto", F.col("_before") + F.sum("_n").over(within))

    def at_rank(rank: Column) -> Column:
        covers = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        return F.max(F.when(covers, F.col("_v")))

    aggs = [F.max("_all").alias("_all")]
    for name, p in probs.items():
        low, high = ranks(p)
        aggs += [at_rank(low).alias(f"_lo_{name}"), at_rank(high).alias(f"_hi_{name}")]
    picked = placed.groupBy(*by).agg(*aggs)
    out = []
    for name, p in probs.items():
        share = (F.col("_all") - 1) * F.lit(float(p))
        share = share - F.floor(share)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * share).alias(name))
    # Without groups and without values there is still one row, of nulls.
    return picked.select(*by, *out)
