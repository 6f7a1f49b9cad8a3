"""Answers about a selection of the feature table, all in long form.

Every result is a grouped count first; shares, intervals and ranks are
computed on the grouped rows.  Ties are broken by the key, ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.stats import percent, wilson
from cohortry.operators.ordering import dense_number, exact_quantiles, running_totals
from cohortry.schemas import UNSPECIFIED


def specified(df: DataFrame, column: str) -> DataFrame:
    """Rows whose group is not the literal 'Unspecified'; null groups stay."""
    return df.filter(~F.col(column).eqNullSafe(UNSPECIFIED))


def kpis(df: DataFrame, flag: str = "is_ai") -> DataFrame:
    """One row of headline numbers; no row for an empty selection."""
    median = exact_quantiles(df, F.col("team_size"), {"median": 0.5}).scalar()
    row = df.agg(
        F.count("*").alias("total"),
        (F.avg(F.col("is_operating").cast("double")) * 100).alias("operating_pct"),
        F.count_if(F.col("status") == "Acquired").alias("acquired"),
        F.count_distinct(F.when(F.col("industry") != UNSPECIFIED, F.col("industry"))).alias("industries"),
        F.count_distinct("primary_country").alias("countries"),
        F.count_distinct("primary_city").alias("cities"),
        (F.avg(F.col(flag).cast("double")) * 100).alias("ai_share_pct"),
    )
    return row.filter("total > 0").withColumn("median_team_size", median)


def per_batch(df: DataFrame) -> DataFrame:
    """Count per cohort in time order; cohorts without an order are left out."""
    known = df.filter(F.col("batch_order").isNotNull() & F.col("batch").isNotNull())
    return known.groupBy("batch", "batch_order", "batch_season").agg(F.count("*").alias("n")).orderBy(
        "batch_order", "batch"
    )


def year_status(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("batch_year").isNotNull() & F.col("status").isNotNull())
    return known.groupBy(F.col("batch_year").alias("year"), "status").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(n)


def log_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("log10_n", F.log10("n"))


def crosstab_share(df: DataFrame, row: str, col: str, top_n: int | None = 10, normalize: str = "columns") -> DataFrame:
    """Rows (row, col, n, share_pct) for the ``top_n`` most frequent rows (None: all) and every column value.

    Shares are of all rows, so a truncated column need not sum to 100.  Absent
    pairs appear with zero: each column value is combined with the list of rows,
    as the zero-filled matrix has a cell for each pair.
    """
    known = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    pairs = known.groupBy(row, col).agg(F.count("*").alias("n"))
    rows = pairs.groupBy(F.col(row).alias("_row")).agg(F.sum("n").alias("_row_n"))
    if top_n is not None:
        rows = rows.orderBy(F.desc("_row_n"), "_row").limit(top_n)
    per_col = pairs.groupBy(F.col(col).alias("_col")).agg(F.sum("n").alias("_col_n"))
    spine = per_col.withColumn("_top", rows.agg(F.collect_list(F.struct("_row", "_row_n"))).scalar()).select("_col", "_col_n", F.inline("_top"))
    filled = spine.join(pairs, (F.col("_row") == F.col(row)) & (F.col("_col") == F.col(col)), "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    whole = F.col("_col_n" if normalize == "columns" else "_row_n")
    return filled.select(
        F.col("_row").alias(row), F.col("_col").alias(col), n.alias("n"), percent(n, whole).alias("share_pct")
    )


def wide(df: DataFrame, row: str, col: str, value: str, columns: list) -> DataFrame:
    """Matrix for display; the column values are given, so no extra job runs."""
    return df.groupBy(row).pivot(col, columns).agg(F.first(value))


def status_mix(df: DataFrame) -> DataFrame:
    """Percent of each status within a year, zero-filled."""
    statuses = crosstab_share(df, "status", "batch_year", top_n=None, normalize="columns")
    return statuses.select("batch_year", "status", "n", "share_pct")


def rate_by_group(df: DataFrame, group: str, flag: str | Column, min_n: int = 30) -> DataFrame:
    """Share of flagged rows per group with a 95 % Wilson interval, groups of at least ``min_n`` rows."""
    flagged = F.col(flag) if isinstance(flag, str) else flag
    counts = (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count_if(flagged).alias("k"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_n)
    )
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select(
        group, "k", "n", percent(F.col("k"), F.col("n")).alias("rate"),
        (low * 100).alias("lo"), (high * 100).alias("hi"),
    )


def ranked_rates(rates: DataFrame, group: str, n: int | None = None) -> DataFrame:
    ranked = rates.orderBy(F.desc("rate"), group)
    return ranked if n is None else ranked.limit(n)


def flag_share_by_year(df: DataFrame) -> DataFrame:
    """Per year: count and percent flagged under both definitions."""
    return df.filter(F.col("batch_year").isNotNull()).groupBy(F.col("batch_year").alias("year")).agg(
        F.count("*").alias("n"),
        (F.avg(F.col("ai_tag").cast("double")) * 100).alias("tag_based"),
        (F.avg(F.col("is_ai").cast("double")) * 100).alias("broad"),
    )


def momentum(df: DataFrame, level: str = "industry", window: int = 3, min_recent: int = 20) -> DataFrame:
    """Change in each group's share between the last ``window`` years present and the ones before.

    Empty when fewer than two windows of years are present.  Shares are of all
    groups; ``min_recent`` only thins the result.
    """
    known = df.filter(F.col(level).isNotNull() & F.col("batch_year").isNotNull())
    years = (
        known.select("batch_year").distinct().orderBy(F.desc("batch_year")).limit(2 * window)
        .agg(F.sort_array(F.collect_list("batch_year"), asc=False))
    ).scalar()
    counts = known.groupBy(level, "batch_year").agg(F.count("*").alias("_n")).withColumn("_years", years)
    enough = counts.filter(F.size("_years") == 2 * window)
    recent = F.array_contains(F.slice("_years", 1, window), F.col("batch_year"))
    prior = F.array_contains(F.slice("_years", window + 1, window), F.col("batch_year"))

    def windowed(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    groups = enough.groupBy(level).agg(
        windowed(recent).alias("recent_n"), windowed(prior).alias("prior_n")
    ).filter("recent_n + prior_n > 0")
    totals = enough.agg(F.struct(windowed(recent).alias("recent"), windowed(prior).alias("prior")))
    shares = groups.withColumn("_all", totals.scalar()).select(
        level, "recent_n", "prior_n",
        percent(F.col("recent_n"), F.col("_all.recent")).alias("recent_share_pct"),
        percent(F.col("prior_n"), F.col("_all.prior")).alias("prior_share_pct"),
    )
    growth = (F.try_divide(F.col("recent_n").cast("double"), "prior_n") - 1) * 100
    return shares.withColumns({
        "share_change_pp": F.col("recent_share_pct") - F.col("prior_share_pct"),
        "count_growth_pct": growth,
    }).filter(F.col("recent_n") >= min_recent)


def extremes(ranked: DataFrame, value: str, key: str, top_n: int) -> DataFrame:
    """The first and last ``top_n // 2 + 1`` rows by value, each row once, ascending."""
    k = top_n // 2 + 1
    first = ranked.orderBy(F.desc(value), key).limit(k)
    last = ranked.orderBy(F.asc(value), F.desc(key)).limit(k)
    return first.unionByName(last).dropDuplicates([key]).orderBy(value, F.desc(key))


def insight_facts(df: DataFrame, flag: str = "is_ai") -> DataFrame:
    """Facts (metric, key, value) of a selection; one scan through grouping sets.

    largest_batch (count), top_industry (% of all rows), top_country (% of rows
    with a known country), operating, acquired (%), flag_share_last and
    flag_share_before (% in the last year and three years before, when both
    exist).  An empty selection has no facts.
    """
    base = df.select(
        F.struct("batch_order", "batch").alias("_batch"),
        F.when(F.col("industry") != UNSPECIFIED, F.col("industry")).alias("_industry"),
        F.col("primary_country").alias("_country"),
        F.col("batch_year").alias("_year"),
        F.col("is_operating").cast("int").alias("_op"),
        (F.col("status") == "Acquired").cast("int").alias("_acq"),
        F.col(flag).cast("int").alias("_flag"),
    )
    sets = [[F.col("_batch")], [F.col("_industry")], [F.col("_country")], [F.col("_year")], []]
    grouped = base.groupingSets(sets, "_batch", "_industry", "_country", "_year").agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n"),
        F.sum("_op").alias("op"), F.sum("_acq").alias("acq"), F.sum("_flag").alias("flagged"),
    )
    in_batch, in_industry, in_country, in_year, whole = (F.col("_set") == s for s in (7, 11, 13, 14, 15))
    batch_known = in_batch & F.col("_batch.batch_order").isNotNull() & F.col("_batch.batch").isNotNull()
    largest = F.max(F.when(batch_known, F.struct(
        F.col("n").alias("n"), (-F.col("_batch.batch_order")).alias("o"), F.col("_batch.batch").alias("key"))))

    def top(condition: Column, name: str) -> Column:
        # Smallest (-n, name) is the largest count, ties to the smaller name.
        return F.min(F.when(condition & F.col(name).isNotNull(), F.struct((-F.col("n")).alias("m"), F.col(name).alias("key"))))

    years = F.map_from_entries(F.collect_list(F.when(
        in_year & F.col("_year").isNotNull(),
        F.struct(F.col("_year"), percent(F.col("flagged"), F.col("n"))))))
    one = grouped.agg(
        largest.alias("b"), top(in_industry, "_industry").alias("i"), top(in_country, "_country").alias("c"),
        F.sum(F.when(in_country & F.col("_country").isNotNull(), F.col("n"))).alias("known"),
        F.max(F.when(whole, F.col("n"))).alias("n"),
        F.max(F.when(whole, F.col("op"))).alias("op"), F.max(F.when(whole, F.col("acq"))).alias("acq"),
        F.max(F.when(in_year, F.col("_year"))).alias("y"),
        years.alias("ys"),
    )
    none = F.lit(None).cast("string")

    def fact(metric: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    before = F.try_element_at("ys", F.col("y") - 3)
    facts = F.array(
        fact("largest_batch", F.col("b.key"), F.col("b.n")),
        fact("top_industry", F.col("i.key"), percent(-F.col("i.m"), F.col("n"))),
        fact("top_country", F.col("c.key"), percent(-F.col("c.m"), F.col("known"))),
        fact("operating", none, percent(F.col("op"), F.col("n"))),
        fact("acquired", none, percent(F.col("acq"), F.col("n"))),
        fact("flag_share_last", F.col("y"), F.when(before.isNotNull(), F.try_element_at("ys", "y"))),
        fact("flag_share_before", F.col("y") - 3, before),
    )
    return one.filter("n > 0").select(F.inline(facts)).filter("value is not null")


def median_by_year(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("team_size").isNotNull() & F.col("batch_year").isNotNull())
    known = known.withColumn("year", F.col("batch_year"))
    return exact_quantiles(known, F.col("team_size"), {"median": 0.5}, by=["year"])


def log_histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Rows (bin, low, high, n): equal bins of log10 over the positive values, empty bins left out."""
    counts = df.filter(F.col(column) > 0).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    span = counts.agg(F.struct(
        F.log10(F.min("_v")).alias("low"), F.log10(F.max("_v")).alias("high"))).scalar()
    placed = counts.withColumn("_s", span).withColumn("_w", F.col("_s.high") - F.col("_s.low"))
    at = F.floor(F.try_divide((F.log10("_v") - F.col("_s.low")) * bins, "_w"))
    placed = placed.withColumn("bin", F.least(F.coalesce(at, F.lit(0)) + 1, F.lit(bins)).cast("int"))
    grouped = placed.groupBy("bin").agg(F.sum("_n").alias("n"), F.first("_s").alias("_s"), F.first("_w").alias("_w"))

    def edge(index: Column) -> Column:
        return F.pow(F.lit(10.0), F.col("_s.low") + F.col("_w") * index / bins)

    return grouped.select("bin", edge(F.col("bin") - 1).alias("low"), edge(F.col("bin")).alias("high"), "n")


def top_tags(df: DataFrame, flag: str, tags: str = "tags", n: int = 10) -> DataFrame:
    """Most frequent tags among flagged rows."""
    return top_counts(df.filter(F.col(flag)).select(F.explode(tags).alias("tag")), "tag", n)


def unknown_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.col("primary_country").isNull()).alias("no_location"),
        F.count_if(F.col("team_size").isNull()).alias("no_size"),
    )


def frequent_groups(df: DataFrame, column: str, min_n: int = 100) -> DataFrame:
    """Groups of at least ``min_n`` rows, 'Unspecified' left out, most frequent first."""
    return value_counts(specified(df, column), column).filter(F.col("n") >= min_n).orderBy(F.desc("n"), column)


def picklists(df: DataFrame, countries: int = 40) -> DataFrame:
    """Rows (list, position, value): all groups by name, the most frequent countries, and year bounds (runs a job).

    The groups are numbered without gathering them; the other lists are short by definition.
    """
    groups = df.filter(F.col("industry").isNotNull()).select("industry").distinct()
    names = dense_number(groups, F.col("industry"), "_n")
    top = top_counts(df, "primary_country", countries).agg(F.collect_list("primary_country").alias("v"))
    bounds = df.agg(F.array(
        F.min("batch_year").cast("string"), F.max("batch_year").cast("string"),
        F.max(F.when(F.col("batch_status") == "complete", F.col("batch_year"))).cast("string"),
    ).alias("v"))
    out = names.select(F.lit("industry").alias("list"), (F.col("_n") - 1).cast("int").alias("position"), F.col("industry").alias("value"))
    for name, values in (("country", top), ("year_min_max_complete", bounds)):
        out = out.unionByName(values.select(F.lit(name).alias("list"), F.posexplode("v").alias("position", "value")))
    return out


EXPLORER = (
    "name", "batch", "industry", "subindustry", "primary_city", "primary_country", "status", "team_size", "is_ai",
    "one_liner", "website", "profile_url",
)


def explorer(df: DataFrame, query: str = "", columns: tuple[str, ...] = EXPLORER) -> DataFrame:
    """Rows whose name or one-liner contains the text, sorted by name regardless of case."""
    from cohortry.functions.text import contains_literal

    found = df.filter(contains_literal(query, F.col("name"), F.col("one_liner"))) if query else df
    return found.select(*columns).orderBy(F.lower("name"), "name")


def concentration(df: DataFrame, group: str) -> DataFrame:
    """Rank, share and cumulative share per group, largest first (ties share a rank)."""
    counts = value_counts(df, group)
    total = counts.agg(F.sum("n")).scalar()
    cumulated = running_totals(counts, F.struct(-F.col("n"), F.col(group)), {"_cum": F.col("n")})
    sizes = counts.groupBy(F.col("n").alias("_size")).agg(F.count("*").alias("_groups"))
    ranks = running_totals(sizes, -F.col("_size"), {"_upto": F.col("_groups")}).select(
        "_size", (F.col("_upto") - F.col("_groups") + 1).alias("rank")
    )
    return cumulated.join(ranks, F.col("n") == F.col("_size")).withColumn("_total", total).select(
        group, "n", "rank", percent(F.col("n"), F.col("_total")).alias("share_pct"),
        percent(F.col("_cum"), F.col("_total")).alias("cum_share_pct"),
    )


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded for display, other columns untouched."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])
