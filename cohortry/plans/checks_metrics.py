"""Bound analytics queries and their SQL for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import metrics, starsql
from cohortry.operators.filters import Filters, apply_filters
from cohortry.plans.bindings import cohort_view, parts_view, table, with_cohort

YEARS = (1995, 2001)


def _round(df: DataFrame) -> DataFrame:
    return metrics.rounded(df, 6)


def _complete(spark: SparkSession, sf: str) -> DataFrame:
    return apply_filters(cohort_view(spark, sf), Filters(years=YEARS))


COMPLETE = "d AS (SELECT * FROM cohort WHERE batch_year BETWEEN 1995 AND 2001 AND batch_status IN ('complete', 'unknown'))"


def _sql(body: str, *ctes: str) -> str:
    return with_cohort(", " + ", ".join([COMPLETE, *ctes]) + " " + body)


WILSON = """
    100 * greatest(0.0, ({k}/n::DOUBLE + 3.8416/(2*n)) / (1 + 3.8416/n)
        - 1.96 * sqrt(({k}/n::DOUBLE) * (1 - {k}/n::DOUBLE) / n + 3.8416/(4.0*n*n)) / (1 + 3.8416/n)) AS lo,
    100 * least(1.0, ({k}/n::DOUBLE + 3.8416/(2*n)) / (1 + 3.8416/n)
        + 1.96 * sqrt(({k}/n::DOUBLE) * (1 - {k}/n::DOUBLE) / n + 3.8416/(4.0*n*n)) / (1 + 3.8416/n)) AS hi
""".replace("{k}", "k")


# ---------------------------------------------------------------- filters
SPECS = {
    "all": Filters(years=YEARS),
    "with incomplete": Filters(years=YEARS, include_incomplete=True),
    "late years": Filters(years=(1998, 2000)),
    "two industries": Filters(years=YEARS, industries=("BUILDING", "FURNITURE")),
    "status and country": Filters(years=YEARS, statuses=("Active", "Public"), countries=("NATION_1", "NATION_2")),
    "flagged broad": Filters(years=YEARS, ai="AI"),
    "flagged tag": Filters(years=YEARS, ai="AI", ai_definition="tag"),
    "not flagged": Filters(years=YEARS, ai="Non-AI"),
    "sized or unknown": Filters(years=YEARS, team_range=(50, 150)),
    "sized": Filters(years=YEARS, team_range=(50, 150), include_unknown_team=False),
}
_SPEC_SQL = {
    "all": "batch_status IN ('complete', 'unknown')",
    "with incomplete": "TRUE",
    "late years": "batch_status IN ('complete', 'unknown') AND batch_year BETWEEN 1998 AND 2000",
    "two industries": "batch_status IN ('complete', 'unknown') AND industry IN ('BUILDING', 'FURNITURE')",
    "status and country": "batch_status IN ('complete', 'unknown') AND status IN ('Active', 'Public') "
                          "AND primary_country IN ('NATION_1', 'NATION_2')",
    "flagged broad": "batch_status IN ('complete', 'unknown') AND is_ai",
    "flagged tag": "batch_status IN ('complete', 'unknown') AND ai_tag",
    "not flagged": "batch_status IN ('complete', 'unknown') AND NOT is_ai",
    "sized or unknown": "batch_status IN ('complete', 'unknown') AND (team_size BETWEEN 50 AND 150 OR team_size IS NULL)",
    "sized": "batch_status IN ('complete', 'unknown') AND team_size BETWEEN 50 AND 150",
}


def filter_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, known sizes and key sum under each specification, from one scan."""
    hits = F.array(*[F.when(s.predicate(), F.lit(name)) for name, s in SPECS.items()])
    marked = cohort_view(spark, sf).select("company_id", "team_size", F.explode(F.array_compact(hits)).alias("spec"))
    return marked.groupBy("spec").agg(
        F.count("*").alias("n"), F.count("team_size").alias("sized"), F.sum("company_id").alias("key_sum")
    )


def filter_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with a status of the short list, a country of a list of 100,000 and an id of a table of orders, by status and country."""
    nations = tuple(r["n_name"] for r in table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select("n_name").collect())
    spec = Filters(years=(1992, 1998), statuses=("Active", "Public"), countries=(*nations, *[f"place {k}" for k in range(100_000)]))
    wanted = table(spark, sf, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("company_id"))
    kept = apply_filters(cohort_view(spark, sf), spec, {"company_id": wanted})
    return kept.groupBy("status", "primary_country").agg(F.count("*").alias("n"), F.sum("company_id").alias("key_sum"))


def filter_rows(spark: SparkSession, sf: str) -> DataFrame:
    return apply_filters(cohort_view(spark, sf), SPECS["status and country"]).select(
        "company_id", "batch", "industry", "status", "primary_country", "team_size"
    )


def drop_incomplete_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a null in a named column dropped, counted per year."""
    known = cohort_view(spark, sf).na.drop(subset=["industry", "primary_country", "batch_year", "team_size"])
    return known.groupBy("batch_year").agg(F.count("*").alias("n"))


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.explorer(cohort_view(spark, sf), "BUYS FURN").select(
        "name", "batch", "industry", "one_liner", "team_size", "is_ai"
    )


def document_search(spark: SparkSession, sf: str) -> DataFrame:
    """Literal search in whole texts, matches per source."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("text").alias("one_liner"), "doc_id")
    found = metrics.explorer(docs, "eren", ("name", "doc_id"))
    return found.groupBy(F.col("name").alias("source")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


# ---------------------------------------------------------------- star views for SQL
def _star(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Narrow star tables of the cohort view with labels as keys."""
    base = cohort_view(spark, sf)
    pair = F.to_json(F.struct("industry", "subindustry"))
    companies = base.select(
        "company_id", F.col("batch").alias("batch_id"), pair.alias("industry_id"), "status",
        F.col("is_operating").cast("int").alias("is_operating"),
        F.col("ai_tag").cast("int").alias("ai_tag"), F.col("is_ai").cast("int").alias("is_ai"),
    )
    batches = base.select(F.col("batch").alias("batch_id"), F.col("batch_year").alias("year"), "batch_status").distinct()
    industries = base.select("industry", "subindustry").distinct().withColumn("industry_id", pair)
    return {"companies": companies, "batches": batches, "industries": industries}


def growth_lag(spark: SparkSession, sf: str) -> DataFrame:
    return _round(starsql.run(spark, starsql.YEARLY_GROWTH, _star(spark, sf)))


def outcome_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _round(starsql.run(spark, starsql.OUTCOME_RATES, _star(spark, sf), min_n=20))


def flag_share_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _round(starsql.run(spark, starsql.FLAG_SHARE, _star(spark, sf), min_n=20))


def cohort_mix_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _round(starsql.run(spark, starsql.COHORT_MIX, _star(spark, sf), top=3))


QUERIES = {
    "filter_spec": filter_spec,
    "filter_allowed": filter_allowed,
    "filter_rows": filter_rows,
    "drop_incomplete_rows": drop_incomplete_rows,
    "text_search": text_search,
    "document_search": document_search,
    "kpi_row": lambda s, d: _round(metrics.kpis(_complete(s, d))),
    "per_cohort": lambda s, d: metrics.per_batch(_complete(s, d)),
    "year_status": lambda s, d: metrics.year_status(_complete(s, d)),
    "top_counts": lambda s, d: metrics.top_counts(_complete(s, d), "primary_city", 15),
    "country_log_counts": lambda s, d: _round(
        metrics.log_counts(metrics.value_counts(_complete(s, d).filter(F.col("primary_country").isNotNull()), "primary_country"))),
    "status_distribution": lambda s, d: metrics.value_counts(_complete(s, d), "status"),
    "status_mix": lambda s, d: _round(metrics.status_mix(_complete(s, d))),
    "median_by_year": lambda s, d: _round(metrics.median_by_year(_complete(s, d))),
    "size_histogram": lambda s, d: _round(metrics.log_histogram(_complete(s, d), "team_size")),
    "crosstab_columns": lambda s, d: _round(
        metrics.crosstab_share(metrics.specified(_complete(s, d), "industry"), "industry", "batch_year", 3)),
    "crosstab_rows": lambda s, d: _round(
        metrics.crosstab_share(metrics.specified(_complete(s, d), "industry"), "primary_country", "industry", 12, "index")),
    "crosstab_display": lambda s, d: metrics.rounded(metrics.wide(
        metrics.crosstab_share(_complete(s, d), "subindustry", "batch_status", 5), "subindustry", "batch_status",
        "share_pct", ["complete", "unknown"]), 1),
    "rate_wilson": lambda s, d: _round(metrics.rate_by_group(_complete(s, d), "primary_country", "is_operating", 30)),
    "rate_acquired": lambda s, d: _round(metrics.ranked_rates(metrics.rate_by_group(
        metrics.specified(_complete(s, d), "industry"), "industry", F.col("status") == "Acquired", 30), "industry", 20)),
    "flag_rate_industry": lambda s, d: _round(metrics.ranked_rates(metrics.rate_by_group(
        metrics.specified(_complete(s, d), "subindustry"), "subindustry", "is_ai", 20), "subindustry")),
    "flag_share_year": lambda s, d: _round(metrics.flag_share_by_year(_complete(s, d))),
    "momentum": lambda s, d: _round(metrics.momentum(_complete(s, d), "primary_country", 2, 5)),
    "momentum_industry": lambda s, d: _round(metrics.momentum(
        metrics.specified(_complete(s, d), "industry"), "industry", 3, 20)),
    "momentum_short": lambda s, d: _round(metrics.momentum(_complete(s, d), "industry", 5, 1)),
    "momentum_extremes": lambda s, d: _round(metrics.extremes(
        metrics.momentum(_complete(s, d), "primary_country", 2, 5), "share_change_pp", "primary_country", 8)),
    "insight_facts": lambda s, d: _round(metrics.insight_facts(_complete(s, d))),
    "top_tags": lambda s, d: metrics.top_tags(parts_view(s, d), "is_large", n=10),
    "top_tags_flagged": lambda s, d: metrics.top_tags(_complete(s, d), "is_ai", n=8),
    "unknown_counts": lambda s, d: metrics.unknown_counts(_complete(s, d)),
    "frequent_groups": lambda s, d: metrics.frequent_groups(cohort_view(s, d), "primary_country", 100),
    "picklists": lambda s, d: metrics.picklists(cohort_view(s, d)),
    "concentration": lambda s, d: _round(metrics.concentration(_complete(s, d), "primary_country")),
    "city_concentration": lambda s, d: _round(metrics.concentration(_complete(s, d), "primary_city")),
    "growth_lag": growth_lag,
    "outcome_rates": outcome_rates,
    "flag_share_sql": flag_share_sql,
    "cohort_mix_rank": cohort_mix_rank,
}


def _rate(group: str, flag: str, min_n: int, where: str = "TRUE") -> str:
    return _sql(
        f"SELECT {group}, k, n, round(100.0*k/n, 6) AS rate, round(lo, 6) AS lo, round(hi, 6) AS hi FROM "
        f"(SELECT *, {WILSON} FROM g)",
        f"g AS (SELECT {group}, count(*) FILTER (WHERE {flag}) AS k, count(*) AS n FROM d "
        f"WHERE {group} IS NOT NULL AND {where} GROUP BY 1 HAVING count(*) >= {min_n})",
    )


def _crosstab(row: str, col: str, top_n: int, whole: str, where: str) -> str:
    return _sql(
        f"SELECT t.{row}, c.{col}, coalesce(p.n, 0)::BIGINT AS n, "
        f"round(100.0 * coalesce(p.n, 0) / {whole}, 6) AS share_pct "
        f"FROM t CROSS JOIN c LEFT JOIN p ON p.{row} = t.{row} AND p.{col} = c.{col}",
        f"x AS (SELECT * FROM d WHERE {row} IS NOT NULL AND {col} IS NOT NULL AND {where})",
        f"p AS (SELECT {row}, {col}, count(*) AS n FROM x GROUP BY ALL)",
        f"t AS (SELECT {row}, count(*) AS rn FROM x GROUP BY ALL ORDER BY rn DESC, {row} LIMIT {top_n})",
        f"c AS (SELECT {col}, count(*) AS cn FROM x GROUP BY ALL)",
    )


def _momentum(level: str, window: int, min_recent: int, where: str = "TRUE", tail: str = "SELECT * FROM m") -> str:
    return _sql(
        tail,
        f"x AS (SELECT {level}, batch_year AS y FROM d WHERE {level} IS NOT NULL AND batch_year IS NOT NULL AND {where})",
        "ys AS (SELECT y, row_number() OVER (ORDER BY y DESC) AS r, count(*) OVER () AS c FROM (SELECT DISTINCT y FROM x))",
        f"g AS (SELECT {level}, count(*) FILTER (WHERE r <= {window}) AS recent_n, "
        f"count(*) FILTER (WHERE r > {window} AND r <= {2 * window}) AS prior_n "
        f"FROM x JOIN ys USING (y) WHERE c >= {2 * window} GROUP BY 1)",
        f"s AS (SELECT {level}, recent_n, prior_n, 100.0 * recent_n / sum(recent_n) OVER () AS rs, "
        "100.0 * prior_n / sum(prior_n) OVER () AS ps FROM g WHERE recent_n + prior_n > 0)",
        f"m AS (SELECT {level}, recent_n, prior_n, round(rs, 6) AS recent_share_pct, round(ps, 6) AS prior_share_pct, "
        "round(rs - ps, 6) AS share_change_pp, "
        "round(CASE WHEN prior_n > 0 THEN 100 * (recent_n / prior_n::DOUBLE - 1) END, 6) AS count_growth_pct "
        f"FROM s WHERE recent_n >= {min_recent})",
    )


def _concentration(group: str) -> str:
    return _sql(
        f"SELECT {group}, n, rank() OVER (ORDER BY n DESC) AS rank, round(100.0 * n / sum(n) OVER (), 6) AS share_pct, "
        f"round(100.0 * sum(n) OVER (ORDER BY n DESC, {group} ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share_pct "
        "FROM g",
        f"g AS (SELECT {group}, count(*) AS n FROM d WHERE {group} IS NOT NULL GROUP BY 1)",
    )


NOT_UNSPECIFIED = "industry IS DISTINCT FROM 'Unspecified'"

ORACLES = {
    "filter_allowed": with_cohort(
        " SELECT status, primary_country, count(*) AS n, sum(company_id)::BIGINT AS key_sum FROM cohort "
        "WHERE batch_year BETWEEN 1992 AND 1998 AND batch_status IN ('complete', 'unknown') AND status IN ('Active', 'Public') "
        "AND primary_country IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) "
        "AND company_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') GROUP BY ALL"),
    "filter_spec": with_cohort(" UNION ALL ".join(
        f"SELECT '{name}' AS spec, count(*) AS n, count(team_size) AS sized, sum(company_id)::BIGINT AS key_sum "
        f"FROM cohort WHERE batch_year BETWEEN 1995 AND 2001 AND {where}" for name, where in _SPEC_SQL.items())),
    "filter_rows": _sql(
        "SELECT company_id, batch, industry, status, primary_country, team_size FROM d "
        "WHERE status IN ('Active', 'Public') AND primary_country IN ('NATION_1', 'NATION_2')"),
    "drop_incomplete_rows": with_cohort(
        "SELECT batch_year, count(*) AS n FROM cohort WHERE industry IS NOT NULL AND primary_country IS NOT NULL "
        "AND batch_year IS NOT NULL AND team_size IS NOT NULL GROUP BY 1"),
    "text_search": with_cohort(
        "SELECT name, batch, industry, one_liner, team_size, is_ai FROM cohort "
        "WHERE contains(lower(coalesce(name, '')) || ' ' || lower(coalesce(one_liner, '')), 'buys furn')"),
    "document_search": (
        "SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents "
        "WHERE contains(lower(source || ' ' || text), 'eren') GROUP BY 1"),
    "kpi_row": _sql(
        "SELECT count(*) AS total, round(100 * avg(is_operating::INT), 6) AS operating_pct, "
        "count(*) FILTER (WHERE status = 'Acquired') AS acquired, "
        "count(DISTINCT industry) FILTER (WHERE industry <> 'Unspecified') AS industries, "
        "count(DISTINCT primary_country) AS countries, count(DISTINCT primary_city) AS cities, "
        "round(100 * avg(is_ai::INT), 6) AS ai_share_pct, median(team_size)::DOUBLE AS median_team_size FROM d"),
    "per_cohort": _sql(
        "SELECT batch, batch_order, batch_season, count(*) AS n FROM d WHERE batch_order IS NOT NULL GROUP BY ALL"),
    "year_status": _sql("SELECT batch_year AS year, status, count(*) AS n FROM d GROUP BY ALL"),
    "top_counts": _sql(
        "SELECT primary_city, count(*) AS n FROM d WHERE primary_city IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15"),
    "country_log_counts": _sql(
        "SELECT primary_country, count(*) AS n, round(log10(count(*)), 6) AS log10_n FROM d "
        "WHERE primary_country IS NOT NULL GROUP BY 1"),
    "status_distribution": _sql("SELECT status, count(*) AS n FROM d GROUP BY 1"),
    "status_mix": _crosstab("status", "batch_year", 10**9, "cn", "TRUE"),
    "median_by_year": _sql(
        "SELECT batch_year AS year, round(quantile_cont(team_size, 0.5), 6) AS median FROM d "
        "WHERE team_size IS NOT NULL GROUP BY 1"),
    "size_histogram": _sql(
        "SELECT bin, round(pow(10.0, lo + w * (bin - 1) / 40), 6) AS low, round(pow(10.0, lo + w * bin / 40), 6) AS high, "
        "sum(c)::BIGINT AS n FROM (SELECT c, lo, w, least(floor((log10(v) - lo) * 40 / w) + 1, 40)::INT AS bin "
        "FROM v, s) GROUP BY bin, lo, w",
        "v AS (SELECT team_size AS v, count(*) AS c FROM d WHERE team_size > 0 GROUP BY 1)",
        "s AS (SELECT log10(min(v)) AS lo, log10(max(v)) - log10(min(v)) AS w FROM v)"),
    "crosstab_columns": _crosstab("industry", "batch_year", 3, "cn", NOT_UNSPECIFIED),
    "crosstab_rows": _crosstab("primary_country", "industry", 12, "rn", NOT_UNSPECIFIED),
    "crosstab_display": _sql(
        "SELECT subindustry, round(100.0 * count(*) FILTER (WHERE batch_status = 'complete') / max(c), 1) AS complete, "
        "NULL::DOUBLE AS \"unknown\" FROM (SELECT *, count(*) OVER (PARTITION BY batch_status) AS c FROM d "
        "WHERE subindustry IS NOT NULL) GROUP BY 1"),
    "rate_wilson": _rate("primary_country", "is_operating", 30),
    "rate_acquired": _rate("industry", "status = 'Acquired'", 30, NOT_UNSPECIFIED),
    "flag_rate_industry": _rate("subindustry", "is_ai", 20),
    "flag_share_year": _sql(
        "SELECT batch_year AS year, count(*) AS n, round(100 * avg(ai_tag::INT), 6) AS tag_based, "
        "round(100 * avg(is_ai::INT), 6) AS broad FROM d GROUP BY 1"),
    "momentum": _momentum("primary_country", 2, 5),
    "momentum_industry": _momentum("industry", 3, 20, NOT_UNSPECIFIED),
    "momentum_short": _momentum("industry", 5, 1),
    "momentum_extremes": _momentum(
        "primary_country", 2, 5,
        tail="SELECT m.* FROM m JOIN s USING (primary_country) "
             "QUALIFY row_number() OVER (ORDER BY rs - ps DESC, primary_country) <= 5 "
             "OR row_number() OVER (ORDER BY rs - ps, primary_country DESC) <= 5"),
    "insight_facts": _sql(
        "SELECT metric, key, round(value, 6) AS value FROM ("
        "SELECT * FROM (SELECT 'largest_batch' AS metric, batch AS key, count(*)::DOUBLE AS value FROM d "
        "WHERE batch_order IS NOT NULL GROUP BY batch, batch_order ORDER BY value DESC, batch_order LIMIT 1) "
        "UNION ALL SELECT * FROM (SELECT 'top_industry', industry, 100.0 * count(*) / (SELECT count(*) FROM d) FROM d "
        "WHERE industry <> 'Unspecified' GROUP BY industry ORDER BY count(*) DESC, industry LIMIT 1) "
        "UNION ALL SELECT * FROM (SELECT 'top_country', primary_country, "
        "100.0 * count(*) / (SELECT count(primary_country) FROM d) FROM d "
        "WHERE primary_country IS NOT NULL GROUP BY primary_country ORDER BY count(*) DESC, primary_country LIMIT 1) "
        "UNION ALL SELECT 'operating', NULL, 100 * avg(is_operating::INT) FROM d "
        "UNION ALL SELECT 'acquired', NULL, 100 * avg((status = 'Acquired')::INT) FROM d "
        "UNION ALL SELECT 'flag_share_last', y1::VARCHAR, f FROM a, yy WHERE y = y1 AND y1 - 3 IN (SELECT y FROM a) "
        "UNION ALL SELECT 'flag_share_before', y::VARCHAR, f FROM a, yy WHERE y = y1 - 3)",
        "a AS (SELECT batch_year AS y, 100 * avg(is_ai::INT) AS f FROM d GROUP BY 1)",
        "yy AS (SELECT max(y) AS y1 FROM a)"),
    "top_tags": (
        "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part WHERE p_size > 25) "
        "GROUP BY 1 ORDER BY n DESC, tag LIMIT 10"),
    "top_tags_flagged": _sql(
        "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM d WHERE is_ai) GROUP BY 1 "
        "ORDER BY n DESC, tag LIMIT 8"),
    "unknown_counts": _sql(
        "SELECT count(*) FILTER (WHERE primary_country IS NULL) AS no_location, "
        "count(*) FILTER (WHERE team_size IS NULL) AS no_size FROM d"),
    "frequent_groups": with_cohort(
        "SELECT primary_country, count(*) AS n FROM cohort WHERE primary_country IS NOT NULL GROUP BY 1 HAVING count(*) >= 100"),
    "picklists": with_cohort(
        "SELECT 'industry' AS list, (row_number() OVER (ORDER BY industry) - 1)::INT AS position, industry AS value "
        "FROM (SELECT DISTINCT industry FROM cohort WHERE industry IS NOT NULL) "
        "UNION ALL SELECT 'country', (row_number() OVER (ORDER BY n DESC, c) - 1)::INT, c FROM "
        "(SELECT primary_country AS c, count(*) AS n FROM cohort WHERE primary_country IS NOT NULL GROUP BY 1) "
        "QUALIFY row_number() OVER (ORDER BY n DESC, c) <= 40 "
        "UNION ALL SELECT 'year_min_max_complete', 0, min(batch_year)::VARCHAR FROM cohort "
        "UNION ALL SELECT 'year_min_max_complete', 1, max(batch_year)::VARCHAR FROM cohort "
        "UNION ALL SELECT 'year_min_max_complete', 2, max(batch_year)::VARCHAR FROM cohort WHERE batch_status = 'complete'"),
    "concentration": _concentration("primary_country"),
    "city_concentration": _concentration("primary_city"),
    "growth_lag": with_cohort(
        ", y AS (SELECT batch_year AS year, count(*) AS n FROM cohort WHERE batch_year IS NOT NULL GROUP BY 1) "
        "SELECT year, n, lag(n) OVER (ORDER BY year) AS prev_n, "
        "round(100.0 * (n - lag(n) OVER (ORDER BY year)) / lag(n) OVER (ORDER BY year), 6) AS yoy_pct, "
        "round(avg(n) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_3y FROM y"),
    "outcome_rates": with_cohort(
        "SELECT industry, count(*) AS n, round(100 * avg(is_operating::INT), 6) AS operating_pct, "
        "round(100 * avg((status = 'Acquired')::INT), 6) AS acquired_pct, "
        "round(100 * avg((status = 'Inactive')::INT), 6) AS inactive_pct FROM cohort "
        "WHERE batch_status = 'complete' AND industry <> 'Unspecified' GROUP BY 1 HAVING count(*) >= 20"),
    "flag_share_sql": with_cohort(
        "SELECT batch_year AS year, count(*) AS n, round(100 * avg(ai_tag::INT), 6) AS tag_based, "
        "round(100 * avg(is_ai::INT), 6) AS broad FROM cohort WHERE batch_year IS NOT NULL GROUP BY 1 HAVING count(*) >= 20"),
    "cohort_mix_rank": with_cohort(
        ", m AS (SELECT batch_year AS year, industry, count(*) AS n FROM cohort "
        "WHERE batch_year IS NOT NULL AND industry IS NOT NULL GROUP BY ALL) "
        "SELECT year, industry, n, round(100.0 * n / sum(n) OVER (PARTITION BY year), 6) AS share_pct, "
        "(rank() OVER (PARTITION BY year ORDER BY n DESC))::INT AS rank FROM m "
        "QUALIFY rank() OVER (PARTITION BY year ORDER BY n DESC) <= 3"),
}
