"""Analytical SQL over the star schema, run with ``spark.sql`` on DataFrame arguments.

Facts are counted per key first and joined to the dimensions as counts, so that
a hot key is one row of the join.

Windows without PARTITION BY appear only over one row per year; years come from
a four-digit label, so there are at most ten thousand of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

YEARLY_GROWTH = """
WITH keyed AS (
    SELECT batch_id, count(*) AS n FROM {companies} GROUP BY batch_id
), yearly AS (
    SELECT b.year, sum(k.n) AS n
    FROM keyed k JOIN {batches} b ON k.batch_id = b.batch_id
    WHERE b.year IS NOT NULL
    GROUP BY b.year
)
SELECT year, n,
       lag(n) OVER (ORDER BY year) AS prev_n,
       try_divide(100.0D * (n - lag(n) OVER (ORDER BY year)), lag(n) OVER (ORDER BY year)) AS yoy_pct,
       avg(n) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3y
FROM yearly
"""

OUTCOME_RATES = """
WITH keyed AS (
    SELECT industry_id, batch_id, count(*) AS n, sum(is_operating) AS operating,
           count_if(status = 'Acquired') AS acquired, count_if(status = 'Inactive') AS inactive
    FROM {companies} GROUP BY industry_id, batch_id
)
SELECT i.industry,
       sum(k.n) AS n,
       100.0D * sum(k.operating) / sum(k.n) AS operating_pct,
       100.0D * sum(k.acquired) / sum(k.n) AS acquired_pct,
       100.0D * sum(k.inactive) / sum(k.n) AS inactive_pct
FROM keyed k
JOIN {industries} i ON k.industry_id = i.industry_id
JOIN {batches} b ON k.batch_id = b.batch_id
WHERE b.batch_status = 'complete' AND i.industry <> 'Unspecified'
GROUP BY i.industry
HAVING sum(k.n) >= {min_n}
"""

FLAG_SHARE = """
WITH keyed AS (
    SELECT batch_id, count(*) AS n, sum(ai_tag) AS tagged, count(ai_tag) AS known_tags, sum(is_ai) AS broad, count(is_ai) AS known
    FROM {companies} GROUP BY batch_id
)
SELECT b.year, sum(k.n) AS n,
       100.0D * try_divide(sum(k.tagged), sum(k.known_tags)) AS tag_based,
       100.0D * try_divide(sum(k.broad), sum(k.known)) AS broad
FROM keyed k JOIN {batches} b ON k.batch_id = b.batch_id
WHERE b.year IS NOT NULL
GROUP BY b.year
HAVING sum(k.n) >= {min_n}
"""

COHORT_MIX = """
WITH keyed AS (
    SELECT batch_id, industry_id, count(*) AS n FROM {companies} GROUP BY batch_id, industry_id
), mix AS (
    SELECT b.year, i.industry, sum(k.n) AS n
    FROM keyed k
    JOIN {batches} b ON k.batch_id = b.batch_id
    JOIN {industries} i ON k.industry_id = i.industry_id
    WHERE b.year IS NOT NULL AND i.industry IS NOT NULL
    GROUP BY b.year, i.industry
), ranked AS (
    SELECT year, industry, n,
           100.0D * n / sum(n) OVER (PARTITION BY year) AS share_pct,
           rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank
    FROM mix
)
SELECT year, industry, n, share_pct, rank FROM ranked WHERE rank <= {top}
"""


def run(spark, query: str, tables: Mapping[str, DataFrame], **values) -> DataFrame:
    """Run one of the queries on the star tables."""
    used = {name: df for name, df in tables.items() if "{" + name + "}" in query}
    return spark.sql(query, **used, **values)
