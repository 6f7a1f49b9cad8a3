"""The driver's tables shaped as inputs: raw records and a feature-like cohort view.

The shaping is one SQL text per input, in the subset of SQL that Spark and the
checking engine share (``{array}`` stands for their list constructors).  It
plants nulls, odd white space and odd values, because the tables have none.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2001, 8, 1)

_ORDERS = """
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey
LEFT JOIN {nation} ON c_nationkey = n_nationkey
"""

# One row per order in the shape of the feature table.
COHORT = """
SELECT company_id, name, one_liner, website, profile_url, stage,
       CASE WHEN known THEN season || ' ' || CAST(y AS STRING) ELSE 'Unspecified' END AS batch,
       CASE WHEN known THEN season END AS batch_season,
       CASE WHEN known THEN y END AS batch_year,
       CASE WHEN known THEN y * 100 + start_month END AS batch_order,
       CASE WHEN NOT known THEN 'unknown'
            WHEN make_date(y, start_month, 1) > DATE '2001-04-03' THEN 'in_progress'
            ELSE 'complete' END AS batch_status,
       industry, subindustry, status, status IN ('Active', 'Public') AS is_operating,
       primary_country, primary_city, team_size, ai_tag, ai_tag OR big AS is_ai, tags,
       y * 12 + m - 1 AS month_t,
       CASE WHEN y * 12 + m - 1 >= 24019 THEN 'in_progress' ELSE 'complete' END AS month_status
FROM (
    SELECT o_orderkey AS company_id,
           'Order ' || CAST(o_orderkey AS STRING) AS name,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE c_name || ' buys ' || lower(c_mktsegment) END AS one_liner,
           'https://example.com/' || CAST(o_orderkey AS STRING) AS website,
           'https://directory.example.com/' || CAST(o_orderkey AS STRING) AS profile_url,
           CASE WHEN o_totalprice > 250000 THEN 'Growth' ELSE 'Early' END AS stage,
           CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
           CASE WHEN month(o_orderdate) <= 3 THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring'
                WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS season,
           CASE WHEN month(o_orderdate) <= 3 THEN 1 WHEN month(o_orderdate) <= 5 THEN 4
                WHEN month(o_orderdate) <= 8 THEN 6 ELSE 9 END AS start_month,
           o_totalprice >= 3000 AS known,
           CASE WHEN c_acctbal < -900 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'Unspecified'
                ELSE c_mktsegment END AS industry,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS subindustry,
           CASE WHEN o_orderstatus = 'F' THEN 'Inactive' WHEN o_orderstatus = 'P' THEN 'Acquired'
                WHEN o_orderpriority = '1-URGENT' THEN 'Public' ELSE 'Active' END AS status,
           CASE WHEN c_acctbal > 9500 THEN NULL ELSE n_name END AS primary_country,
           CASE WHEN c_acctbal > 9500 THEN NULL ELSE n_name || '/' || c_mktsegment END AS primary_city,
           CASE WHEN o_totalprice >= 20000 THEN CAST(floor(o_totalprice / 1000) AS INT) END AS team_size,
           o_orderpriority IN ('1-URGENT', '2-HIGH') AS ai_tag,
           o_totalprice >= 300000 AS big,
           {array}(o_orderpriority, c_mktsegment, n_name) AS tags
""" + _ORDERS + """
) AS orders_shaped
"""

# Raw records: orders with dirty text, and urgent ones a second time with a new name.
RAW = """
SELECT o_orderkey AS id, version,
       CASE WHEN version = 0 THEN '  ' || c_name || '  \t Order ' ELSE ' Renamed  ' || c_name || ' ' END AS name,
       'order-' || CAST(o_orderkey AS STRING) AS slug,
       CASE WHEN o_totalprice < 3000 THEN 'Unspecified'
            ELSE ' ' || CASE WHEN month(o_orderdate) <= 3 THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring'
                             WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END
                 || ' ' || CAST(year(o_orderdate) AS STRING) END AS batch,
       CASE WHEN o_orderstatus = 'F' THEN 'inactive' WHEN o_orderstatus = 'O' THEN ' ACTIVE'
            WHEN o_orderpriority = '1-URGENT' THEN 'weird' WHEN o_orderpriority = '2-HIGH' THEN 'pUBLIC '
            WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Acquired' END AS status,
       CASE WHEN o_totalprice > 250000 THEN 'Growth' ELSE 'Early' END AS stage,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN ' Unspecified ' ELSE c_mktsegment END AS industry,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment
            ELSE c_mktsegment || ' -> Any ->  ' || o_orderpriority END AS subindustry,
       CASE WHEN c_acctbal < 0 THEN 'Remote' WHEN c_acctbal > 9500 THEN NULL
            WHEN c_mktsegment = 'BUILDING' THEN n_name || ' City, ' || r_name || ',  Coast, USA; remote ;'
            WHEN c_mktsegment = 'FURNITURE' THEN n_name
            ELSE ' REMOTE ; Town of ' || n_name || ',' || r_name || ', UK;' || n_name || ' Port, ' || n_name END AS all_locations,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN {array}(r_name, 'Remote', r_name) ELSE {array}(r_name) END AS regions,
       CASE WHEN o_orderpriority = '1-URGENT' THEN {array}('AI', 'Generative AI', ' AI ')
            WHEN o_orderpriority = '2-HIGH' THEN {array}('SaaS', ' ', c_mktsegment)
            WHEN o_orderpriority = '5-LOW' THEN NULL ELSE {array}('Fintech', 'Paid', 'Fintech') END AS tags,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_totalprice < 5000 THEN '-1'
            WHEN o_totalprice < 9000 THEN 'n/a' WHEN o_totalprice > 499000 THEN '10000000'
            ELSE CAST(CAST(floor(o_totalprice / 1000) AS INT) AS STRING)
                 || CASE WHEN o_orderstatus = 'O' THEN '.5' ELSE '' END END AS team_size,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE launched END AS launched_at,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'An LLM-based assistant' WHEN c_mktsegment = 'MACHINERY' THEN NULL
            ELSE 'Sells  tailored suits' END AS one_liner,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'We use machine   learning' WHEN o_orderpriority = '5-LOW' THEN NULL
            ELSE 'Ordered by ' || c_name END AS long_description,
       'HTTPS://' || n_name || '.Example.COM ' AS website,
       'https://directory.example.com/' || CAST(o_orderkey AS STRING) AS url,
       o_totalprice > 400000 AS isHiring,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE c_acctbal < 100 END AS nonprofit,
       c_acctbal > 9000 AS top_company
FROM (
    SELECT *, {epoch} AS launched, 0 AS version FROM {orders}
    UNION ALL
    SELECT *, {epoch} AS launched, 1 AS version FROM {orders} WHERE o_orderpriority = '1-URGENT'
) AS o
LEFT JOIN {customer} ON o_custkey = c_custkey
LEFT JOIN {nation} ON c_nationkey = n_nationkey
LEFT JOIN {region} ON n_regionkey = r_regionkey
"""

EARLIEST = dt.date(1996, 1, 1)

_TABLES = ("orders", "customer", "nation", "region")

# Row types of the driver's tables; stating them saves a job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _shaped(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = text.replace("{array}", "array").replace("{epoch}", "unix_seconds(CAST(o_orderdate AS TIMESTAMP))")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text})


def cohort_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir, COHORT)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records; ``version`` is the input order of records with the same id."""
    return _shaped(spark, sf_dir, RAW)


def parts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their name's words as tags and a flag for large ones."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_type", "p_brand", F.split("p_name", " ").alias("tags"),
        (F.col("p_size") > 25).alias("is_large"),
    )


def _plain(text: str) -> str:
    text = text.replace("{array}", "list_value").replace("{epoch}", "CAST(epoch(o_orderdate) AS BIGINT)")
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def with_cohort(body: str) -> str:
    """SQL for the checking engine with the cohort view as ``cohort``."""
    return f"WITH RECURSIVE cohort AS ({_plain(COHORT)}) {body}"


def with_raw(body: str) -> str:
    return f"WITH RECURSIVE raw AS ({_plain(RAW)}) {body}"
