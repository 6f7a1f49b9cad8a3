"""License scans by canonical digest: whole texts, and whole lines, against the digests of known licences.

Canonical form: a first line that names a licence goes, and lines that only tell
who holds the rights, with the reservation of all rights that may follow them;
lower case; equivalent spellings become one; every run of characters other than
letters and digits becomes one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.licence_texts import DIGESTS, NOTICES, TEXTS

# Spellings that mean the same (fixed values, in the order they are applied), as whole words of the canonical form.
EQUIVALENT = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("behaviour", "behavior"), ("favour", "favor"),
    ("organisation", "organization"), ("utilisation", "utilization"), ("whilst", "while"), ("v2 0", "version 2 0"),
    ("https", "http"), ("copyright holders", "copyright holder"), ("copyright owner", "copyright holder"),
]
# A first line such as "The MIT License (MIT)", before other lines.
TITLE_LINE = "^[ \t\r\n]*(?:[^\n]{0,60}[ \t(])?(?i:licen[cs]e)(?:[ \t(),:.][^\n]{0,40})?\r?\n"
# Lines that only tell who holds the rights: with a sign, with a year, or a capitalised name after the word.
COPYRIGHT_LINE = (
    "(?:^|\n)[ \t]*(?:(?i:copyright[ \t:]*)?(?:\\([cC]\\)|©)|(?i:copyright)[^\n]*[0-9]{4}|Copyright[ \t]+[A-Z])[^\n]*"
    "(?:\n[ \t]*(?i:all rights reserved)[. \t\r]*)?"
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    plain = F.regexp_replace(F.regexp_replace(text, TITLE_LINE, ""), COPYRIGHT_LINE, "\n")
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ")), F.lit(" "))
    for other, one in EQUIVALENT:
        plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(plain)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """``licence, text, digest`` of the licences and notices in this package: a fixed table of fewer than 60 rows.

    Long licences are known by the digest of their canonical form alone.
    """
    rows = [(*x, None) for x in TEXTS + NOTICES] + [(name, None, found) for name, found in DIGESTS]
    return spark.createDataFrame(rows, "licence string, text string, digest string")


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, licence, line_licences, n_licence_lines`` for each row of ``docs``.

    ``licence`` names the known text that the whole document is, else null.
    ``line_licences`` lists, sorted and comma-joined, the notices that stand as
    whole lines; ``n_licence_lines`` counts those lines.  Null and empty texts
    match nothing; repeated rows stay; empty tables give none.  ``licences`` has
    ``licence`` and ``text``, and may have ``digest``, which goes before the text's.  Two names for one digest: the smaller
    counts.  The digest table is joined as it is to whole texts (Spark
    broadcasts it if small) and must be small for lines: it is fetched, at most
    ``MOST_NOTICES`` rows.
    """
    told = F.col("digest") if "digest" in licences.columns else F.lit(None).cast("string")
    table = licences.select(F.coalesce(told, digest(F.col("text"))).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))
    notices = table.orderBy("digest").limit(MOST_NOTICES + 1).collect()
    if len(notices) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} licences; scan lines against notices only")
    pairs = [F.lit(x) for row in notices for x in row] or [F.lit(""), F.lit("")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    rows = rows.withColumn("whole", F.sha2(canonical(F.col("text")), 256)).withColumn("digests", F.transform("lines", digest)).drop("lines", "text")
    rows = rows.withColumn("names", F.filter(F.transform("digests", lambda x: F.try_element_at(F.create_map(*pairs), x)), lambda x: x.isNotNull())).drop("digests")
    found = rows.join(table.select(F.col("digest").alias("whole"), "licence"), "whole", "left")
    return found.select(
        "doc_id", F.col("whole").alias("text_sha256"), "licence", F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("line_licences"),
        F.size("names").cast("long").alias("n_licence_lines"),
    )


# Digests told to every task for the scan of lines.
MOST_NOTICES = 10_000


def checking_sql() -> str:
    """The same scan in plain SQL over a view ``documents``."""

    def form(text: str) -> str:
        plain = f"regexp_replace(regexp_replace({text}, '{TITLE_LINE}', ''), '{COPYRIGHT_LINE}', chr(10), 'g')"
        plain = f"(' ' || trim(regexp_replace(lower({plain}), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')) || ' ')"
        for other, one in EQUIVALENT:
            plain = f"replace({plain}, ' {other} ', ' {one} ')"
        return f"trim({plain})"

    values = ", ".join("('{}', '{}', NULL)".format(name, text.replace("'", "''")) for name, text in TEXTS + NOTICES)
    values += "".join(f", ('{name}', NULL, '{found}')" for name, found in DIGESTS)
    return f"""
WITH known AS (SELECT coalesce(told, sha256({form('text')})) AS digest, min(licence) AS licence FROM (VALUES {values}) AS t(licence, text, told) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names
         FROM (SELECT doc_id, sha256({form('line')}) AS digest FROM lines WHERE length(trim(line)) > 0) JOIN known USING (digest) GROUP BY 1)
SELECT d.doc_id, d.digest AS text_sha256, known.licence, coalesce(names, '') AS line_licences, coalesce(n, 0) AS n_licence_lines
FROM (SELECT doc_id, sha256({form("coalesce(text, '')")}) AS digest FROM documents) d
LEFT JOIN known ON known.digest = d.digest LEFT JOIN hits ON hits.doc_id = d.doc_id"""
