"""Raw records to features, star schema and reports; every stage writes what the next one reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import audit, cleaning, quality, star, validation
from cohortry.operators.features import build_features
from cohortry.schemas import CLEAN_COLUMNS, RAW_SCHEMA
from cohortry.sources import files


def validate(spark: SparkSession, raw_path: str, lines: bool = False) -> list[str]:
    """Raise on errors, return the warnings."""
    records = files.read_records(spark, raw_path, lines)
    files.require_records(records)
    presence = validation.field_presence(files.read_record_text(spark, raw_path, lines), "value")
    return validation.require_valid(validation.verdict(presence, records, "id", "status"))


def clean(spark: SparkSession, raw_path: str, out: str, as_of: dt.date, lines: bool = False) -> DataFrame:
    """Write ``clean``, ``cleaning_log`` and ``quality`` below ``out``; return the cleaned table."""
    raw = files.read_records(spark, raw_path, lines).select(*RAW_SCHEMA.fieldNames(), "_order")
    annotated = cleaning.annotate(raw, as_of, ["_order"])
    files.write_parquet(annotated, f"{out}/clean_annotated")
    annotated = files.read_parquet(spark, f"{out}/clean_annotated")
    files.write_sorted(annotated.select(*CLEAN_COLUMNS), f"{out}/clean", "company_id")
    files.write_parquet(cleaning.cleaning_log(raw, annotated), f"{out}/cleaning_log")
    cleaned = files.read_parquet(spark, f"{out}/clean")
    log = files.read_parquet(spark, f"{out}/cleaning_log")
    files.write_parquet(quality.quality_report(raw, cleaned, log), f"{out}/quality")
    return cleaned


def features(spark: SparkSession, raw_path: str, out: str, as_of: dt.date) -> DataFrame:
    """Write ``features`` and the ``dataset_meta`` sidecar."""
    files.write_parquet(build_features(files.read_parquet(spark, f"{out}/clean"), as_of), f"{out}/features")
    table = files.read_parquet(spark, f"{out}/features")
    version = files.files_version(files.file_manifest(spark, raw_path))
    files.write_sidecar(spark, f"{out}/dataset_meta", {
        "dataset_version": version[: files.VERSION_LENGTH], "as_of": as_of.isoformat(), "n_companies": table.count(),
    })
    return table


def load(spark: SparkSession, out: str) -> DataFrame:
    """Write the six tables, parents first, each child reading the parents as written; rows per table."""
    table = files.read_parquet(spark, f"{out}/features")
    root = f"{out}/star"
    dims = {"batches": star.batches(table), "industries": star.industries(table), "locations": star.locations(table)}
    counts = files.write_tables(dims, root, star.TABLES[:3])
    dims = files.read_tables(spark, root, star.TABLES[:3])
    facts = {
        "companies": star.companies(table, dims["batches"], dims["industries"], dims["locations"]),
        "company_locations": star.company_locations(table, dims["locations"]),
        "company_tags": star.company_tags(table),
    }
    more = files.write_tables(facts, root, star.TABLES[3:])
    return counts.unionByName(more.withColumn("position", F.col("position") + 3))


def check(spark: SparkSession, out: str) -> DataFrame:
    """Constraint audit of the written tables."""
    return audit.audit(files.read_tables(spark, f"{out}/star", star.TABLES), star.RULES)


def run(spark: SparkSession, raw_path: str, out: str, as_of: dt.date, lines: bool = False) -> DataFrame:
    """All stages; returns the rows per star table."""
    validate(spark, raw_path, lines)
    clean(spark, raw_path, out, as_of, lines)
    features(spark, raw_path, out, as_of)
    return load(spark, out)
