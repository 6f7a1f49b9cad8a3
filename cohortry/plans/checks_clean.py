"""Bound queries for sources, validation, cleaning, features and the star schema, with checking SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions import cohorts, flags, places, text
from cohortry.operators import audit, cleaning, metrics, quality, star, validation
from cohortry.operators.features import build_features, latest_date
from cohortry.operators.ordering import exact_quantiles
from cohortry.plans.bindings import AS_OF, EARLIEST, cohort_view, raw_records, table, with_cohort, with_raw
from cohortry.session import stage, staging_path
from cohortry.sources import files

ORDER = ["version"]


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.annotate(raw_records(spark, sf), AS_OF, ORDER, EARLIEST)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(raw_records(spark, sf), AS_OF, ORDER, earliest=EARLIEST)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return build_features(_clean(spark, sf), AS_OF)


def _joined_lists(df: DataFrame) -> DataFrame:
    """Lists as text, so that results compare value by value."""
    return df.select(*[
        F.array_join(f.name, "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields
    ])


# ---------------------------------------------------------------- sources and validation
def scan_json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Presence of required keys in every event's record, by what the records hold."""
    return validation.field_presence(table(spark, sf, "events").select(F.col("props").alias("value")), "value", ("k", "z", "never"))


def json_key_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validation.key_counts(table(spark, sf, "events"), "props")


def provenance_hash(spark: SparkSession, sf: str) -> DataFrame:
    return files.content_versions(table(spark, sf, "documents"), "text", "source")


def roundtrip_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers through parquet, partitioned parquet, CSV and JSON lines, read back and compared per segment."""
    customers = table(spark, sf, "customer")
    root = staging_path(spark, "roundtrip")
    files.write_parquet(customers, f"{root}/plain", sort_by=["c_custkey"])
    files.write_parquet(customers, f"{root}/split", partition_by=["c_mktsegment"])
    files.write_csv(customers, f"{root}/csv")
    customers.write.json(f"{root}/lines")
    schema = customers.schema
    copies = {
        "parquet": files.read_parquet(spark, f"{root}/plain"),
        "parquet by segment": files.read_parquet(spark, f"{root}/split"),
        "csv": files.read_csv(spark, f"{root}/csv", schema),
        "json lines": spark.read.schema(schema).json(f"{root}/lines"),
    }
    both = None
    for name, copy in copies.items():
        part = copy.select(F.lit(name).alias("format"), *schema.fieldNames())
        both = part if both is None else both.unionByName(part)
    return both.groupBy("format", "c_mktsegment").agg(
        F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.min("c_name").alias("first_name"),
        F.max("c_acctbal").alias("top_balance"),
    )


def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as JSON lines: as guarded records with their positions, and as text, counted per segment."""
    customers = table(spark, sf, "customer")
    path = staging_path(spark, "records")
    customers.write.json(path)
    rows = files.read_records(spark, path, lines=True, schema=customers.schema)
    files.require_records(rows, "c_custkey")
    texts = files.read_record_text(spark, path, lines=True).groupBy(F.get_json_object("value", "$.c_mktsegment").alias("c_mktsegment")).agg(
        F.count("*").alias("texts"), F.sum(F.get_json_object("value", "$.c_custkey").cast("long")).alias("text_keys"))
    counted = rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.countDistinct("_order").alias("places"), F.count("_corrupt").alias("broken"), F.sum("c_custkey").alias("keys"))
    return counted.join(texts, "c_mktsegment")


_NOTE = "note string, c_custkey long, c_mktsegment string"


def json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as one JSON array for each segment, with quotes, brackets and escapes in their texts, read by byte ranges."""
    customers = table(spark, sf, "customer")
    note = F.concat(F.lit('"]}{['), F.col("c_name"), F.lit(r' \"\\'), F.lit("},{\n"), F.col("c_mktsegment"))
    told = customers.select("c_mktsegment", "c_custkey", F.to_json(F.struct(note.alias("note"), "c_custkey", "c_mktsegment", F.array(F.struct("c_custkey")).alias("more"))).alias("value"))
    ends = told.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("_first"), F.max("c_custkey").alias("_last"))
    rows = told.join(ends, "c_mktsegment").select(
        F.col("c_mktsegment").alias("file"), "c_custkey",
        F.concat(F.when(F.col("c_custkey") == F.col("_first"), "[").otherwise(" , "), "value", F.when(F.col("c_custkey") == F.col("_last"), " ]").otherwise("")).alias("value"))
    path = staging_path(spark, "arrays")
    rows.repartition("file").sortWithinPartitions("file", "c_custkey").select("file", "value").write.partitionBy("file").text(path)
    read = files.read_records(spark, path, schema=T.StructType.fromDDL(_NOTE), array_bytes=0)
    files.require_records(read, "c_custkey")
    return read.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.countDistinct("_order").alias("places"), F.count("_corrupt").alias("broken"), F.sum("c_custkey").alias("keys"),
        F.sum(F.length("note")).alias("letters"), F.max("note").alias("last_note"))


def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as one text file for each segment and nation: plain hashes, hash trees over small blocks, and the version of all."""
    lines = table(spark, sf, "customer").select(
        "c_mktsegment", "c_nationkey", "c_custkey", F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("value"))
    path = staging_path(spark, "lines")
    keys = ["c_mktsegment", "c_nationkey"]
    lines.repartition(*keys).sortWithinPartitions(*keys, "c_custkey").select(*keys, "value").write.partitionBy(*keys).text(path)
    named = f"{path}/*/*/*.txt"
    whole, trees = files.file_manifest(spark, named), files.file_manifest(spark, named, whole_bytes=1_000, block_bytes=500)
    both = whole.withColumn("_all", F.lit(files.files_version(whole))).join(trees.select("path", F.col("sha256").alias("tree")), "path")
    place = r"c_mktsegment=([^/]*)/c_nationkey=(\d+)"
    return both.select(
        F.regexp_extract("path", place, 1).alias("c_mktsegment"), F.regexp_extract("path", place, 2).cast("int").alias("c_nationkey"),
        "bytes", "sha256", "version", "tree", F.col("_all").alias("all_version"))


def sidecar_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts on a table, written beside it as one document and read back as rows (name, value)."""
    orders = table(spark, sf, "orders")
    facts = orders.agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"),
                       F.countDistinct("o_orderstatus").alias("statuses")).first().asDict()
    path = staging_path(spark, "sidecar")
    files.write_sidecar(spark, path, facts)
    return spark.createDataFrame([(k, int(v)) for k, v in files.read_sidecar(spark, path).items()], "name string, value long")


def sorted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written in total order of price and key: per file its rows, and how many files begin before an earlier one ends."""
    path = staging_path(spark, "sorted")
    files.write_sorted(table(spark, sf, "orders"), path, "o_totalprice", "o_orderkey")
    key = F.struct("o_totalprice", "o_orderkey")
    parts = files.read_parquet(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.sum("o_orderkey").alias("keys"))
    late = parts.withColumn("before", F.lag("high").over(Window.orderBy("file")))
    return late.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.count_if(F.col("low") <= F.col("before")).alias("overlaps"))


def load_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per table after writing the six tables in order, twice (the second write replaces the first)."""
    features = stage(_features(spark, sf), "features")
    root = staging_path(spark, "star")
    tables = star.build_tables(features)
    files.write_tables(tables, root, star.TABLES)
    return files.write_tables(tables, root, star.TABLES)


def _raw_sql(body: str, *ctes: str) -> str:
    return with_raw("".join(f", {c}" for c in ctes) + " " + body)


def validate_domain(spark: SparkSession, sf: str) -> DataFrame:
    return validation.unexpected_values(raw_records(spark, sf), "status")


def validate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_records(spark, sf)
    records = raw.select("id", "status", F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"}).alias("value"))
    result = validation.verdict(validation.field_presence(records, "value"), records, "id", "status")
    return result.select("ok", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "n_records")


def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("key", F.nullif(F.lower("text"), F.lit("")))
    return docs.groupBy("lang").agg(
        F.count("*").alias("rows"), validation.duplicate_count(F.col("key")).alias("extra_rows")
    )


def quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    clean = _clean(spark, sf)
    missing = quality.missing_percent(clean).select(
        F.lit("missing_pct").alias("section"), F.col("field").alias("item"), F.col("missing_pct").alias("value"))
    distinct = quality.distinct_counts(clean).select(
        F.lit("unique_counts").alias("section"), F.col("field").alias("item"), F.col("distinct_values").cast("double").alias("value"))
    keys = {"company_id": F.col("company_id"), "slug": F.col("slug"), "name": F.lower("name")}
    extra = quality.duplicate_counts(clean, keys).select(
        F.lit("duplicates").alias("section"), F.col("key").alias("item"), F.col("extra_rows").cast("double").alias("value"))
    return missing.unionByName(distinct).unionByName(extra)


def quality_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return quality.value_ranges(_clean(spark, sf), ["batch_year", "batch_start", "launched_at"])


def table_facts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.table_facts(raw_records(spark, sf), _clean(spark, sf))


def most_missing(spark: SparkSession, sf: str) -> DataFrame:
    return quality.most_missing(_clean(spark, sf), 6)


def cleaning_log(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.cleaning_log(raw_records(spark, sf), _annotated(spark, sf))


def project_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Customers projected, renamed, cast, lower-cased, flags defaulted, sorted."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long").alias("company_id"),
        F.lower("c_name").alias("name"),
        F.struct(F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment")).alias("s"),
        F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") > 5000), F.lit(False)).alias("is_top"),
    ).select("company_id", "name", "s.*", "is_top").withColumnRenamed("segment", "industry").orderBy("company_id")


def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    """Last event per user."""
    kept = cleaning.keep_last(table(spark, sf, "events"), "user_id", ["ts", "event_id"])
    return kept.select("user_id", "event_id", "event_type", "value")


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    cleaned = text.clean_text(F.concat(F.lit(" \t"), F.col("text"), F.lit("\n ")))
    return docs.select("doc_id", F.md5(cleaned).alias("digest"), text.text_length(cleaned).alias("length"))


def parse_cohort(spark: SparkSession, sf: str) -> DataFrame:
    labels = raw_records(spark, sf).select("batch").distinct()
    parsed = labels.select("batch", cohorts.parse_cohort(F.col("batch")).alias("p")).select(
        "batch", "p.season", "p.year", "p.code", "p.start", F.col("p.order").alias("sequence"))
    return parsed.withColumns({
        "state": cohorts.cohort_state(F.col("start"), AS_OF), "age": cohorts.cohort_age(F.col("year"), AS_OF),
    })


def state_at_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Cohort states relative to the date of the latest order."""
    orders = table(spark, sf, "orders")
    start = F.trunc(F.to_date("o_orderdate"), "month")
    as_of = latest_date(orders, "o_orderdate")
    return orders.groupBy(cohorts.cohort_state(start, as_of).alias("state")).agg(F.count("*").alias("n"))


def status_recode(spark: SparkSession, sf: str) -> DataFrame:
    status = cleaning.known_status(F.col("status"))
    return raw_records(spark, sf).groupBy(
        F.col("status").alias("raw_status"), status.alias("status"), cleaning.is_operating(status).alias("is_operating")
    ).agg(F.count("*").alias("n"))


def subgroup_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    label = F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(
        F.concat("p_type", F.lit(" -> "), "p_brand", F.lit("->  "), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise("")))
    return parts.select("p_partkey", text.after_last(text.clean_text(label)).alias("subgroup"))


def outlier_fence(spark: SparkSession, sf: str) -> DataFrame:
    """Fence on line prices (as text, with values that are no sizes) and the rows above a narrow fence."""
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).when(F.col("l_quantity") > 45, -1.0)
        .otherwise(F.col("l_extendedprice") / 2).alias("v"))
    size = cleaning.positive(cleaning.number(F.col("v").cast("string")))
    wide = cleaning.upper_fence(lines, size)
    narrow = cleaning.upper_fence(lines, size, 0.1)
    flagged = lines.withColumn("_f", narrow.scalar()).agg(
        F.count_if(size > F.col("_f")).alias("above_narrow"), F.count_if(size.isNull()).alias("missing"),
        F.count_if(F.bround(size, 0) % 2 == 0).alias("even_sizes"))
    return flagged.select(F.round(wide.scalar(), 4).alias("fence"), "above_narrow", "missing", "even_sizes")


def epoch_bounds(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
    launched = F.when(cohorts.epoch_in_bounds(seconds, first, last), cohorts.epoch_to_timestamp(seconds))
    return events.select("event_id", launched.alias("launched_at"))


def tags_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned word lists with planted blanks and repeats: size and text per part."""
    words = F.split(F.concat(F.col("p_name"), F.lit(" "), F.col("p_name")), " ")
    dirty = F.concat(F.array(F.lit(" ")), words, F.array(F.concat(F.lit(" "), F.col("p_type"), F.lit("\t")), F.lit(None)))
    tags = text.clean_list(F.when(F.col("p_size") > 2, dirty))
    return table(spark, sf, "part").select("p_partkey", F.size(tags).alias("tag_count"), F.array_join(tags, "|").alias("tags"))


def locations_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of every record, all versions of it."""
    entries = raw_records(spark, sf).select("id", "version", F.posexplode(text.split_list(F.col("all_locations"))).alias("position", "entry"))
    parsed = entries.select("id", F.col("version").cast("int").alias("version"), "position", places.parse_place(F.col("entry")).alias("p"))
    return parsed.select("id", "version", "position", "p.*")


def keyword_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by language: word-list hits in texts, and in the text's words as tags."""
    docs = table(spark, sf, "documents")
    in_text = flags.text_matches(F.col("text"), F.lit(None).cast("string"))
    in_tags = flags.any_tag_matches(F.split("text", "\n"))
    return docs.select("lang", in_text.alias("w"), in_tags.alias("t")).groupBy("lang").agg(
        F.count_if("w").alias("worded"), F.count_if("t").alias("tagged"),
        F.count_if(F.col("w") | F.col("t")).alias("either"),
    )


def size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    size = (F.col("p_size") * F.when(F.col("p_type") == "LARGE", 10).otherwise(1)) - 1
    return table(spark, sf, "part").groupBy(flags.size_class(size).alias("bucket")).agg(
        F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"))


def quantiles_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles of line prices per flag and status."""
    lines = table(spark, sf, "lineitem")
    found = exact_quantiles(
        lines, F.col("l_extendedprice"), {"q1": 0.25, "median": 0.5, "p99": 0.99}, by=["l_returnflag", "l_linestatus"])
    return metrics.rounded(found, 6)


def shared_names(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.count_shared(table(spark, sf, "part"), F.lower("p_name"), "shared")


def _star_table(name: str):
    """One table of the star schema; features are written first, as they feed several tables."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        features = stage(_features(spark, sf), "features")
        if name == "companies":
            return star.companies(features, star.batches(features), star.industries(features), star.locations(features))
        if name == "company_locations":
            return star.company_locations(features, star.locations(features))
        return getattr(star, name)(features)

    return query


def constraint_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of the star tables, and of the driver's own keys with planted violations."""
    tables = star.build_tables(stage(_features(spark, sf), "features"))
    own = {
        "nation": table(spark, sf, "nation").filter("n_nationkey <> 3"),
        "customer": table(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_name"))),
    }
    rules = {
        "nation": audit.TableRules(("n_nationkey",), unique=[("n_regionkey",)]),
        "customer": audit.TableRules(("c_custkey",), not_null=["c_name"], foreign_keys={"c_nationkey": ("nation", "n_nationkey")}),
    }
    return audit.audit(tables, star.RULES).unionByName(audit.audit(own, rules))


def primary_counts(spark: SparkSession, sf: str) -> DataFrame:
    # Both steps read these columns; a table that is written is not pruned by what reads it.
    features = stage(_features(spark, sf).select("company_id", "location_entries"), "features")
    return audit.primary_counts(star.company_locations(features, star.locations(features)))


def explorer_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.explorer(_features(spark, sf), "TAILORED").select(
        "name", "batch", "industry", "subindustry", "primary_city", "primary_country", "status", "team_size", "is_ai",
        "one_liner", "website", "profile_url")


QUERIES = {
    "scan_json_fields": scan_json_fields,
    "json_key_counts": json_key_counts,
    "provenance_hash": provenance_hash,
    "roundtrip_files": roundtrip_files,
    "json_records": json_records,
    "json_array": json_array,
    "file_hashes": file_hashes,
    "sidecar_facts": sidecar_facts,
    "sorted_files": sorted_files,
    "load_counts": load_counts,
    "validate_domain": validate_domain,
    "validate_verdict": validate_verdict,
    "duplicate_texts": duplicate_texts,
    "quality_profile": quality_profile,
    "quality_ranges": quality_ranges,
    "table_facts": table_facts,
    "most_missing": most_missing,
    "cleaning_log": cleaning_log,
    "project_shape": project_shape,
    "dedupe_last": dedupe_last,
    "clean_text": clean_text,
    "parse_cohort": parse_cohort,
    "state_at_latest": state_at_latest,
    "status_recode": status_recode,
    "subgroup_split": subgroup_split,
    "outlier_fence": outlier_fence,
    "epoch_bounds": epoch_bounds,
    "tags_normalise": tags_normalise,
    "locations_parse": locations_parse,
    "keyword_flags": keyword_flags,
    "size_buckets": size_buckets,
    "quantiles_exact": quantiles_exact,
    "shared_names": shared_names,
    "clean_table": lambda s, d: _joined_lists(_clean(s, d)),
    "feature_table": lambda s, d: _features(s, d).select(
        "company_id", "ai_tag", "ai_keyword", "is_ai", "batch_status", "years_since_batch", "tag_count",
        "team_size_bucket", "description_length"),
    "explorer_sorted": explorer_sorted,
    "star_batches": _star_table("batches"),
    "star_industries": _star_table("industries"),
    "star_locations": _star_table("locations"),
    "star_companies": _star_table("companies"),
    "star_company_locations": _star_table("company_locations"),
    "star_company_tags": _star_table("company_tags"),
    "constraint_audit": constraint_audit,
    "primary_counts": primary_counts,
}


# ---------------------------------------------------------------- checking SQL
def _ws(column: str) -> str:
    return f"nullif(trim(regexp_replace({column}, '[\\s]+', ' ', 'g')), '')"


_STATUS = f"upper({_ws('status')}[1]) || lower({_ws('status')}[2:])"
_KNOWN = "('Active', 'Inactive', 'Acquired', 'Public')"
_LABEL = "'^(Winter|Spring|Summer|Fall)\\s+(\\d{4})$'"

_KEPT = "kept AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)"
_SIZED = (
    "sized AS (SELECT *, TRY_CAST(team_size AS DOUBLE) AS size_in, "
    "CASE WHEN TRY_CAST(team_size AS DOUBLE) > 0 THEN TRY_CAST(team_size AS DOUBLE) END AS size, "
    f"{_STATUS} AS st, regexp_matches(trim(batch), {_LABEL}) AS labelled, "
    f"regexp_extract(trim(batch), {_LABEL}, 1) AS se, regexp_extract(trim(batch), {_LABEL}, 2) AS ye FROM kept)"
)
_FENCE = (
    "fence AS (SELECT exp(q3 + 3 * (q3 - q1)) - 1 AS fence FROM (SELECT quantile_cont(ln(1 + size), 0.25) AS q1, "
    "quantile_cont(ln(1 + size), 0.75) AS q3 FROM sized))"
)
_ENTRIES = (
    f"entry AS (SELECT id, unnest(es) AS place, unnest(range(len(es))) AS pos FROM (SELECT id, list_filter("
    f"list_transform(string_split({_ws('all_locations')}, ';'), lambda e: trim(e)), lambda e: e <> '') AS es FROM kept))"
)
_PLACES = (
    "place AS (SELECT id, pos, place AS place_raw, lower(place) = 'remote' AS remote, "
    "list_filter(list_transform(string_split(place, ','), lambda p: trim(p)), lambda p: p <> '') AS parts FROM entry), "
    "parsed AS (SELECT id, pos, place_raw, remote AS is_remote, "
    "CASE WHEN NOT remote AND len(parts) > 1 THEN parts[1] END AS city, "
    "CASE WHEN NOT remote AND len(parts) > 2 THEN array_to_string(parts[2:len(parts) - 1], ', ') END AS region, "
    "CASE WHEN NOT remote THEN CASE WHEN parts[-1] IN ('USA', 'US', 'U.S.', 'United States of America') THEN 'United States' "
    "WHEN parts[-1] = 'UK' THEN 'United Kingdom' ELSE parts[-1] END END AS country FROM place), "
    "prim AS (SELECT id, arg_min(place_raw, pos) FILTER (WHERE NOT is_remote) AS first_place, "
    "any_value(0) AS z, count(*) AS places, bool_or(is_remote) AS has_remote FROM parsed GROUP BY id), "
    "prim2 AS (SELECT p.*, q.city, q.region, q.country FROM prim p LEFT JOIN parsed q ON q.id = p.id "
    "AND q.pos = (SELECT min(r.pos) FROM parsed r WHERE r.id = p.id AND NOT r.is_remote))"
)


def _list(column: str) -> str:
    trimmed = f"list_transform({column}, lambda t: trim(t, ' \t\n'))"
    return f"list_filter({trimmed}, lambda t, i: t <> '' AND list_position({trimmed}, t) = i)"


_CLEAN = (
    "clean AS (SELECT k.id AS company_id, " + f"{_ws('slug')} AS slug, {_ws('k.name')} AS name, "
    f"lower({_ws('website')}) AS website, {_ws('one_liner')} AS one_liner, {_ws('long_description')} AS long_description, "
    f"{_ws('url')} AS profile_url, {_ws('stage')} AS stage, "
    f"CASE WHEN st IN {_KNOWN} THEN st ELSE 'Unknown' END AS status, coalesce(st IN ('Active', 'Public'), FALSE) AS is_operating, "
    f"{_ws('industry')} AS industry, CASE WHEN contains(subindustry, '->') "
    f"THEN trim(string_split({_ws('subindustry')}, '->')[-1]) END AS subindustry, "
    f"{_ws('batch')} AS batch, CASE WHEN labelled THEN se END AS batch_season, "
    "CASE WHEN labelled THEN ye::INT END AS batch_year, "
    "CASE WHEN labelled THEN CASE se WHEN 'Winter' THEN 'W' WHEN 'Spring' THEN 'X' WHEN 'Summer' THEN 'S' ELSE 'F' END "
    "|| ye[3:4] END AS batch_code, "
    "CASE WHEN labelled THEN make_date(ye::INT, CASE se WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 4 WHEN 'Summer' THEN 6 "
    "ELSE 9 END, 1) END AS batch_start, "
    "CASE WHEN labelled THEN (ye::INT * 100 + CASE se WHEN 'Winter' THEN 1 WHEN 'Spring' THEN 4 WHEN 'Summer' THEN 6 "
    "ELSE 9 END)::INT END AS batch_order, "
    "round_even(size, 0)::INT AS team_size, coalesce(size > fence, FALSE) AS team_size_outlier, "
    "CASE WHEN launched_at BETWEEN epoch(DATE '1996-01-01')::BIGINT AND epoch(DATE '2001-08-02')::BIGINT "
    "THEN make_timestamp(launched_at * 1000000) END AS launched_at, "
    "coalesce(isHiring, FALSE) AS is_hiring, coalesce(nonprofit, FALSE) AS is_nonprofit, "
    "coalesce(top_company, FALSE) AS is_top_company, "
    f"coalesce({_list('tags')}, []) AS tags, coalesce({_list('regions')}, []) AS regions, "
    f"{_ws('all_locations')} AS all_locations, "
    "coalesce((SELECT list(e.place ORDER BY e.pos) FROM entry e WHERE e.id = k.id), []) AS location_entries, "
    "p.city AS primary_city, p.region AS primary_region, p.country AS primary_country, "
    "coalesce(p.places, 0)::INT AS location_count, "
    "coalesce(p.has_remote, FALSE) OR list_contains(regions, 'Remote') AS is_remote, "
    "p.first_place, size, size_in, fence, launched_at AS launched_in, st "
    "FROM sized k CROSS JOIN fence LEFT JOIN prim2 p ON p.id = k.id)"
)
_TAG_WORDS = ("(?i)(^|[^\\p{L}\\p{N}_])ai($|[^\\p{L}\\p{N}_])|artificial intelligence|machine learning|deep learning|"
              "computer vision|(^|[^\\p{L}\\p{N}_])nlp($|[^\\p{L}\\p{N}_])|generative|(^|[^\\p{L}\\p{N}_])llm")
_KEY_WORDS = ("(?i)(^|[^\\p{L}\\p{N}_])ai($|[^\\p{L}\\p{N}_])|(^|[^\\p{L}\\p{N}_])a\\.i\\.|"
              "artificial intelligence|machine learning|deep learning|(^|[^\\p{L}\\p{N}_])llms?($|[^\\p{L}\\p{N}_])|"
              "large language model|(^|[^\\p{L}\\p{N}_])gpt($|[^\\p{L}\\p{N}_])|generative|neural network|computer vision|"
              "(^|[^\\p{L}\\p{N}_])nlp($|[^\\p{L}\\p{N}_])")
_FEATURES = (
    f"feat AS (SELECT *, len(list_filter(tags, lambda t: regexp_matches(t, '{_TAG_WORDS}'))) > 0 AS ai_tag, "
    f"regexp_matches(coalesce(one_liner, '') || ' ' || coalesce(long_description, ''), '{_KEY_WORDS}') AS ai_keyword, "
    "CASE WHEN batch_start IS NULL THEN 'unknown' WHEN batch_start > DATE '2001-08-01' THEN 'future' "
    "WHEN date_diff('day', batch_start, DATE '2001-08-01') < 120 THEN 'in_progress' ELSE 'complete' END AS batch_status "
    "FROM clean)"
)
_CLEAN_CTES = (_KEPT, _SIZED, _FENCE, _ENTRIES, _PLACES, _CLEAN)
_FEATURE_CTES = (*_CLEAN_CTES, _FEATURES)
_DIMS = (
    "b AS (SELECT row_number() OVER (ORDER BY batch_order NULLS LAST, batch NULLS LAST) AS batch_id, * FROM ("
    "SELECT DISTINCT batch, batch_season AS season, batch_year AS \"year\", batch_code AS code, batch_order, "
    "strftime(batch_start, '%Y-%m-%d') AS approx_start_date, batch_status FROM feat))",
    "i AS (SELECT row_number() OVER (ORDER BY industry NULLS FIRST, subindustry NULLS FIRST) AS industry_id, * FROM ("
    "SELECT DISTINCT industry, subindustry FROM feat))",
    "l AS (SELECT row_number() OVER (ORDER BY id, pos) AS location_id, place_raw, city, region, country, is_remote "
    "FROM (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY place_raw ORDER BY id, pos) = 1))",
    "cl AS (SELECT DISTINCT f.company_id, l.location_id, coalesce(l.place_raw = f.first_place, FALSE)::INT AS is_primary "
    "FROM feat f JOIN parsed p ON p.id = f.company_id JOIN l ON l.place_raw = p.place_raw)",
    "ct AS (SELECT DISTINCT company_id, unnest(tags) AS tag FROM feat)",
)
_STAR_CTES = (*_FEATURE_CTES, *_DIMS)

_SCALARS = [
    "company_id", "slug", "name", "website", "one_liner", "long_description", "profile_url", "stage", "status",
    "is_operating", "industry", "subindustry", "batch", "batch_season", "batch_year", "batch_code", "batch_start",
    "batch_order", "team_size", "team_size_outlier", "launched_at", "is_hiring", "is_nonprofit", "is_top_company",
    "all_locations", "primary_city", "primary_region", "primary_country", "location_count", "is_remote",
]
_LISTS = ["tags", "regions", "location_entries"]


def _missing_sql() -> str:
    parts = [f"SELECT '{c}' AS item, avg(({c} IS NULL)::INT) * 100 AS p FROM clean" for c in _SCALARS]
    parts += [f"SELECT '{c}', avg((len({c}) = 0)::INT) * 100 FROM clean" for c in _LISTS]
    return " UNION ALL ".join(parts)


def _log_sql() -> str:
    counts = {
        "duplicate_ids": "(SELECT count(*) FROM raw) - (SELECT count(*) FROM clean)",
        "unknown_status": f"(SELECT count(*) FROM clean WHERE coalesce(st NOT IN {_KNOWN}, TRUE))",
        "industry_unspecified": "(SELECT count(*) FROM clean WHERE industry = 'Unspecified')",
        "unparsed_batch": "(SELECT count(*) FROM clean WHERE batch_season IS NULL)",
        "team_size_invalid": "(SELECT count(*) FROM clean WHERE size_in <= 0)",
        "team_size_outlier": "(SELECT count(*) FROM clean WHERE team_size_outlier)",
        "team_size_missing": "(SELECT count(*) FROM clean WHERE size IS NULL)",
        "launched_at_out_of_range": "(SELECT count(*) FROM clean WHERE launched_in IS NOT NULL AND launched_at IS NULL)",
        "no_physical_location": "(SELECT count(*) FROM clean WHERE primary_country IS NULL)",
        "shared_names": "(SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM clean GROUP BY lower(name)) WHERE c > 1)",
    }
    rows = []
    for at, (step, sql) in enumerate(counts.items(), 1):
        note = "'" + cleaning.DECISIONS[step].replace("'", "''") + "'"
        if "{fence}" in note:
            note = f"replace({note}, '{{fence}}', (SELECT printf('%.0f', max(fence)) FROM clean))"
        rows.append(f"SELECT {at}::INT AS position, '{step}' AS step, ({sql})::BIGINT AS rows_affected, {note} AS decision")
    return " UNION ALL ".join(rows)


def _audit_sql() -> str:
    rows = []
    for name, rule in star.RULES.items():
        def line(kind, columns):
            rows.append(f"SELECT '{name}' AS \"table\", '{kind}' AS rule, '{columns}' AS columns, 0::BIGINT AS violations")
        line("primary key", ",".join(rule.primary_key))
        for columns in rule.unique:
            line("unique", ",".join(columns))
        for c in dict.fromkeys([*rule.primary_key, *rule.not_null]):
            line("not null", c)
        for c in rule.foreign_keys or {}:
            line("foreign key", c)
    rows += [
        "SELECT 'nation', 'primary key', 'n_nationkey', 0",
        "SELECT 'nation', 'unique', 'n_regionkey', (SELECT count(*) FROM (SELECT 1 FROM nation WHERE n_nationkey <> 3 "
        "GROUP BY n_regionkey HAVING count(*) > 1))",
        "SELECT 'nation', 'not null', 'n_nationkey', 0",
        "SELECT 'customer', 'primary key', 'c_custkey', 0",
        "SELECT 'customer', 'not null', 'c_custkey', 0",
        "SELECT 'customer', 'not null', 'c_name', (SELECT count(*) FROM customer WHERE c_acctbal <= 0)",
        "SELECT 'customer', 'foreign key', 'c_nationkey', (SELECT count(*) FROM customer WHERE c_nationkey = 3)",
    ]
    return " UNION ALL ".join(rows)


_COMPANY_SELECT = (
    "SELECT f.company_id, slug, name, website, profile_url, one_liner, long_description, b.batch_id, i.industry_id, status, "
    "is_operating::INT AS is_operating, stage, team_size, team_size_outlier::INT AS team_size_outlier, "
    "is_hiring::INT AS is_hiring, is_nonprofit::INT AS is_nonprofit, is_top_company::INT AS is_top_company, "
    "ai_tag::INT AS ai_tag, ai_keyword::INT AS ai_keyword, (ai_tag OR ai_keyword)::INT AS is_ai, "
    "f.is_remote::INT AS is_remote, strftime(launched_at, '%Y-%m-%d') AS launched_at, l.location_id AS primary_location_id "
    "FROM feat f LEFT JOIN b ON b.batch IS NOT DISTINCT FROM f.batch "
    "LEFT JOIN i ON i.industry IS NOT DISTINCT FROM f.industry AND i.subindustry IS NOT DISTINCT FROM f.subindustry "
    "LEFT JOIN l ON l.place_raw = f.first_place"
)

ORACLES = {
    "scan_json_fields": (
        "WITH k AS (SELECT json_keys(props) AS ks FROM events), "
        "f AS (SELECT unnest(['k', 'z', 'never']) AS field), "
        "c AS (SELECT field, (SELECT count(*) FROM k WHERE list_contains(ks, field)) AS present, "
        "(SELECT count(*) FROM k) AS n FROM f) "
        "SELECT field, present, n - present AS absent, CASE WHEN n = present THEN 'ok' WHEN present = 0 THEN 'error' "
        "ELSE 'warning' END AS verdict FROM c"),
    "json_key_counts": "SELECT field, count(*) AS present FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY 1",
    "provenance_hash": (
        "SELECT source, count(*) AS rows, sum(strlen(text))::BIGINT AS bytes, "
        "printf('%012x', (sum(('0x' || substr(sha256(text), 1, 12))::BIGINT) % 281474976710656)::BIGINT) AS version "
        "FROM documents GROUP BY 1"),
    "json_records": (
        "SELECT c_mktsegment, count(*) AS n, count(*) AS places, count(*) - count(c_custkey) AS broken, sum(c_custkey)::BIGINT AS keys, "
        "count(*) AS texts, sum(c_custkey)::BIGINT AS text_keys FROM customer GROUP BY 1"),
    "json_array": (
        "SELECT c_mktsegment, count(*) AS n, count(*) AS places, 0::BIGINT AS broken, sum(c_custkey)::BIGINT AS keys, sum(length(note))::BIGINT AS letters, "
        "max(note) AS last_note FROM (SELECT *, '\"]}{[' || c_name || ' \\\"\\\\' || '},{' || chr(10) || c_mktsegment AS note FROM customer) GROUP BY 1"),
    "file_hashes": (
        "WITH l AS (SELECT c_mktsegment, c_nationkey, c_custkey, concat_ws('|', c_custkey, c_name, c_mktsegment) || chr(10) AS v FROM customer), "
        "p AS (SELECT *, coalesce(sum(strlen(v)) OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM l), "
        "f AS (SELECT c_mktsegment, c_nationkey, sum(strlen(v))::BIGINT AS bytes, sha256(string_agg(v, '' ORDER BY c_custkey)) AS sha256 FROM l GROUP BY ALL), "
        "b AS (SELECT c_mktsegment, c_nationkey, begins // 500 AS block, sha256(string_agg(v, '' ORDER BY c_custkey)) AS h FROM p GROUP BY ALL), "
        "t AS (SELECT c_mktsegment, c_nationkey, sha256(string_agg(h, '' ORDER BY block)) AS h FROM b GROUP BY ALL), "
        "a AS (SELECT sha256(concat_ws(':', sum(('0x' || substr(sha256, 1, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(sha256, 17, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(sha256, 33, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(sha256, 49, 15))::BIGINT)::VARCHAR, count(*))) AS v FROM f) "
        "SELECT c_mktsegment, c_nationkey::INT AS c_nationkey, bytes, sha256, substr(sha256, 1, 12) AS version, "
        "CASE WHEN bytes > 1000 THEN t.h ELSE sha256 END AS tree, a.v AS all_version FROM f JOIN t USING (c_mktsegment, c_nationkey), a"),
    "sidecar_facts": (
        "SELECT unnest(['rows', 'first', 'last', 'statuses']) AS name, unnest([count(*), min(o_orderkey), max(o_orderkey), "
        "count(DISTINCT o_orderstatus)])::BIGINT AS value FROM orders"),
    "sorted_files": (
        "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(*) - count(o_totalprice) AS overlaps FROM orders"),
    "roundtrip_files": (
        "SELECT format, c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys, min(c_name) AS first_name, "
        "max(c_acctbal) AS top_balance FROM customer, "
        "(SELECT unnest(['parquet', 'parquet by segment', 'csv', 'json lines']) AS format) GROUP BY ALL"),
    "load_counts": _raw_sql(
        "SELECT 1::INT AS position, 'batches' AS \"table\", (SELECT count(*) FROM b) AS rows "
        "UNION ALL SELECT 2, 'industries', (SELECT count(*) FROM i) UNION ALL SELECT 3, 'locations', (SELECT count(*) FROM l) "
        "UNION ALL SELECT 4, 'companies', (SELECT count(*) FROM feat) "
        "UNION ALL SELECT 5, 'company_locations', (SELECT count(*) FROM cl) "
        "UNION ALL SELECT 6, 'company_tags', (SELECT count(*) FROM ct)", *_STAR_CTES),
    "validate_domain": _raw_sql(
        f"SELECT status AS value, count(*) AS n FROM raw WHERE coalesce(status NOT IN {_KNOWN}, TRUE) GROUP BY 1"),
    "validate_verdict": _raw_sql(
        "SELECT TRUE AS ok, '' AS errors, (count(*) - count(DISTINCT id))::VARCHAR || ' duplicate ids|' || "
        f"(count(*) FILTER (WHERE coalesce(status NOT IN {_KNOWN}, TRUE)))::VARCHAR || ' unexpected status values' AS warnings, "
        "count(*) AS n_records FROM raw"),
    "duplicate_texts": (
        "SELECT lang, count(*) AS rows, (count(*) - count(DISTINCT nullif(lower(text), '')) - "
        "max(CASE WHEN nullif(lower(text), '') IS NULL THEN 1 ELSE 0 END))::BIGINT AS extra_rows FROM documents GROUP BY 1"),
    "quality_profile": _raw_sql(
        f"SELECT 'missing_pct' AS section, item, round(p, 2) AS value FROM ({_missing_sql()}) UNION ALL "
        + " UNION ALL ".join(
            f"SELECT 'unique_counts', '{c}', count(DISTINCT {c})::DOUBLE FROM clean" for c in quality.COUNTED)
        + " UNION ALL SELECT 'duplicates', 'company_id', (count(*) - count(DISTINCT company_id))::DOUBLE FROM clean"
        " UNION ALL SELECT 'duplicates', 'slug', (count(*) - count(DISTINCT slug))::DOUBLE FROM clean"
        " UNION ALL SELECT 'duplicates', 'name', (count(*) - count(DISTINCT lower(name)))::DOUBLE FROM clean", *_CLEAN_CTES),
    "quality_ranges": _raw_sql(
        "SELECT 'batch_year' AS field, min(batch_year)::VARCHAR AS low, max(batch_year)::VARCHAR AS high FROM clean "
        "UNION ALL SELECT 'batch_start', min(batch_start)::VARCHAR, max(batch_start)::VARCHAR FROM clean "
        "UNION ALL SELECT 'launched_at', min(launched_at)::VARCHAR, max(launched_at)::VARCHAR FROM clean", *_CLEAN_CTES),
    "table_facts": _raw_sql(
        "SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(DISTINCT id) FROM raw) AS clean_rows, "
        "33::INT AS columns, 30::INT AS scalar_columns"),
    "most_missing": _raw_sql(
        f"SELECT item AS field, round(p, 2) AS missing_pct FROM ({_missing_sql()}) ORDER BY 2 DESC, 1 LIMIT 6", *_CLEAN_CTES),
    "cleaning_log": _raw_sql(_log_sql(), *_CLEAN_CTES),
    "project_shape": (
        "SELECT c_custkey AS company_id, lower(c_name) AS name, c_nationkey AS nation_id, c_mktsegment AS industry, "
        "c_acctbal > 5000 AS is_top FROM customer"),
    "dedupe_last": (
        "SELECT user_id, event_id, event_type, value FROM events "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "clean_text": (
        "SELECT doc_id, md5(t) AS digest, coalesce(length(t), 0)::INT AS length FROM (SELECT doc_id, nullif(trim(regexp_replace("
        "' \t' || text || '\n ', '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}"
        "\\x{205f}\\x{3000}]+', ' ', 'g')), '') AS t FROM documents)"),
    "parse_cohort": _raw_sql(
        "SELECT batch, season, y AS \"year\", code || right(y::VARCHAR, 2) AS code, make_date(y, m, 1) AS start, "
        "(y * 100 + m)::INT AS sequence, CASE WHEN y IS NULL THEN 'unknown' WHEN make_date(y, m, 1) > DATE '2001-08-01' THEN 'future' "
        "WHEN make_date(y, m, 1) > DATE '2001-04-03' THEN 'in_progress' ELSE 'complete' END AS state, (2001 - y)::INT AS age "
        "FROM (SELECT batch, nullif(split_part(trim(batch), ' ', 1), 'Unspecified') AS season, "
        "TRY_CAST(split_part(trim(batch), ' ', 2) AS INT) AS y, CASE split_part(trim(batch), ' ', 1) WHEN 'Winter' THEN 1 "
        "WHEN 'Spring' THEN 4 WHEN 'Summer' THEN 6 WHEN 'Fall' THEN 9 END AS m, CASE split_part(trim(batch), ' ', 1) "
        "WHEN 'Winter' THEN 'W' WHEN 'Spring' THEN 'X' WHEN 'Summer' THEN 'S' WHEN 'Fall' THEN 'F' END AS code "
        "FROM (SELECT DISTINCT batch FROM raw))"),
    "state_at_latest": (
        "SELECT CASE WHEN date_diff('day', date_trunc('month', o_orderdate)::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) "
        "< 120 THEN 'in_progress' ELSE 'complete' END AS state, count(*) AS n FROM orders GROUP BY 1"),
    "status_recode": _raw_sql(
        "SELECT status AS raw_status, CASE WHEN lower(trim(status)) = 'inactive' THEN 'Inactive' "
        "WHEN lower(trim(status)) = 'active' THEN 'Active' WHEN lower(trim(status)) = 'public' THEN 'Public' "
        "WHEN lower(trim(status)) = 'acquired' THEN 'Acquired' ELSE 'Unknown' END AS status, "
        "coalesce(lower(trim(status)) IN ('active', 'public'), FALSE) AS is_operating, count(*) AS n FROM raw GROUP BY ALL"),
    "subgroup_split": "SELECT p_partkey, CASE WHEN p_size <= 5 THEN '' WHEN p_size <= 40 THEN p_name END AS subgroup FROM part",
    "outlier_fence": (
        "WITH v AS (SELECT CASE WHEN l_returnflag = 'A' THEN l_extendedprice WHEN l_quantity > 45 THEN NULL "
        "ELSE l_extendedprice / 2 END AS size FROM lineitem), "
        "q AS (SELECT quantile_cont(ln(1 + size), 0.25) AS q1, quantile_cont(ln(1 + size), 0.75) AS q3 FROM v) "
        "SELECT round(exp(max(q3) + 3 * (max(q3) - max(q1))) - 1, 4) AS fence, "
        "count(*) FILTER (WHERE size > exp(q3 + 0.1 * (q3 - q1)) - 1) AS above_narrow, count(*) FILTER (WHERE size IS NULL) "
        "AS missing, count(*) FILTER (WHERE round_even(size, 0) % 2 = 0) AS even_sizes FROM v, q"),
    "epoch_bounds": (
        "SELECT event_id, CASE WHEN date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-21' "
        "THEN date_trunc('second', ts) END AS launched_at FROM events"),
    "tags_normalise": (
        "SELECT p_partkey, len(t)::INT AS tag_count, array_to_string(t, '|') AS tags FROM (SELECT p_partkey, "
        "CASE WHEN p_size <= 2 THEN [] WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) "
        "THEN [split_part(p_name, ' ', 1), p_type] ELSE [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type] END "
        "AS t FROM part)"),
    "locations_parse": with_raw(
        ", kept AS (SELECT * REPLACE (id * 10 + version AS id) FROM raw), " + _ENTRIES + ", " + _PLACES
        + " SELECT id // 10 AS id, (id % 10)::INT AS version, pos::INT AS position, place_raw, city, region, country, is_remote FROM parsed"),
    "keyword_flags": (
        f"SELECT lang, count(*) FILTER (WHERE w) AS worded, count(*) FILTER (WHERE t) AS tagged, "
        f"count(*) FILTER (WHERE w OR t) AS either FROM (SELECT lang, regexp_matches(text, '{_KEY_WORDS}') AS w, "
        f"regexp_matches(text, '{_TAG_WORDS}') AS t FROM documents) GROUP BY 1"),
    "size_buckets": (
        "SELECT CASE WHEN s <= 0 THEN NULL WHEN s <= 1 THEN '1' WHEN s <= 2 THEN '2' WHEN s <= 5 THEN '3-5' "
        "WHEN s <= 10 THEN '6-10' WHEN s <= 50 THEN '11-50' WHEN s <= 200 THEN '51-200' ELSE '200+' END AS bucket, "
        "count(*) AS n, min(s)::INT AS low, max(s)::INT AS high FROM (SELECT p_size * CASE WHEN p_type = 'LARGE' THEN 10 "
        "ELSE 1 END - 1 AS s FROM part) GROUP BY 1"),
    "quantiles_exact": (
        "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, "
        "round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 "
        "FROM lineitem GROUP BY ALL"),
    "shared_names": (
        "SELECT coalesce(sum(c), 0)::BIGINT AS shared FROM (SELECT count(*) AS c FROM part GROUP BY lower(p_name)) WHERE c > 1"),
    "clean_table": _raw_sql(
        "SELECT " + ", ".join([*_SCALARS, *[f"array_to_string({c}, '|') AS {c}" for c in _LISTS]]) + " FROM clean", *_CLEAN_CTES),
    "feature_table": _raw_sql(
        "SELECT company_id, ai_tag, ai_keyword, ai_tag OR ai_keyword AS is_ai, batch_status, "
        "(2001 - batch_year)::INT AS years_since_batch, len(tags)::INT AS tag_count, CASE WHEN team_size <= 0 THEN NULL "
        "WHEN team_size <= 1 THEN '1' WHEN team_size <= 2 THEN '2' WHEN team_size <= 5 THEN '3-5' WHEN team_size <= 10 THEN '6-10' "
        "WHEN team_size <= 50 THEN '11-50' WHEN team_size <= 200 THEN '51-200' WHEN team_size IS NOT NULL THEN '200+' END "
        "AS team_size_bucket, coalesce(length(long_description), 0)::INT AS description_length FROM feat", *_FEATURE_CTES),
    "explorer_sorted": _raw_sql(
        "SELECT name, batch, industry, subindustry, primary_city, primary_country, status, team_size, "
        "ai_tag OR ai_keyword AS is_ai, one_liner, website, profile_url FROM feat "
        "WHERE contains(lower(coalesce(name, '')) || ' ' || lower(coalesce(one_liner, '')), 'tailored')", *_FEATURE_CTES),
    "star_batches": _raw_sql("SELECT * FROM b", *_STAR_CTES),
    "star_industries": _raw_sql("SELECT * FROM i", *_STAR_CTES),
    "star_locations": _raw_sql("SELECT * FROM l", *_STAR_CTES),
    "star_companies": _raw_sql(_COMPANY_SELECT, *_STAR_CTES),
    "star_company_locations": _raw_sql("SELECT * FROM cl", *_STAR_CTES),
    "star_company_tags": _raw_sql("SELECT * FROM ct", *_STAR_CTES),
    "constraint_audit": _audit_sql(),
    "primary_counts": _raw_sql(
        "SELECT primaries, count(*) AS entities FROM (SELECT company_id, sum(is_primary)::BIGINT AS primaries FROM cl GROUP BY 1) "
        "GROUP BY 1", *_STAR_CTES),
}
