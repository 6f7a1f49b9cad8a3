import datetime as dt
import json

import pytest
from conftest import AS_OF, frame, record
from pyspark.sql import functions as F

from cohortry.functions import cohorts, flags, places, text
from cohortry.operators import audit, cleaning, quality, star, validation
from cohortry.operators.features import build_features
from cohortry.schemas import CLEAN_COLUMNS, FEATURE_COLUMNS
from cohortry.session import stage


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def cleaned(spark, dirty):
    raw = frame(spark, dirty)
    annotated = cleaning.annotate(raw, AS_OF, ["_order"]).cache()
    rows = {r["company_id"]: r for r in build_features(annotated.select(*CLEAN_COLUMNS), AS_OF).collect()}
    log = {r["step"]: r["rows_affected"] for r in cleaning.cleaning_log(raw, annotated).collect()}
    return rows, log


def test_cohort_labels(spark):
    def parsed(label):
        return one(spark, cohorts.parse_cohort(F.lit(label).cast("string")).alias("p"))["p"]

    winter = parsed(" Winter 2012 ")
    assert (winter["season"], winter["year"], winter["code"], winter["order"]) == ("Winter", 2012, "W12", 201201)
    assert winter["start"] == dt.date(2012, 1, 1)
    assert parsed("Spring 2025")["code"] == "X25"
    assert parsed("Fall 2024")["start"] == dt.date(2024, 9, 1)
    for space in ("\u00a0", "\u2003", " \t"):
        assert parsed(f"Fall{space}2024")["order"] == 202409
    for odd in ("Unspecified", "winter 2012", "Winter 12", None):
        assert all(v is None for v in parsed(odd))


def test_places(spark):
    def parsed(entry):
        p = one(spark, places.parse_place(F.lit(entry).cast("string")).alias("p"))["p"]
        return p["city"], p["region"], p["country"], p["is_remote"]

    assert parsed("San Francisco, CA, USA") == ("San Francisco", "CA", "United States", False)
    assert parsed("London, England, Greater, UK") == ("London", "England, Greater", "United Kingdom", False)
    assert parsed("Paris, France") == ("Paris", None, "France", False)
    assert parsed("rEmote") == (None, None, None, True)
    assert parsed("India") == (None, None, "India", False)
    assert parsed(",") == (None, None, None, False)
    assert parsed(None) == (None, None, None, False)


def test_text(spark):
    row = one(
        spark, text.split_list(F.lit("A, B; Remote ;")).alias("a"), text.split_list(F.lit("")).alias("b"),
        text.split_list(F.lit(None).cast("string")).alias("c"), text.clean_text(F.lit("  a \t  b\x1f ")).alias("d"),
        text.clean_text(F.lit("   ")).alias("e"), text.after_last(F.lit("A -> B -> C")).alias("f"),
        text.after_last(F.lit("A")).alias("g"), text.after_last(F.lit("A ->")).alias("h"),
        text.clean_list(F.array(F.lit(" x"), F.lit("y"), F.lit(None), F.lit(" "), F.lit("x"))).alias("i"),
    )
    assert row["a"] == ["A, B", "Remote"] and row["b"] == [] and row["c"] == []
    assert row["d"] == "a b" and row["e"] is None
    assert (row["f"], row["g"], row["h"]) == ("C", None, "")
    assert row["i"] == ["x", "y"]


def test_flags(spark):
    def tagged(*tags):
        return one(spark, flags.any_tag_matches(F.array(*map(F.lit, tags))).alias("v"))["v"]

    def worded(words):
        return one(spark, flags.text_matches(F.lit(words).cast("string"), F.lit(None).cast("string")).alias("v"))["v"]

    assert tagged("Generative AI") and tagged("AI-powered Drug Discovery") and tagged("x", "Machine Learning")
    assert not tagged("SaaS", "Fintech", "Paid")
    assert worded("An LLM-based assistant") and not worded("Sells tailored suits") and not worded(None)
    assert not worded("éai") and worded("the A.I.x age")
    # A pattern of the caller's own may begin with any letter.
    words = F.lit("zinc and iron")
    assert one(spark, flags.text_matches(words, F.lit(None).cast("string"), r"\bzinc").alias("v"))["v"]
    assert one(spark, flags.any_tag_matches(F.array(words), "iron$").alias("v"))["v"]


def test_states_and_sizes(spark):
    def state(day):
        return one(spark, cohorts.cohort_state(F.lit(day).cast("date"), AS_OF).alias("v"))["v"]

    assert [state(d) for d in ("2027-01-01", "2026-09-01", "2012-01-01", None)] == ["future", "in_progress", "complete", "unknown"]
    assert state("2026-06-01") == "complete" and state("2026-06-02") == "in_progress"
    sizes = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 5, 6, 10, 11, 50, 51, 200, 201, None)], "v int")
    labels = [r[0] for r in sizes.select(flags.size_class(F.col("v"))).collect()]
    assert labels == [None, "1", "2", "3-5", "3-5", "6-10", "6-10", "11-50", "11-50", "51-200", "51-200", "200+", None]


def test_epochs(spark):
    first, last = dt.date(2005, 1, 1), AS_OF
    rows = spark.createDataFrame([(1104537600,), (1104537599,), (1790726400,), (1790726401,), (None,), (10**15,)], "s long")
    ok = cohorts.epoch_in_bounds(F.col("s"), first, last)
    got = [r[0] for r in rows.select(F.when(ok, cohorts.epoch_to_timestamp(F.col("s")))).collect()]
    assert got == [dt.datetime(2005, 1, 1), None, dt.datetime(2026, 9, 30), None, None, None]


def test_last_record_per_id_is_kept(cleaned):
    rows, log = cleaned
    assert len(rows) == 7 and rows[31]["name"] == "Third try" and rows[31]["team_size"] == 11 and log["duplicate_ids"] == 2


def test_cleaned_values(cleaned):
    rows, log = cleaned
    assert rows[33]["team_size"] is None and rows[37]["team_size"] is None and rows[34]["team_size"] == 11
    assert rows[31]["status"] == "Public" and rows[31]["is_operating"] and rows[33]["status"] == "Unknown" and not rows[33]["is_operating"]
    assert rows[34]["primary_country"] == "Norway" and rows[34]["primary_city"] == "Oslo" and rows[34]["is_remote"]
    assert rows[33]["primary_country"] is None and rows[33]["is_remote"] and rows[36]["primary_country"] is None
    assert rows[35]["subindustry"] == "Grain" and rows[35]["website"] == "http://mill.example.org/"
    assert rows[34]["name"] == "Mill 34 Works" and rows[36]["launched_at"] is None
    assert rows[34]["launched_at"] == dt.datetime(2014, 6, 6)
    assert rows[35]["batch"] == rows[36]["batch"] == "Fall 2014" and rows[35]["batch_year"] == rows[36]["batch_year"] == 2014
    expected = {"unknown_status": 1, "industry_unspecified": 1, "unparsed_batch": 1, "team_size_invalid": 1, "team_size_missing": 2, "no_physical_location": 2}
    assert {step: log[step] for step in expected} == expected and len(log) == 10


def test_features(cleaned):
    rows, _ = cleaned
    assert rows[34]["is_ai"] and rows[34]["ai_tag"] and not rows[31]["is_ai"]
    assert rows[38]["batch_status"] == "future" and rows[37]["batch_status"] == "unknown" and rows[35]["batch_status"] == "complete"
    assert rows[31]["team_size_bucket"] == "11-50" and rows[31]["years_since_batch"] == 12 and rows[38]["team_size_bucket"] == "200+"
    assert rows[34]["tag_count"] == 2 and rows[31]["description_length"] == len("Turns grain into flour.")
    assert set(FEATURE_COLUMNS) <= set(rows[31].asDict())


def test_only_the_extreme_size_is_an_outlier(spark):
    records = [record(i, team_size=str(2 + i % 6)) for i in range(10, 60)] + [record(6, team_size="100000")]
    raw = frame(spark, records)
    flagged = cleaning.clean(raw, AS_OF, ["_order"]).filter("team_size_outlier").collect()
    assert [r["company_id"] for r in flagged] == [6]
    roughly = cleaning.clean(raw, AS_OF, ["_order"], exact=False).filter("team_size_outlier").collect()
    assert [r["company_id"] for r in roughly] == [6]


def test_null_and_odd_numbers(spark):
    values = spark.createDataFrame([("2.5",), ("3.5",), ("n/a",), ("NaN",), ("Infinity",), (" 7 ",), (None,)], "v string")
    size = F.bround(cleaning.number(F.col("v")), 0).cast("int")
    assert [r[0] for r in values.select(size).collect()] == [2, 4, None, None, None, 7, None]


def test_validation(spark, dirty):
    def check(records):
        lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
        keyed = lines.select(
            F.get_json_object("value", "$.id").cast("long").alias("id"),
            F.get_json_object("value", "$.status").alias("status"))
        return validation.verdict(validation.field_presence(lines, "value"), keyed, "id", "status")

    good = check([{**r, "status": "Public"} for r in dirty[3:]]).first()
    assert good["ok"] and good["errors"] == [] and good["warnings"] == [] and good["n_records"] == 6
    full = check(dirty).first()
    assert full["ok"] and full["warnings"] == ["2 duplicate ids", "9 unexpected status values"]
    partial = [{k: v for k, v in r.items() if k != "stage" or r["id"] > 33} for r in dirty]
    assert "field absent from 4 records: stage" in check(partial).first()["warnings"]
    bad = check([{"id": 1}])
    assert not bad.first()["ok"] and len(bad.first()["errors"]) == 19
    empty = check([]).first()
    assert not empty["ok"] and empty["errors"] == ["no records"] and empty["n_records"] == 0
    with pytest.raises(ValueError):
        validation.require_valid(bad)


def test_null_counts_as_one_key(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert df.agg(validation.duplicate_count(F.col("k"))).first()[0] == 2
    assert cleaning.count_shared(df, F.col("k"), "n").first()[0] == 4


def test_quality_report(spark, dirty):
    raw = frame(spark, dirty)
    annotated = cleaning.annotate(raw, AS_OF, ["_order"]).cache()
    clean = annotated.select(*CLEAN_COLUMNS)
    report = quality.quality_report(raw, clean, cleaning.cleaning_log(raw, annotated))
    found = {(r["section"], r["item"]): r["value"] for r in report.collect()}
    assert found["table", "raw_rows"] == "9" and found["table", "clean_rows"] == "7" and found["table", "columns"] == "33"
    assert found["missing_pct", "team_size"] == "28.57" and found["missing_pct", "tags"] == "0.0"
    assert found["duplicates", "company_id"] == "0" and found["unique_counts", "batch"] == "3"
    assert found["invalid_values", "duplicate_ids"] == "2" and found["dtypes", "tags"] == "array<string>"
    assert (found["range_low", "batch_year"], found["range_high", "batch_year"]) == ("2014", "2028")


@pytest.fixture(scope="module")
def tables(spark, dirty):
    features = build_features(cleaning.clean(frame(spark, dirty), AS_OF, ["_order"]), AS_OF)
    return {name: df.cache() for name, df in star.build_tables(features.cache()).items()}


def test_star_schema(tables):
    """One label with three kinds of white space is one cohort, and no entity is repeated."""
    assert [r["batch"] for r in tables["batches"].orderBy("batch_id").collect()] == ["Fall 2014", "Winter 2028", "Harvest 12"]
    assert tables["batches"].filter("batch = 'Fall 2014'").first()["year"] == 2014
    assert [r["place_raw"] for r in tables["locations"].orderBy("location_id").collect()] == [
        "Lima, Lima Province, Peru", "remote", "Remote", "Oslo, Norway"]
    company = {r["company_id"]: r for r in tables["companies"].collect()}
    assert tables["companies"].count() == len(company) == 7 and all(r["batch_id"] and r["industry_id"] for r in company.values())
    assert company[33]["primary_location_id"] is None and company[34]["primary_location_id"] == 4
    assert company[31]["is_operating"] == 1 and company[31]["launched_at"] == "2014-06-06"
    assert list(star.COMPANY_COLUMNS) == tables["companies"].columns and len(star.COMPANY_COLUMNS) == 23
    primaries = {r["company_id"]: r["s"] for r in tables["company_locations"].groupBy("company_id").agg(F.sum("is_primary").alias("s")).collect()}
    assert primaries[34] == 1 and primaries[33] == 0 and 36 not in primaries


def test_a_label_stays_one_row_whatever_it_parses_to(spark, tables):
    features = spark.createDataFrame(
        [(1, "odd", "Fall", 2001, "F01", 200109, None, "complete"), (2, "odd", None, None, None, None, None, "unknown")],
        "company_id long, batch string, batch_season string, batch_year int, batch_code string, batch_order int, batch_start date, batch_status string")
    rows = star.batches(features).collect()
    assert [(r["batch"], r["year"]) for r in rows] == [("odd", 2001)]


def test_audit_finds_nothing_in_the_star_and_finds_planted_faults(spark, tables):
    assert audit.audit(tables, star.RULES).filter("violations > 0").count() == 0
    broken = dict(tables)
    broken["company_tags"] = tables["company_tags"].unionAll(tables["company_tags"].limit(1)).unionByName(
        spark.createDataFrame([(99, "x"), (98, None)], "company_id long, tag string"))
    rules = {"company_tags": star.RULES["company_tags"]}
    found = {(r["rule"], r["columns"]): r["violations"] for r in audit.audit(broken, rules).collect()}
    assert found == {("primary key", "company_id,tag"): 1, ("not null", "company_id"): 0, ("not null", "tag"): 1,
                     ("foreign key", "company_id"): 2}
    counts = {r["primaries"]: r["entities"] for r in audit.primary_counts(tables["company_locations"]).collect()}
    assert counts == {1: 5, 0: 1}


def test_primary_counts_writes_what_it_reads(spark, tmp_path, monkeypatch):
    """The features written for the bridge hold its columns alone; a place is primary unless all of an entity's places are remote."""
    from cohortry.plans import checks_clean

    rows = [(1, 10, "O", 9000.0, dt.datetime(1997, 3, 1), "3-MEDIUM"), (2, 11, "F", 9000.0, dt.datetime(1998, 7, 1), "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10, "a", 1, 100.0, "BUILDING"), (11, "b", 1, -5.0, "FURNITURE")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "PERU", 2)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(2, "AMERICA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    written = []
    monkeypatch.setattr(checks_clean, "stage", lambda df, name: written.append(df.columns) or stage(df, name))
    counts = {r["primaries"]: r["entities"] for r in checks_clean.primary_counts(spark, str(tmp_path)).collect()}
    assert counts == {1: 1, 0: 1} and written == [["company_id", "location_entries"]]
