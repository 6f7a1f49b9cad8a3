import json

import pytest
from conftest import AS_OF, record
from pyspark.sql import functions as F

from cohortry.plans import directory_job, forecast_job
from cohortry.session import stage, staging_root
from cohortry.sources import files, runlog


def write_raw(path, records, lines=False):
    path.write_text("\n".join(json.dumps(r) for r in records) if lines else json.dumps(records))
    return str(path)


def test_json_array_and_lines(spark, dirty, tmp_path):
    for lines in (False, True):
        path = write_raw(tmp_path / f"raw{lines}.json", dirty, lines)
        rows = files.read_records(spark, path, lines).orderBy("_order").collect()
        assert [r["id"] for r in rows] == [r["id"] for r in dirty] and rows[3]["tags"] == ["Machine Learning", "Mills"]
        assert files.read_record_text(spark, path, lines).count() == 9
    with pytest.raises(FileNotFoundError):
        files.read_records(spark, str(tmp_path / "none.json"))


def test_guard(spark, tmp_path):
    with pytest.raises(ValueError):
        files.require_records(files.read_records(spark, write_raw(tmp_path / "empty.json", [])))
    bad = tmp_path / "bad.json"
    bad.write_text('{"id": 1}\nnot json\n')
    with pytest.raises(ValueError):
        files.require_records(files.read_records(spark, str(bad), lines=True))


def test_csv_keeps_text_and_nulls(spark, tmp_path):
    rows = [(1, 'says "hi", twice\nand more', 2.5, ["a", "b"]), (2, None, None, [])]
    files.write_csv(spark.createDataFrame(rows, "id int, t string, v double, l array<string>"), str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), "id int, t string, v double, l string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'says "hi", twice\nand more', 2.5, '["a","b"]'), (2, None, None, "[]")]


def test_versions(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc")
    row = files.file_manifest(spark, str(tmp_path / "f")).first()
    assert (row["bytes"], row["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest()) and len(row["version"]) == 12
    texts = spark.createDataFrame([("s", "x"), ("s", "y"), ("s", "é")], "g string, t string")
    a = files.content_versions(texts, "t", "g").first()
    b = files.content_versions(texts.orderBy(F.desc("t")), "t", "g").first()
    assert a == b and a["bytes"] == 4
    assert files.content_versions(texts.limit(2), "t", "g").first()["version"] != a["version"]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert runlog.read_runs(spark, path).isEmpty()
    first = spark.createDataFrame([("m1", 0.61239, float("nan"))], "model string, auc double, bad double")
    runlog.append_runs(runlog.run_records(first, "classification", ["auc", "bad"], {"a": 1}, features=["f"], version="v1"), path)
    second = spark.createDataFrame([("m2", 3.0)], "model string, rmse double")
    runlog.append_runs(runlog.run_records(second, "forecast", ["rmse"], version="v1"), path)
    flat = runlog.flatten_runs(runlog.read_runs(spark, path)).orderBy("model").collect()
    assert [r["model"] for r in flat] == ["m1", "m2"] and flat[0]["m_auc"] == 0.6124 and flat[0]["m_bad"] is None
    assert flat[0]["experiment_id"] != flat[1]["experiment_id"] and flat[0]["params"] == {"a": "1"}
    shown = runlog.newest_first(runlog.flatten_runs(runlog.read_runs(spark, path)), ["model", "m_rmse", "m_none"])
    assert shown.columns == ["model", "m_rmse"] and shown.count() == 2


def test_staging_uses_the_session_folder(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert stage(spark.range(5), "t").count() == 5


def test_whole_directory_job(spark, dirty, tmp_path):
    raw = write_raw(tmp_path / "raw.json", [*dirty, *[record(i, batch=f"Winter {2006 + i % 15}", team_size=str(i % 9 + 1)) for i in range(40, 420)]])
    out = str(tmp_path / "out")
    first = {r["table"]: r["rows"] for r in directory_job.run(spark, raw, out, AS_OF).collect()}
    again = {r["table"]: r["rows"] for r in directory_job.run(spark, raw, out, AS_OF).collect()}
    assert first == again and first["companies"] == 387 and first["company_tags"] == 388 and first["locations"] == 4
    assert directory_job.check(spark, out).filter("violations > 0").isEmpty()
    meta = files.read_sidecar(spark, f"{out}/dataset_meta")
    assert meta["n_companies"] == 387 and len(meta["dataset_version"]) == 12
    assert files.read_sidecar(spark, f"{out}/absent") == {}
    assert spark.read.parquet(f"{out}/cleaning_log").filter("step = 'duplicate_ids'").first()["rows_affected"] == 2
    features = spark.read.parquet(f"{out}/features")
    table = forecast_job.run(features, f"{out}/backtest", f"{out}/runs", meta["dataset_version"])
    names = {r["series"] for r in table.collect()}
    assert names == {"All companies", "Food", "AI companies (broad)", "AI companies (tags only)"}
    assert runlog.read_runs(spark, f"{out}/runs").count() == 4 * 5
    csv = files.read_csv(spark, f"{out}/backtest", table.schema)
    assert csv.count() == 20


def test_invalid_raw_stops_the_job(spark, tmp_path):
    with pytest.raises(ValueError, match="validation"):
        directory_job.validate(spark, write_raw(tmp_path / "raw.json", [{"id": 1}]))


TRICKY = [
    {"id": 1, "name": 'a "quoted" } ] text', "tags": ["x}", "{", '\\"'], "status": "\\"},
    {"id": 2, "name": "é{[日本}", "tags": [], "website": "line\nfeed"},
    {"id": 3, "name": None, "tags": ["\\\\", "}}}]]]"]},
    {}, {"id": 5, "slug": "}" * 400 + '"' * 40},
]


def test_arrays_by_ranges_equal_lines(spark, tmp_path):
    """Whatever the ranges' size and the layout, the records of an array are those of the lines form, in order."""
    records = [r | {"url": f"u{k}"} for k in range(30) for r in TRICKY]
    want = [r.asDict() for r in files.read_records(spark, write_raw(tmp_path / "l.json", records, lines=True), lines=True).orderBy("_order").drop("_order").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k, (indent, size) in enumerate([(None, "128m"), (None, "700b"), (2, "300b")]):
        path = tmp_path / f"a{k}.json"
        path.write_text(" \n" + json.dumps(records, indent=indent, ensure_ascii=k == 1) + "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.read_records(spark, str(path), array_bytes=0).orderBy("_order").drop("_order").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [r.asDict() for r in rows] == want


def test_arrays_by_ranges_keep_what_is_broken(spark, tmp_path):
    def read(text):
        (tmp_path / "x.json").write_text(text)
        return files.read_records(spark, str(tmp_path / "x.json"), array_bytes=0)

    assert read("[]").count() == 0 and read(" [ ] \n").count() == 0
    with pytest.raises(ValueError):
        files.require_records(read("[]").select("id", "_corrupt"))
    rows = read('[{"id": 1}, {"id": 2, "name": "cut').orderBy("_order").collect()
    assert len(rows) == 2 and rows[0]["id"] == 1 and rows[0]["_corrupt"] is None and rows[1]["_corrupt"] is not None


def test_hash_tree(spark, tmp_path):
    import hashlib

    lines = [f"line {k} " + "x" * (k % 97) for k in range(3000)]
    (tmp_path / "big").write_text("\n".join(lines) + "\n")
    (tmp_path / "small").write_bytes(b"abc")
    blocks, at = {}, 0
    for line in lines:
        blocks.setdefault(at // 5000, []).append(line + "\n")
        at += len(line) + 1
    want = hashlib.sha256("".join(hashlib.sha256("".join(blocks[b]).encode()).hexdigest() for b in sorted(blocks)).encode()).hexdigest()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "10k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = {r["path"].rsplit("/", 1)[1]: r for r in files.file_manifest(spark, str(tmp_path / "*"), whole_bytes=1000, block_bytes=5000).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert found["big"]["sha256"] == want and found["big"]["bytes"] == at and found["small"]["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_every_event_tells_its_own_keys(spark, tmp_path):
    """Records of all event types count by the keys that they hold: null values are there, no record and an empty one are not."""
    from cohortry.plans import checks_clean

    props = {"error": '{"k": 1, "z": null}', "view": '{"z": 2}', "click": "{}", "purchase": None, "signup": '{"k": null, "other": {"never": 1}}'}
    rows = [(i, kind, text) for i, (kind, text) in enumerate(props.items())]
    events = spark.createDataFrame(rows, "event_id long, event_type string, props string")
    none = {"ts": "timestamp_ntz", "user_id": "long", "value": "double"}
    events.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).write.parquet(str(tmp_path / "events.parquet"))
    found = {r["field"]: tuple(r)[1:] for r in checks_clean.scan_json_fields(spark, str(tmp_path)).collect()}
    assert found == {"k": (2, 3, "warning"), "z": (2, 3, "warning"), "never": (0, 5, "error")}
