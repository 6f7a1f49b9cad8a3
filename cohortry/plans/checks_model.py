"""Bound scoring, split and outcome-model queries with checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import forest, importance, learners, scoring, splits
from cohortry.operators.metrics import rounded
from cohortry.plans import outcome_job
from cohortry.plans.bindings import cohort_view, table, with_cohort
from cohortry.session import stage, staging_path
from cohortry.sources import files, runlog

SPLIT = splits.YearSplit(first=1995, train_end=1998, last=2000, cutoffs=(1995, 1996, 1997, 1998))
SEED = 42


# ---------------------------------------------------------------- scores of line items
def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a score of many distinct values and ties, and a label that depends on it."""
    lines = table(spark, sf, "lineitem")
    score = F.round(F.col("l_extendedprice") / 105000 * 0.8 + F.col("l_discount"), 5)
    label = ((F.col("l_returnflag") == "R") | (F.col("l_extendedprice") > 90000)).cast("int")
    return lines.select("l_linestatus", score.alias("score"), label.alias("label"))


def _counts(spark: SparkSession, sf: str, by: tuple[str, ...] = ()) -> DataFrame:
    return scoring.score_counts(_scored(spark, sf), F.col("label"), F.col("score"), by)


def eval_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.ranking_metrics(_counts(spark, sf)), 6)


def eval_ranking_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.ranking_metrics(_counts(spark, sf, ("l_linestatus",)), ["l_linestatus"]), 6)


def eval_curve(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.curve(_counts(spark, sf)).select("score", "tp", "flagged")


def score_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    best = scoring.ranking_metrics(counts).select("threshold")
    return rounded(scoring.score_report(counts.withColumn("_t", best.scalar()), F.col("_t")), 6)


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf, ("l_linestatus",))
    return scoring.confusion(scoring.score_report(counts, F.lit(0.5), ["l_linestatus"]), ["l_linestatus"])


# ---------------------------------------------------------------- splits
def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.model_rows(cohort_view(spark, sf), SPLIT)


def _train_cells(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = splits.temporal_split(_rows(spark, sf), SPLIT)
    return splits.feature_cells(train)


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = splits.temporal_split(_rows(spark, sf), SPLIT)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), F.min("batch_year").alias("first"),
        F.max("batch_year").alias("last"))


def folds_forward(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = splits.temporal_split(_rows(spark, sf), SPLIT)
    return splits.with_folds(train, SPLIT.cutoffs).groupBy("fold", "role", "batch_year").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"))


def rare_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = splits.pool_rare(_train_cells(spark, sf), "country_group", min_rows=300)
    return pooled.groupBy("level").agg(F.sum("n").alias("n"), F.count("*").alias("members"))


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(splits.class_weights(_train_cells(spark, sf)), 6)


TREES = 25


def forest_draws(spark: SparkSession, sf: str) -> DataFrame:
    """What each tree of a forest draws of the training cells, by label."""
    drawn = forest.draws(_train_cells(spark, sf), splits.FEATURES, TREES, SEED)
    return drawn.groupBy("tree", "label").agg(
        F.sum("m").alias("drawn"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count_if(F.col("m") > 0).alias("cells"))


# ---------------------------------------------------------------- models
def baseline_result(spark: SparkSession, sf: str) -> DataFrame:
    """Validation and test results of the constant model, whose scores SQL can follow."""
    rows = stage(_rows(spark, sf), "rows")
    cells = stage(splits.feature_cells(rows), "cells")
    scores, _ = outcome_job.cross_validate(rows, cells, SPLIT, [learners.BASELINE], SEED)
    return rounded(outcome_job.summarise(scores), 6)


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """All five models with validation and test results."""
    return outcome_job.run(cohort_view(spark, sf), SPLIT, SEED).comparison


def model_cohort(spark: SparkSession, sf: str) -> DataFrame:
    names = (learners.BASELINE, "logistic_regression")
    return rounded(outcome_job.run(cohort_view(spark, sf), SPLIT, SEED, names).cohort, 6)


def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    names = (learners.BASELINE, "logistic_regression")
    return outcome_job.run(cohort_view(spark, sf), SPLIT, SEED, names).predictions()


def perm_importance(spark: SparkSession, sf: str) -> DataFrame:
    names = (learners.BASELINE, "logistic_regression")
    return outcome_job.run(cohort_view(spark, sf), SPLIT, SEED, names).importance()


def model_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """What a published run, published a second time, left behind: predictions, result document and log records, as (name, value)."""
    result = outcome_job.run(cohort_view(spark, sf), SPLIT, SEED, (learners.BASELINE, "logistic_regression"))
    out, log = staging_path(spark, "outcome"), staging_path(spark, "log")
    first = outcome_job.publish(result, out, log, "v1", repeats=2)
    again = outcome_job.publish(result, out, log, "v1", repeats=2)
    document = files.read_sidecar(spark, f"{out}/run={first}/result")
    predictions = files.read_csv(spark, f"{out}/*/predictions", result.predictions().schema)
    base = runlog.flatten_runs(runlog.read_runs(spark, log), ["test_pr_auc", "cv_pr_auc_mean"])
    facts = {"same run": float(first == again), "features": float(len(document["features"])), "n_train": float(document["cohort"]["n_train"]),
             "first test year": float(document["cohort"]["test_years"][0]), "judged": float(sum(document["confusion"].values()))}
    rows = spark.createDataFrame(list(facts.items()), "name string, value double")
    counted = predictions.agg(F.count("*").cast("double").alias("a"), F.sum("y_true").cast("double").alias("b"))
    logged = base.agg(F.count("*").cast("double").alias("a"), F.countDistinct("experiment_id").cast("double").alias("b"),
                      *[F.max(F.when(F.col("model") == learners.BASELINE, F.col(f"m_{c}"))).alias(c) for c in ("test_pr_auc", "cv_pr_auc_mean")])
    for df, names in ((counted, {"predictions": "a", "positives": "b"}),
                      (logged, {"records": "a", "record ids": "b", "baseline test_pr_auc": "test_pr_auc", "baseline cv_pr_auc_mean": "cv_pr_auc_mean"})):
        rows = rows.unionByName(df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in names.items()]))))
    return rows


def perm_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whose columns each test row takes in three repeats, counted by the countries of both."""
    _, test = splits.temporal_split(_rows(spark, sf), SPLIT)
    pairs = importance.permuted_pairs(test.select("company_id", "country_group"), "company_id", ["company_id", "country_group"], 3, SEED)
    return pairs.groupBy("repeat", "country_group", F.col("_donor.country_group").alias("donor_group")).agg(
        F.count("*").alias("n"), F.sum(F.col("company_id") * F.pmod(F.col("_donor.company_id"), F.lit(1009))).cast("long").alias("mixed"))


QUERIES = {
    "eval_ranking": eval_ranking,
    "eval_ranking_groups": eval_ranking_groups,
    "eval_curve": eval_curve,
    "score_report": score_report,
    "confusion": confusion,
    "model_rows": _rows,
    "feature_cells": _train_cells,
    "temporal_split": temporal_split,
    "folds_forward": folds_forward,
    "rare_pool": rare_pool,
    "class_weights": class_weights,
    "forest_draws": forest_draws,
    "baseline_result": baseline_result,
    "model_cohort": model_cohort,
    "model_comparison": model_comparison,
    "model_predictions": model_predictions,
    "perm_importance": perm_importance,
    "perm_pairs": perm_pairs,
    "model_outputs": model_outputs,
}


# ---------------------------------------------------------------- checking SQL
_SCORED = (
    "WITH s AS (SELECT l_linestatus, round(l_extendedprice / 105000 * 0.8::DOUBLE + l_discount, 5) AS score, "
    "(l_returnflag = 'R' OR l_extendedprice > 90000)::INT AS label FROM lineitem)"
)


def _ranking(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"c AS (SELECT {keys}score, sum(label)::BIGINT AS pos, count(*) AS n FROM s GROUP BY ALL), "
        f"r AS (SELECT *, (sum(pos) OVER ({part}ORDER BY score DESC))::BIGINT AS tp, "
        f"(sum(n) OVER ({part}ORDER BY score DESC))::BIGINT AS flagged, "
        f"(sum(pos) OVER ({part}))::DOUBLE AS p, (sum(n) OVER ({part}))::DOUBLE AS n_all FROM c), "
        "f AS (SELECT *, 2 * (tp::DOUBLE / flagged) * (tp::DOUBLE / p) / greatest(tp::DOUBLE / flagged + tp::DOUBLE / p, 1e-12) "
        "AS f1 FROM r), "
        f"k AS (SELECT {keys}sum((n - pos) * ((tp - pos) + pos * 0.5)) / (max(p) * max(n_all - p)) AS roc_auc, "
        f"sum(tp::DOUBLE / flagged * pos / p) AS pr_auc, arg_max(score, {{'f': f1, 's': -score}}) AS threshold, "
        f"max(f1) AS best_f1 FROM f {'GROUP BY ' + by if by else ''})"
    )


def _report(source: str) -> str:
    return (
        "SELECT tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, "
        "round(2 * pr * re / greatest(pr + re, 1e-12), 6) AS f1, round((tp + fn) / n::DOUBLE, 6) AS prevalence, "
        "round((tp + fp) / n::DOUBLE, 6) AS flagged_share, n FROM (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS pr, "
        f"tp / greatest(tp + fn, 1)::DOUBLE AS re FROM ({source}))"
    )


_CONFUSION = (
    "SELECT count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, "
    "count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, "
    "count(*) FILTER (WHERE score < threshold AND label = 1) AS fn, "
    "count(*) FILTER (WHERE score < threshold AND label = 0) AS tn, count(*) AS n FROM s, (SELECT threshold FROM k)"
)

_MODEL_ROWS = (
    ", x AS (SELECT * FROM cohort WHERE batch_status = 'complete' AND batch_year BETWEEN 1995 AND 2000), "
    "top AS (SELECT primary_country FROM x WHERE batch_year <= 1998 AND primary_country IS NOT NULL "
    "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), "
    "m AS (SELECT company_id, name, batch, coalesce(batch_season, 'Unknown') AS batch_season, "
    "coalesce(industry, 'Unknown') AS industry, coalesce(subindustry, 'Unknown') AS subindustry, "
    "CASE WHEN primary_country IS NULL THEN 'Unknown' WHEN primary_country IN (FROM top) THEN primary_country "
    "ELSE 'Other' END AS country_group, batch_year, is_ai::INT AS is_ai, (status = 'Inactive')::INT AS label FROM x)"
)
_BASELINE = (
    ", w AS (SELECT * FROM (VALUES (1, 1995, 1996), (2, 1996, 1997), (3, 1997, 1998), (0, 1998, 2000)) v(fold, a, b)), "
    "pr AS (SELECT fold, avg(label) AS score FROM m JOIN w ON batch_year <= a GROUP BY 1), "
    "sc AS (SELECT fold, score, label FROM m JOIN w ON batch_year > a AND batch_year <= b JOIN pr USING (fold)), "
    "cv AS (SELECT avg(p) AS m1, stddev_pop(p) AS m2 FROM (SELECT fold, avg(label) AS p FROM sc WHERE fold > 0 GROUP BY 1)), "
    "s AS (SELECT score, label FROM sc WHERE fold > 0), " + _ranking("")
)
_BASE_SELECT = (
    " SELECT 'baseline_prior' AS model, round(m1, 6) AS cv_pr_auc_mean, round(m2, 6) AS cv_pr_auc_std, "
    "0.5::DOUBLE AS cv_roc_auc_mean, 0.5::DOUBLE AS test_roc_auc, round(avg(label), 6) AS test_pr_auc, "
    "round(threshold, 6) AS test_threshold, "
    "round(CASE WHEN max(t.score) >= threshold THEN avg(label) ELSE 0 END, 6)::DOUBLE AS test_precision, "
    "(max(t.score) >= threshold)::INT::DOUBLE AS test_recall, "
    "round(CASE WHEN max(t.score) >= threshold THEN 2 * avg(label) / (1 + avg(label)) ELSE 0 END, 6)::DOUBLE AS test_f1, "
    "count(*) FILTER (WHERE t.score >= threshold AND label = 1) AS test_tp, "
    "count(*) FILTER (WHERE t.score >= threshold AND label = 0) AS test_fp, "
    "count(*) FILTER (WHERE t.score < threshold AND label = 1) AS test_fn, "
    "count(*) FILTER (WHERE t.score < threshold AND label = 0) AS test_tn, "
    "(max(t.score) >= threshold)::INT::DOUBLE AS test_flagged_share "
    "FROM (SELECT * FROM sc WHERE fold = 0) t, cv, k GROUP BY m1, m2, threshold"
)

_DRAWS = (
    ", cells AS (SELECT batch_season, industry, subindustry, country_group, batch_year, is_ai, label, count(*) AS n "
    "FROM m WHERE batch_year <= 1998 GROUP BY ALL), "
    "terms AS (SELECT x.n, k, sum(exp(-x.n) * pow(x.n, k) / factorial(k::INT)) OVER (PARTITION BY x.n ORDER BY k) AS cdf "
    "FROM range(0, 8) x(n), range(0, 32) y(k)), "
    "coded AS (SELECT *, md5(concat_ws('|', 42, tree, batch_season, industry, subindustry, country_group, batch_year, is_ai, label)) AS code "
    f"FROM cells, range(0, {TREES}) t(tree)), "
    "u AS (SELECT *, (('0x' || substr(code, 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u, "
    "(('0x' || substr(code, 14, 13))::BIGINT + 0.5) / 4503599627370496 AS v FROM coded), "
    "d AS (SELECT tree, label, CASE WHEN n < 8 THEN (SELECT count(*) FROM terms WHERE terms.n = u.n AND cdf < u.u) "
    "ELSE greatest(0, floor(n + sqrt(n) * sqrt(-2 * ln(u)) * cos(2 * pi() * v) + 0.5)) END::BIGINT AS m FROM u)"
)

ORACLES = {
    "forest_draws": with_cohort(
        _MODEL_ROWS + _DRAWS + " SELECT tree::INT AS tree, label, sum(m)::BIGINT AS drawn, sum(m * m)::BIGINT AS squares, "
        "count(*) FILTER (WHERE m > 0) AS cells FROM d GROUP BY ALL"),
    "eval_ranking": _SCORED + ", " + _ranking("")
    + " SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, threshold, round(best_f1, 6) AS best_f1 FROM k",
    "eval_ranking_groups": _SCORED + ", " + _ranking("l_linestatus")
    + " SELECT l_linestatus, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, threshold, "
      "round(best_f1, 6) AS best_f1 FROM k",
    "eval_curve": _SCORED + ", " + _ranking("") + " SELECT score, tp, flagged FROM r",
    "score_report": _SCORED + ", " + _ranking("") + " " + _report(_CONFUSION),
    "confusion": _SCORED + " SELECT l_linestatus, a AS actual, p AS predicted, "
    "count(*) FILTER (WHERE label = a AND (score >= 0.5)::INT = p) AS n FROM s, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p) "
    "GROUP BY ALL",
    "model_rows": with_cohort(_MODEL_ROWS + " SELECT * FROM m"),
    "feature_cells": with_cohort(
        _MODEL_ROWS + " SELECT batch_season, industry, subindustry, country_group, batch_year, is_ai, label, count(*) AS n "
        "FROM m WHERE batch_year <= 1998 GROUP BY ALL"),
    "temporal_split": with_cohort(
        _MODEL_ROWS + " SELECT CASE WHEN batch_year <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n, "
        "sum(label)::BIGINT AS positives, min(batch_year) AS first, max(batch_year) AS last FROM m GROUP BY 1"),
    "folds_forward": with_cohort(
        _MODEL_ROWS + " SELECT fold::INT AS fold, CASE WHEN batch_year <= a THEN 'train' ELSE 'validate' END AS role, batch_year, "
        "count(*) AS n, sum(label)::BIGINT AS positives FROM m, (VALUES (1, 1995, 1996), (2, 1996, 1997), (3, 1997, 1998)) "
        "v(fold, a, b) WHERE batch_year <= b GROUP BY ALL"),
    "rare_pool": with_cohort(
        _MODEL_ROWS + " SELECT CASE WHEN n >= 300 THEN country_group ELSE '(rare)' END AS level, sum(n)::BIGINT AS n, "
        "count(*) AS members FROM (SELECT country_group, count(*) AS n FROM m WHERE batch_year <= 1998 GROUP BY 1) GROUP BY 1"),
    "class_weights": with_cohort(
        _MODEL_ROWS + " SELECT label, count(*) AS n, round((SELECT count(*) FROM m WHERE batch_year <= 1998) "
        "/ (2.0 * count(*)), 6) AS weight FROM m WHERE batch_year <= 1998 GROUP BY 1"),
    "model_outputs": with_cohort(
        _MODEL_ROWS + ", v AS (SELECT avg(label) AS p FROM m, (VALUES (1995, 1996), (1996, 1997), (1997, 1998)) w(a, b) "
        "WHERE batch_year > a AND batch_year <= b GROUP BY a), "
        "t AS (SELECT count(*) FILTER (WHERE batch_year <= 1998) AS n_train, count(*) FILTER (WHERE batch_year > 1998) AS n_test, "
        "sum(label) FILTER (WHERE batch_year > 1998) AS positives, avg(label) FILTER (WHERE batch_year > 1998) AS rate FROM m) "
        "SELECT unnest(['same run', 'features', 'n_train', 'first test year', 'judged', 'predictions', 'positives', 'records', 'record ids', "
        "'baseline test_pr_auc', 'baseline cv_pr_auc_mean']) AS name, unnest([1, 6, n_train, 1999, n_test, n_test, positives, 2, 2, "
        "round(rate, 4), (SELECT round(avg(p), 4) FROM v)]::DOUBLE[]) AS value FROM t"),
    "perm_pairs": with_cohort(
        _MODEL_ROWS + ", t AS (SELECT company_id, country_group, row_number() OVER (ORDER BY md5(company_id::VARCHAR), company_id) - 1 AS i, "
        "count(*) OVER () AS rows FROM m WHERE batch_year > 1998), "
        f"maps AS (SELECT r, (SELECT min(a) FROM range(1 + (({SEED} + r) * 2654435761) % rows, 500 + (({SEED} + r) * 2654435761) % rows) x(a) "
        f"WHERE gcd(a, rows) = 1) AS a, (({SEED} + r) * 40503) % rows AS b FROM range(1, 4) z(r), (SELECT DISTINCT rows FROM t)) "
        "SELECT r::INT AS repeat, t.country_group, d.country_group AS donor_group, count(*) AS n, "
        "sum(t.company_id * (d.company_id % 1009))::BIGINT AS mixed "
        "FROM t, maps JOIN t d ON d.i = (a * t.i + b) % d.rows GROUP BY ALL"),
    "baseline_result": with_cohort(_MODEL_ROWS + _BASELINE + _BASE_SELECT),
    "model_cohort": with_cohort(
        _MODEL_ROWS + " SELECT count(*) FILTER (WHERE batch_year <= 1998) AS n_train, "
        "count(*) FILTER (WHERE batch_year > 1998) AS n_test, "
        "round(avg(label) FILTER (WHERE batch_year <= 1998), 6) AS train_rate, "
        "round(avg(label) FILTER (WHERE batch_year > 1998), 6) AS test_rate, "
        "'logistic_regression' AS best_model_by_cv FROM m"),
}
