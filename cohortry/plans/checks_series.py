"""Bound series, backtest and forecast queries with checking SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators import forecasting as fc
from cohortry.operators.metrics import rounded
from cohortry.operators.series import count_series, full_periods, membership, partial_period
from cohortry.plans.bindings import cohort_view, with_cohort
from cohortry.plans.forecast_job import METRICS
from cohortry.session import stage, staging_path
from cohortry.sources import runlog

_FIRST = 0


def _members():
    return membership(groups=(F.col("industry"), F.col("primary_country")))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly counts of all orders, both flags, every industry and every country."""
    return count_series(cohort_view(spark, sf), _members(), "month_t", "month_status", _FIRST)


def annual(spark: SparkSession, sf: str) -> DataFrame:
    return count_series(cohort_view(spark, sf), _members(), first=1995)


def full_years(spark: SparkSession, sf: str) -> DataFrame:
    return full_periods(cohort_view(spark, sf), first=1996)


def partial_year(spark: SparkSession, sf: str) -> DataFrame:
    return partial_period(cohort_view(spark, sf), _members())


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    """The series as a written table: the models read it several times."""
    return stage(monthly(spark, sf), "series")


def _backtest(*models: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(fc.backtest(fc.fits(_staged(spark, sf), models)), 6)

    return query


def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fc.compare_models(_staged(spark, sf)), 6)


def best_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fc.best_model(fc.compare_models(_staged(spark, sf))), 6)


def compare_short(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly series have too few points for a comparison and are reported as such."""
    _, rejected = fc.long_enough(annual(spark, sf))
    return rejected


def _forecast(level: float):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        fitted = stage(fc.fits(_staged(spark, sf)), "fits")
        metrics = fc.error_metrics(fc.backtest(fitted))
        return rounded(fc.forecast(fitted, metrics, 3, level), 6)

    return query


def _same_month_last_year(train: np.ndarray, h: int) -> np.ndarray:
    if len(train) < 12:
        raise ValueError("no year of data yet")
    return np.resize(train[-12:], h)


def plugin(spark: SparkSession, sf: str) -> DataFrame:
    """A Python model plugged in: the value twelve months before; the first origins fail and give null."""
    return fc.plugin_backtest(monthly(spark, sf), "same_month", _same_month_last_year)


def plugin_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fc.error_metrics(plugin(spark, sf)), 6)


def runs_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a run log, read back with the metrics as columns, newest first."""
    table = fc.compare_models(_staged(spark, sf), models=("naive", "moving_avg_3"))
    path = staging_path(spark, "runs")
    for model in ("naive", "moving_avg_3"):
        runlog.append_runs(runlog.run_records(
            table.filter(F.col("model") == model), "forecast", METRICS, {"min_train": fc.MIN_TRAIN}, ["series"],
            notes="monthly counts"), path)
    flat = runlog.flatten_runs(runlog.read_runs(spark, path), ["rmse", "mae", "n_eval", "absent"])
    return runlog.newest_first(flat, flat.columns).select(
        "kind", "model", "dataset_version", F.col("params")["series"].alias("series"),
        F.col("params")["min_train"].alias("min_train"), "m_rmse", "m_mae", "m_n_eval", "m_absent", "notes")


QUERIES = {
    "series_monthly": monthly,
    "series_annual": annual,
    "full_years": full_years,
    "partial_year": partial_year,
    "backtest_window_models": _backtest("naive", "moving_avg_3"),
    "backtest_arima": _backtest("arima_110"),
    "backtest_smoothing": _backtest("exp_smoothing"),
    "backtest_holt": _backtest("holt_damped"),
    "compare_models": compare_models,
    "best_model": best_model,
    "compare_short": compare_short,
    "forecast_interval": _forecast(0.8),
    "forecast_interval_wide": _forecast(0.95),
    "forecast_plugin": plugin,
    "plugin_metrics": plugin_metrics,
    "runs_table": runs_table,
}


# ---------------------------------------------------------------- checking SQL
_MEMBER = (
    "member AS (SELECT *, list_filter(['All companies', CASE WHEN is_ai THEN 'AI companies (broad)' END, "
    "CASE WHEN ai_tag THEN 'AI companies (tags only)' END, industry, primary_country], lambda m: m IS NOT NULL) AS ms FROM cohort)"
)


def _series(period: str, state: str, first: int) -> str:
    return (
        f"{_MEMBER}, per AS (SELECT {period} AS t FROM cohort WHERE {period} >= {first} GROUP BY 1 "
        f"HAVING bool_and({state} = 'complete')), "
        f"cnt AS (SELECT unnest(ms) AS series, {period} AS t FROM member WHERE {period} IS NOT NULL), "
        "ser AS (SELECT s.series, per.t, (SELECT count(*) FROM cnt c WHERE c.series = s.series AND c.t = per.t)::DOUBLE AS y "
        "FROM (SELECT DISTINCT series FROM cnt) s, per)"
    )


_MONTHLY = _series("month_t", "month_status", 0)

_ROWS = (
    "rows0 AS (SELECT series, t, y, row_number() OVER w AS k, count(*) OVER (PARTITION BY series) AS n_all, "
    "lead(t) OVER w AS next_t, lead(y) OVER w AS next_y, y - lag(y) OVER w AS w, "
    "avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ma3 "
    "FROM ser WINDOW w AS (PARTITION BY series ORDER BY t)), "
    "rows1 AS (SELECT *, lag(w) OVER (PARTITION BY series ORDER BY t) AS wp FROM rows0), "
    "rows2 AS (SELECT *, count(w) OVER u AS n, sum(w) OVER u AS s1, sum(w * w) OVER u AS s2, sum(w * wp) OVER u AS c1, "
    "max(CASE WHEN k = 2 THEN w END) OVER u AS w1 FROM rows1 "
    "WINDOW u AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING))"
)


def _ar_grid(name: str, source: str, grid: str) -> str:
    return (
        f"{name} AS (SELECT series, k, arg_min({{'i': i, 'phi': phi, 'mu': mu}}, {{'c': cost, 'i': i}}) AS b FROM ("
        "SELECT *, n * ln(((1 - phi * phi) * (w1 - mu) * (w1 - mu) + (s2 - w1 * w1) - phi * 2 * c1 + phi * phi * (s2 - w * w) "
        "- (1 - phi) * mu * 2 * d + (1 - phi) * mu * (1 - phi) * mu * (n - 1)) / n) - ln(1 - phi * phi) AS cost FROM ("
        "SELECT *, ((phi + 1) * w1 + d) / ((phi + 1) + (n - 1) * (1 - phi)) AS mu FROM ("
        f"SELECT *, (s1 - w1) - phi * (s1 - w) AS d FROM (SELECT *, i / 1000 AS phi FROM (SELECT r.*, {grid} AS i FROM {source}))))) "
        "GROUP BY ALL)"
    )


_ARIMA = (
    "arrows AS (SELECT * FROM rows2 WHERE n >= 4 AND n * s2 - s1 * s1 > 1e-9 * n * s2), "
    + _ar_grid("coarse", "arrows r", "unnest(range(-990, 991, 10))") + ", "
    + _ar_grid("fine", "arrows r JOIN coarse USING (series, k)", "unnest(range(coarse.b.i - 9, coarse.b.i + 10))")
)

_WINDOW_FITS = (
    "wfits AS (SELECT series, 'naive' AS model, k, t, next_t, next_y, y AS level, 0::DOUBLE AS drift, 0::DOUBLE AS swing, "
    "0::DOUBLE AS decay FROM rows2 UNION ALL "
    "SELECT series, 'moving_avg_3', k, t, next_t, next_y, ma3, 0, 0, 0 FROM rows2 UNION ALL "
    "SELECT series, 'arima_110', k, t, next_t, next_y, y, coalesce(b.mu, CASE WHEN k >= 5 THEN w END), "
    "coalesce(w - b.mu, CASE WHEN k >= 5 THEN 0 END), coalesce(b.phi, CASE WHEN k >= 5 THEN 0 END) FROM rows2 LEFT JOIN fine USING (series, k))"
)

_SES = (
    "sg AS (SELECT i / 50 AS al FROM range(1, 51) r(i)), "
    "ses AS (SELECT series, al, 1::BIGINT AS k, 0 + al * (y - 0) AS a, 1 * (1 - al) AS v, (y - 0) * (y - 0) AS uu, "
    "(y - 0) * 1::DOUBLE AS uv, 1::DOUBLE AS vv FROM rows0, sg WHERE k = 1 "
    "UNION ALL SELECT s.series, s.al, r.k, s.a + s.al * (r.y - s.a), s.v * (1 - s.al), s.uu + (r.y - s.a) * (r.y - s.a), "
    "s.uv + (r.y - s.a) * s.v, s.vv + s.v * s.v FROM ses s JOIN rows0 r ON r.series = s.series AND r.k = s.k + 1), "
    "sbest AS (SELECT * FROM ses QUALIFY row_number() OVER (PARTITION BY series, k ORDER BY uu - uv * (uv / vv), al) = 1), "
    "sfits AS (SELECT series, 'exp_smoothing' AS model, k, t, next_t, next_y, a + v * (uv / vv) AS level, 0::DOUBLE AS drift, "
    "0::DOUBLE AS swing, 0::DOUBLE AS decay FROM rows0 JOIN sbest USING (series, k))"
)

_HOLT_STEP = (
    "SELECT series, al, be, ph, k, a1 AS a, p1 AS p, q1 AS q, "
    "be * (a1 - a) + ((1 - be) * ph) * c AS c, be * (p1 - p) + ((1 - be) * ph) * r AS r, be * (q1 - q) + ((1 - be) * ph) * s AS s, "
    "uu + u * u AS uu, pu + fp * u AS pu, qu + fq * u AS qu, pp + fp * fp AS pp, pq + fp * fq AS pq, qq + fq * fq AS qq FROM ("
    "SELECT *, fa + al * u AS a1, fp * (1 - al) AS p1, fq * (1 - al) AS q1 FROM ("
    "SELECT *, y - fa AS u FROM (SELECT *, a + ph * c AS fa, p + ph * r AS fp, q + ph * s AS fq FROM (%s))))"
)
_HOLT = (
    "hg AS (SELECT al, be, ph FROM (SELECT i / 10 AS al FROM range(1, 11) r(i)), "
    "(SELECT unnest([0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS be), "
    "(SELECT unnest([0.8, 0.85, 0.9, 0.95, 0.995]::DOUBLE[]) AS ph)), "
    "holt AS (" + _HOLT_STEP % (
        "SELECT series, al, be, ph, k, y, 0::DOUBLE AS a, 1::DOUBLE AS p, 0::DOUBLE AS q, 0::DOUBLE AS c, 0::DOUBLE AS r, "
        "1::DOUBLE AS s, 0::DOUBLE AS uu, 0::DOUBLE AS pu, 0::DOUBLE AS qu, 0::DOUBLE AS pp, 0::DOUBLE AS pq, 0::DOUBLE AS qq "
        "FROM rows0, hg WHERE k = 1")
    + " UNION ALL " + _HOLT_STEP % (
        "SELECT h.series, al, be, ph, x.k, x.y, a, p, q, c, r, s, uu, pu, qu, pp, pq, qq FROM holt h "
        "JOIN rows0 x ON x.series = h.series AND x.k = h.k + 1")
    + "), hsolve AS (SELECT *, (pu * qq - qu * pq) / (pp * qq - pq * pq) AS l0, (qu * pp - pu * pq) / (pp * qq - pq * pq) AS b0 "
    "FROM holt WHERE pp * qq - pq * pq > 1e-9 * pp * qq), "
    "hbest AS (SELECT * FROM hsolve QUALIFY row_number() OVER (PARTITION BY series, k "
    "ORDER BY uu - l0 * pu - b0 * qu, al, be, ph) = 1), "
    "hfits AS (SELECT x.series, 'holt_damped' AS model, x.k, t, next_t, next_y, a + p * l0 + q * b0 AS level, "
    "0::DOUBLE AS drift, c + r * l0 + s * b0 AS swing, ph AS decay FROM rows0 x LEFT JOIN hbest h "
    "ON h.series = x.series AND h.k = x.k)"
)

_BACKTEST = (
    "bt AS (SELECT series, model, next_t AS t, next_y AS actual, level + drift + swing * decay AS pred FROM fits "
    "WHERE k >= 8 AND next_t IS NOT NULL)"
)
_METRICS = (
    "met AS (SELECT series, model, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse, "
    "avg(CASE WHEN actual > 0 THEN abs(actual - pred) / actual END) * 100 AS mape_pct, count(pred) AS n_eval, "
    "count(*) - count(pred) AS fit_failures FROM bt GROUP BY ALL), "
    "cmp AS (SELECT *, rmse / nullif(max(CASE WHEN model = 'naive' THEN rmse END) OVER (PARTITION BY series), 0) AS rmse_vs_naive "
    "FROM met)"
)
_ALL_FITS = (
    "fits AS (SELECT * FROM wfits UNION ALL SELECT * FROM sfits UNION ALL SELECT * FROM hfits)"
)
_EVERYTHING = (_MONTHLY, _ROWS, _ARIMA, _WINDOW_FITS, _SES, _HOLT, _ALL_FITS, _BACKTEST, _METRICS)


def _sql(body: str, *ctes: str) -> str:
    return with_cohort(", " + ", ".join(ctes) + " " + body)


def _one(source: str, models: str) -> str:
    return f"fits AS (SELECT * FROM {source} WHERE model IN ({models}))"


_BT_SELECT = "SELECT series, model, t, actual, round(pred, 6) AS pred FROM bt"
_MET_SELECT = (
    "SELECT series, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape_pct, 6) AS mape_pct, n_eval, fit_failures, "
    "round(rmse_vs_naive, 6) AS rmse_vs_naive FROM cmp"
)


def _forecast_sql(z: str, level: str) -> str:
    return _sql(
        "SELECT series, model, (t + h)::INT AS t, h, round(f, 6) AS forecast, round(greatest(f - half, 0), 6) AS lo, "
        f"round(f + half, 6) AS hi, {level}::DOUBLE AS interval_level FROM (SELECT series, model, t, h::INT AS h, "
        "level + drift * h + swing * decay * (1 - pow(decay, h)) / (1 - decay) AS f, "
        f"rmse * {z} * sqrt(h) AS half FROM fits JOIN met USING (series, model), range(1, 4) r(h) WHERE next_t IS NULL)",
        *_EVERYTHING)


_PLUGIN = (
    "pl AS (SELECT series, 'same_month' AS model, t, y AS actual, "
    "CASE WHEN k > 12 THEN lag(y, 12) OVER (PARTITION BY series ORDER BY t) END AS pred, k FROM rows0), "
    "bt AS (SELECT series, model, t, actual, pred FROM pl WHERE k > 8)"
)

ORACLES = {
    "series_monthly": _sql("SELECT * FROM ser", _MONTHLY),
    "series_annual": _sql("SELECT * FROM ser", _series("batch_year", "batch_status", 1995)),
    "full_years": with_cohort(
        "SELECT batch_year AS t FROM cohort WHERE batch_year >= 1996 GROUP BY 1 HAVING bool_and(batch_status = 'complete')"),
    "partial_year": _sql(
        "SELECT series, (SELECT min(batch_year) FROM cohort WHERE batch_status = 'in_progress') AS t, "
        "count(*) FILTER (WHERE batch_year = (SELECT min(batch_year) FROM cohort WHERE batch_status = 'in_progress')) AS n "
        "FROM (SELECT unnest(ms) AS series, batch_year FROM member WHERE batch_year IS NOT NULL) GROUP BY 1", _MEMBER),
    "backtest_window_models": _sql(
        _BT_SELECT, _MONTHLY, _ROWS, _ARIMA, _WINDOW_FITS, _one("wfits", "'naive', 'moving_avg_3'"), _BACKTEST),
    "backtest_arima": _sql(_BT_SELECT, _MONTHLY, _ROWS, _ARIMA, _WINDOW_FITS, _one("wfits", "'arima_110'"), _BACKTEST),
    "backtest_smoothing": _sql(_BT_SELECT, _MONTHLY, _ROWS, _SES, _one("sfits", "'exp_smoothing'"), _BACKTEST),
    "backtest_holt": _sql(_BT_SELECT, _MONTHLY, _ROWS, _HOLT, _one("hfits", "'holt_damped'"), _BACKTEST),
    "compare_models": _sql(_MET_SELECT, *_EVERYTHING),
    "best_model": _sql(
        "SELECT series, round(rmse, 6) AS rmse, model, round(rmse_vs_naive, 6) AS rmse_vs_naive, n_eval, "
        "CASE WHEN model <> 'naive' AND rmse_vs_naive < 0.95 THEN 'gain' ELSE 'no clear gain' END AS verdict FROM cmp "
        "QUALIFY row_number() OVER (PARTITION BY series ORDER BY rmse, model) = 1", *_EVERYTHING),
    "compare_short": _sql(
        "SELECT series, count(*) AS points FROM ser GROUP BY 1 HAVING count(*) < 12",
        _series("batch_year", "batch_status", 1995)),
    "forecast_interval": _forecast_sql("1.2816", "0.8"),
    "forecast_interval_wide": _forecast_sql("1.96", "0.95"),
    "forecast_plugin": _sql("SELECT * FROM bt", _MONTHLY, _ROWS, _PLUGIN),
    "plugin_metrics": _sql(
        "SELECT series, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape_pct, 6) AS mape_pct, n_eval, "
        "fit_failures FROM met", _MONTHLY, _ROWS, _PLUGIN, _METRICS),
    "runs_table": _sql(
        "SELECT 'forecast' AS kind, model, 'unknown' AS dataset_version, series, '8' AS min_train, round(rmse, 4) AS m_rmse, "
        "round(mae, 4) AS m_mae, n_eval::DOUBLE AS m_n_eval, NULL::DOUBLE AS m_absent, 'monthly counts' AS notes FROM met",
        _MONTHLY, _ROWS, _ARIMA, _WINDOW_FITS, _one("wfits", "'naive', 'moving_avg_3'"), _BACKTEST, _METRICS),
}
