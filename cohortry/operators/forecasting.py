"""Forecasts and rolling-origin backtests for many series at once.

Input is a long table (series, t, y) with one row per period.  A *fit* is what
a model has learnt from the first ``k`` points of a series.  Every model's fit
has the same four numbers, and its forecast ``h`` steps ahead is

    level + drift * h + swing * (decay + decay**2 + ... + decay**h)

so backtests (each ``k``, one step) and forecasts (last ``k``, many steps)
share one table of fits.  Fits at ``k`` use the first ``k`` points only.

Naive and moving average are one window over the series.  The others estimate
parameters.  For given smoothing weights the errors are linear in the start
values, so one pass that carries the normal equations yields the best start
values at every ``k``; the weights come from a grid.  The autoregressive model
needs running sums of the differences only.  So one pass over a series serves
all its origins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.stats import LEVEL_Z, finite
from cohortry.session import ship_package

# Fixed value: points before the first backtest origin; extra points a series needs to be compared.
MIN_TRAIN = 8
MIN_ORIGINS = 4

SES_WEIGHTS = tuple(i / 50 for i in range(1, 51))
HOLT_LEVEL = tuple(i / 10 for i in range(1, 11))
HOLT_TREND = (0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)
HOLT_DAMPING = (0.8, 0.85, 0.9, 0.95, 0.995)
# Coarse and fine search for the autoregressive weight, in thousandths.
_PHI_COARSE = np.arange(-990, 991, 10)
_PHI_FINE = np.arange(-9, 10)

_NONE = float("inf")


def step_ahead(h: Column) -> Column:
    """Forecast ``h`` steps after a fit; null where it is not finite."""
    swing = F.col("swing") * F.col("decay") * (F.lit(1.0) - F.pow("decay", h)) / (F.lit(1.0) - F.col("decay"))
    return finite(F.col("level") + F.col("drift") * h + swing)


def _state(level: Column, drift: Column | None = None, swing: Column | None = None, decay: Column | None = None) -> Column:
    zero = F.lit(0.0)
    return F.struct(
        level.cast("double").alias("level"),
        (zero if drift is None else drift).alias("drift"),
        (zero if swing is None else swing).alias("swing"),
        (zero if decay is None else decay).alias("decay"),
    )


# ---------------------------------------------------------------- window models
def _window_fits(series: DataFrame) -> DataFrame:
    """Last value and mean of the last three, by one window over each series."""
    by_time = Window.partitionBy("series").orderBy("t")
    rows = series.select(
        "series", "t", "y",
        F.row_number().over(by_time).alias("k"),
        F.lead("t").over(by_time).alias("next_t"),
        F.lead("y").over(by_time).alias("next_y"),
        F.avg("y").over(by_time.rowsBetween(-2, 0)).alias("_ma3"),
    )
    zero = F.lit(0.0)
    models = F.array(*[
        F.struct(F.lit(name).alias("model"), value.cast("double").alias("level"))
        for name, value in (("naive", F.col("y")), ("moving_avg_3", F.col("_ma3")))
    ])
    return rows.select("series", "k", "t", "next_t", "next_y", F.inline(models)).select(
        "series", "model", "k", "t", "next_t", "next_y", "level",
        zero.alias("drift"), zero.alias("swing"), zero.alias("decay"),
    )


# ---------------------------------------------------------------- estimated models
# Each returns, per prefix of y, (level, drift, swing, decay); NaN where there is no fit.
_NO_FIT = (np.nan, np.nan, np.nan, np.nan)


def _arima_states(y: np.ndarray) -> list[tuple]:
    """AR(1) with a mean on the differences, by exact Gaussian likelihood.

    Running sums of the differences are all it needs.  For a given weight the
    best mean and the likelihood have closed forms; the weight is searched on a
    coarse and then a fine grid.  No fit with fewer than four differences; when
    all of them are equal, the drift alone is exact.
    """
    w = np.diff(y)
    total, square = np.cumsum(w), np.cumsum(w * w)
    cross = np.append([0.0], np.cumsum(w[1:] * w[:-1]))
    out = [_NO_FIT] * len(y)

    def search(i: int, thousandths: np.ndarray) -> tuple[int, float, float]:
        phi, n, first, last = thousandths / 1000, i + 1, w[0], w[i]
        tail = (total[i] - first) - phi * (total[i] - last)
        mean = ((phi + 1) * first + tail) / ((phi + 1) + (n - 1) * (1 - phi))
        start = (1 - phi * phi) * (first - mean) * (first - mean)
        moves = (square[i] - first * first) - phi * 2 * cross[i] + phi * phi * (square[i] - last * last)
        gap = (1 - phi) * mean
        cost = n * np.log((start + moves - gap * 2 * tail + gap * gap * (n - 1)) / n) - np.log(1 - phi * phi)
        best = np.nanargmin(cost)
        return thousandths[best], phi[best], mean[best]

    for i in range(3, len(w)):
        if (i + 1) * square[i] - total[i] * total[i] > 1e-9 * (i + 1) * square[i]:
            near, _, _ = search(i, _PHI_COARSE)
            _, phi, mean = search(i, near + _PHI_FINE)
            out[i + 1] = (y[i + 1], mean, w[i] - mean, phi)
        else:
            out[i + 1] = (y[i + 1], w[i], 0.0, 0.0)
    return out


def _best_start(pp, pq, qq, pu, qu):
    """Least-squares start values from the normal equations, NaN where they are singular."""
    det = pp * qq - pq * pq
    det = np.where(det > 1e-9 * pp * qq, det, np.nan)
    return (pu * qq - qu * pq) / det, (qu * pp - pu * pq) / det


def _ses_states(y: np.ndarray, weights: np.ndarray) -> list[tuple]:
    """Simple smoothing with the weight of least squared error."""
    a, v = np.zeros_like(weights), np.ones_like(weights)
    uu = uv = vv = 0.0
    out = []
    for value in y:
        u = value - a
        uu, uv, vv = uu + u * u, uv + u * v, vv + v * v
        a, v = a + weights * u, v * (1 - weights)
        start = uv / vv
        best = np.argmin(uu - uv * start)
        out.append((a[best] + v[best] * start[best], 0.0, 0.0, 0.0))
    return out


def _holt_states(y: np.ndarray, grid: np.ndarray) -> list[tuple]:
    """Damped trend with the weights of least squared error: l = a + p*l0 + q*b0 and b = c + r*l0 + s*b0."""
    level, trend, damping = grid
    keep = (1 - trend) * damping
    zero, one = np.zeros_like(level), np.ones_like(level)
    a, p, q, c, r, s = zero, one, zero, zero, zero, one
    uu = pu = qu = pp = pq = qq = zero
    out = []
    for value in y:
        fa, fp, fq = a + damping * c, p + damping * r, q + damping * s
        u = value - fa
        uu, pu, qu = uu + u * u, pu + fp * u, qu + fq * u
        pp, pq, qq = pp + fp * fp, pq + fp * fq, qq + fq * fq
        a1, p1, q1 = fa + level * u, fp * (1 - level), fq * (1 - level)
        c, r, s = trend * (a1 - a) + keep * c, trend * (p1 - p) + keep * r, trend * (q1 - q) + keep * s
        a, p, q = a1, p1, q1
        l0, b0 = _best_start(pp, pq, qq, pu, qu)
        error = uu - l0 * pu - b0 * qu
        if np.isnan(error).all():
            out.append(_NO_FIT)
            continue
        i = np.nanargmin(error)
        out.append((a[i] + p[i] * l0[i] + q[i] * b0[i], 0.0, c[i] + r[i] * l0[i] + s[i] * b0[i], damping[i]))
    return out


def _estimated_fits(
    series: DataFrame, models: Sequence[str], ses: Sequence[float] = SES_WEIGHTS, levels: Sequence[float] = HOLT_LEVEL,
    trends: Sequence[float] = HOLT_TREND, dampings: Sequence[float] = HOLT_DAMPING,
) -> DataFrame:
    """The models with estimated parameters.

    A recursion over time with a parameter search has no built-in operator, so
    each series goes to one call that searches its grid as a vector.  A series
    has one point per period, and series spread over all tasks.
    """
    t_type = series.schema["t"].dataType.simpleString()
    numbers = "level double, drift double, swing double, decay double"
    out = f"series string, model string, k int, t {t_type}, next_t {t_type}, next_y double, {numbers}"
    weights = np.asarray(ses, float)
    grid = np.array([(a, b, d) for a in levels for b in trends for d in dampings], float).T
    fit = {
        "arima_110": _arima_states,
        "exp_smoothing": lambda y: _ses_states(y, weights),
        "holt_damped": lambda y: _holt_states(y, grid),
    }

    def run(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("t")
        y = points["y"].to_numpy(float)
        t = points["t"].tolist()
        frame = {
            "series": points["series"].iloc[0], "k": np.arange(1, len(y) + 1), "t": t,
            "next_t": pd.array([*t[1:], None], dtype="Int64"), "next_y": np.append(y[1:], np.nan),
        }
        parts = []
        for model in models:
            found = pd.DataFrame(fit[model](y), columns=["level", "drift", "swing", "decay"], dtype=float)
            parts.append(pd.DataFrame({**frame, "model": model}).join(found))
        return pd.concat(parts)[["series", "model", "k", "t", "next_t", "next_y", "level", "drift", "swing", "decay"]]

    ship_package(series.sparkSession)
    fitted = series.select("series", "t", "y").groupBy("series").applyInPandas(run, out)
    names = ["next_y", "level", "drift", "swing", "decay"]
    return fitted.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})


_WINDOW_MODELS = ("naive", "moving_avg_3")
MODELS = (*_WINDOW_MODELS, "exp_smoothing", "holt_damped", "arima_110")


def fits(series: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Rows (series, model, k, t, next_t, next_y, level, drift, swing, decay)."""
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    estimated = [m for m in models if m not in _WINDOW_MODELS]
    parts = []
    if len(estimated) < len(models):
        parts.append(_window_fits(series).filter(F.col("model").isin(*models)))
    if estimated:
        parts.append(_estimated_fits(series, estimated))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- evaluation
def backtest(fitted: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """Rows (series, model, t, actual, pred): each point from ``min_train`` on, predicted from its past."""
    origins = fitted.filter((F.col("k") >= min_train) & F.col("next_t").isNotNull())
    return origins.select(
        "series", "model", F.col("next_t").alias("t"), F.col("next_y").alias("actual"),
        step_ahead(F.lit(1.0)).alias("pred"),
    )


def error_metrics(predictions: DataFrame) -> DataFrame:
    """Per (series, model): mae, rmse, mape_pct (positive actuals), n_eval, fit_failures."""
    error = F.col("actual") - F.col("pred")
    return predictions.groupBy("series", "model").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.when(F.col("actual") > 0, F.abs(error) / F.nullif(F.col("actual"), F.lit(0.0)))) * 100).alias("mape_pct"),
        F.count("pred").alias("n_eval"),
        F.count_if(F.col("pred").isNull()).alias("fit_failures"),
    )


def long_enough(series: DataFrame, min_train: int = MIN_TRAIN) -> tuple[DataFrame, DataFrame]:
    """Series that can be compared, and rows (series, points) of those too short for it."""
    points = series.groupBy("series").agg(F.count("*").alias("points"))
    need = min_train + MIN_ORIGINS
    keep = points.filter(F.col("points") >= need).select("series")
    return series.join(keep, "series", "left_semi"), points.filter(F.col("points") < need)


def compare(predictions: DataFrame) -> DataFrame:
    """Metrics plus ``rmse_vs_naive`` (null when the naive error is zero)."""
    same_series = Window.partitionBy("series")
    naive = F.max(F.when(F.col("model") == "naive", F.col("rmse"))).over(same_series)
    return error_metrics(predictions).withColumn("rmse_vs_naive", F.try_divide(F.col("rmse"), naive))


def compare_models(series: DataFrame, min_train: int = MIN_TRAIN, models: Sequence[str] = MODELS) -> DataFrame:
    """Backtest and compare on the series that are long enough; the rest come from ``long_enough``."""
    usable, _ = long_enough(series, min_train)
    return compare(backtest(fits(usable, models), min_train))


def best_model(comparison: DataFrame) -> DataFrame:
    """Per series: the model of lowest RMSE and whether it clearly beats the naive one."""
    known = F.struct(F.coalesce(F.col("rmse"), F.lit(_NONE)).alias("rmse"), "model", "rmse_vs_naive", "n_eval")
    best = comparison.groupBy("series").agg(F.min(known).alias("b")).select("series", "b.*")
    gain = (F.col("model") != "naive") & (F.coalesce(F.col("rmse_vs_naive"), F.lit(1.0)) < 0.95)
    return best.withColumn("verdict", F.when(gain, "gain").otherwise("no clear gain"))


def forecast(fitted: DataFrame, metrics: DataFrame, horizon: int, level: float = 0.8) -> DataFrame:
    """Rows (series, model, t, h, forecast, lo, hi, interval_level) past the end of every series.

    The interval is the point forecast plus and minus z * rmse * sqrt(h), its
    lower end at least zero.
    """
    if level not in LEVEL_Z:
        raise ValueError(f"interval level must be one of {sorted(LEVEL_Z)}, not {level}")
    ends = fitted.filter(F.col("next_t").isNull())
    steps = ends.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    point = steps.select(
        "series", "model", (F.col("t") + F.col("h")).alias("t"), "h", step_ahead(F.col("h").cast("double")).alias("forecast")
    )
    known = point.join(metrics.select("series", "model", "rmse"), ["series", "model"])
    half = F.col("rmse") * LEVEL_Z[level] * F.sqrt("h")
    lo = F.col("forecast") - half
    return known.select(
        "series", "model", "t", "h", "forecast",
        F.when(lo.isNotNull(), F.greatest(lo, F.lit(0.0))).alias("lo"),
        (F.col("forecast") + half).alias("hi"), F.lit(level).alias("interval_level"),
    )


# ---------------------------------------------------------------- plug-in models
Forecaster = Callable[[np.ndarray, int], np.ndarray]


def plugin_backtest(series: DataFrame, name: str, model: Forecaster, min_train: int = MIN_TRAIN) -> DataFrame:
    """Backtest a Python forecaster ``f(train, h)``; a raised error or a non-finite value gives null.

    Series are spread over the tasks; one call sees one series, which has one
    point per period.
    """

    def one_step(train: np.ndarray) -> float | None:
        try:
            value = float(np.asarray(model(train, 1), dtype=float)[0])
        except Exception:
            return None
        return value if np.isfinite(value) else None

    def run(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("t")
        y = points["y"].to_numpy(float)
        later = points.iloc[min_train:]
        predicted = [one_step(y[:k]) for k in range(min_train, len(y))]
        return pd.DataFrame({
            "series": later["series"], "model": name, "t": later["t"], "actual": later["y"],
            "pred": pd.Series(predicted, index=later.index, dtype="object"),
        })

    ship_package(series.sparkSession)
    t_type = series.schema["t"].dataType.simpleString()
    out = f"series string, model string, t {t_type}, actual double, pred double"
    return series.groupBy("series").applyInPandas(run, out)
