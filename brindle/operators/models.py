"""Fitted models on top of the library's: choice of k, baselines, forecasts, propensity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import distributions as dist
from brindle.operators import statistics as st


def choose_k(points: DataFrame, ks, seed: int = 1) -> DataFrame:
    """(k, cluster sizes' least, wgss, calinski_harabasz, silhouette, usable) of (id, features) for each k; usable if the smallest cluster has
    the larger of 30 and 5 % of the points."""
    points = points.persist()
    n = points.count()
    var = points.select(Summarizer.variance(F.col("features"))).first()[0] if n else None
    total = float(sum(var.toArray())) * (n - 1) if n > 1 else 0.0
    out = []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(points)
        sizes = m.summary.clusterSizes
        w = m.summary.trainingCost
        sil = ClusteringEvaluator().evaluate(m.transform(points)) if sum(s > 0 for s in sizes) > 1 else None
        out.append((k, min(sizes), float(w), float((total - w) / (k - 1) / (w / (n - k))) if w else None, sil, min(sizes) >= max(30, 0.05 * n)))
    return points.sparkSession.createDataFrame(out, "k int, least long, wgss double, calinski_harabasz double, silhouette double, usable boolean")


def seasonal_baseline(months: DataFrame) -> DataFrame:
    """(month, y, baseline, incremental): least squares on a trend and month dummies."""
    first = months.agg(F.min("month").alias("m0"))
    x = months.crossJoin(F.broadcast(first)).withColumn("trend", F.round(F.months_between("month", "m0")))
    xs = ["trend"]
    for i in range(2, 13):
        x = x.withColumn(f"m{i}", (F.month("month") == i).cast("double"))
        xs.append(f"m{i}")
    b = {r["term"]: r["estimate"] for r in st.ols(x, xs, "y").collect()}
    fit = sum((F.col(c) * b[c] for c in xs), F.lit(b["(intercept)"]))
    return x.select("month", "y", fit.alias("baseline"), (F.col("y") - fit).alias("incremental"))


def ets(series: DataFrame, period: int, horizon: int) -> DataFrame:
    """Additive Holt-Winters for each series (series, ds, y); a series shorter than two periods gets its mean."""

    def smooth(y: np.ndarray, a: float, b: float, g: float) -> tuple[float, float, np.ndarray, float]:
        level, trend = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
        season, sse = y[:period] - level, 0.0
        season = season.copy()
        for t in range(period, len(y)):
            s = season[t % period]
            e = y[t] - (level + trend + s)
            sse += e * e
            new = a * (y[t] - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            season[t % period] = g * (y[t] - new) + (1 - g) * s
            level = new
        return level, trend, season, sse

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ds")
        y = p["y"].to_numpy(float)
        steps = np.arange(1, horizon + 1)
        if len(y) < 2 * period:
            f = np.full(horizon, y.mean())
        else:
            grid = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.01, 0.1) for g in (0.05, 0.2, 0.4)]
            level, trend, season, _ = min((smooth(y, *q) for q in grid), key=lambda r: r[3])
            f = level + trend * steps + season[(len(y) + steps - 1) % period]
        return pd.DataFrame({"series": p["series"].iloc[0], "step": steps, "forecast": f})

    return series.groupBy("series").applyInPandas(run, "series string, step long, forecast double")


def repeat_model(rows: DataFrame) -> DataFrame:
    """AUC of a logistic model on (s, past) for y, trained on one half of the customers and measured on the other, and of recency alone; the model is
    only worth using if it gains 0.03."""
    x = VectorAssembler(inputCols=["s", "past"], outputCol="features").transform(rows)
    half = F.pmod(F.xxhash64("customer"), F.lit(2)) == 0
    m = LogisticRegression(labelCol="y", regParam=0.001).fit(x.where(half))
    test = m.transform(x.where(~half))
    a = BinaryClassificationEvaluator(labelCol="y").evaluate(test)
    b = st.auc(rows.where(~half), "s", "y").first()["auc"]
    return rows.sparkSession.createDataFrame([(float(a), float(b or 0.5), bool(a - (b or 0.5) >= 0.03))], "auc_model double, auc_recency double, deploy boolean")


def glm(rows: DataFrame, xs: list[str], y: str, family: str, link: str) -> DataFrame:
    """Generalised linear model with its dispersion: term, estimate, se, p_value, dispersion."""
    v = VectorAssembler(inputCols=xs, outputCol="features").transform(rows)
    m = GeneralizedLinearRegression(family=family, link=link, labelCol=y).fit(v)
    s = m.summary
    names = [*xs, "(intercept)"]
    est = [*m.coefficients.toArray().tolist(), m.intercept]
    disp = s.deviance / max(1, s.residualDegreeOfFreedom)
    return rows.sparkSession.createDataFrame([(n, float(e), float(se), 2 * (1 - dist.normal_cdf(abs(e / se))) if se else math.nan, float(disp)) for n, e, se in zip(names, est, s.coefficientStandardErrors)], "term string, estimate double, se double, p_value double, dispersion double")
