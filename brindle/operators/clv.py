"""Lifetime value and permutation tests: small matrices on the driver, per-customer arithmetic on the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markov_value(matrix: DataFrame, margin: dict[str, float], rate: float, periods: int) -> DataFrame:
    """(state, finite, infinite) value of a customer in each state: the sum of discounted powers of the transition matrix times
    the margins, and (I - P / (1 + rate))^-1 m, which exists while P's spectral radius is below 1 + rate. A state nobody leaves keeps its customers."""
    states = list(margin)
    place = {s: i for i, s in enumerate(states)}
    p = np.eye(len(states))
    for r in matrix.collect():  # states x states
        if r["share"] is not None:
            p[place[r["from_state"]], place[r["to_state"]]] = r["share"]
    m = np.array(list(margin.values()))
    q = p / (1 + rate)
    if max(abs(np.linalg.eigvals(p))) >= 1 + rate:
        raise ValueError("the chain grows faster than the discount rate")
    finite, step = np.zeros(len(m)), m.copy()
    for _ in range(periods):
        finite, step = finite + step, q @ step
    infinite = np.linalg.solve(np.eye(len(m)) - q, m)
    return matrix.sparkSession.createDataFrame([(s, float(a), float(b)) for s, a, b in zip(states, finite, infinite)], "state string, finite double, infinite double")


def summary(p: DataFrame, as_of: str) -> DataFrame:
    """(customer, x repeat purchases, t_x age at the last one, t age now, spend a repeat purchase) in days, at day grain."""
    day = p.groupBy("customer", "day").agg(F.sum("amount").alias("amount"))
    g = day.groupBy("customer").agg((F.count("*") - 1).alias("x"), F.min("day").alias("f"), F.max("day").alias("l"), F.sum("amount").alias("m"), F.min_by("amount", "day").alias("m0"))
    return g.select("customer", "x", F.datediff("l", "f").alias("t_x"), F.datediff(F.lit(as_of).cast("date"), "f").alias("t"), F.when(F.col("x") > 0, (F.col("m") - F.col("m0")) / F.col("x")).alias("spend"))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _bgnbd_loglik(theta: np.ndarray, x, tx, t, w) -> float:
    r, alpha, a, b = np.exp(theta)
    one = _lgamma(r + x) - math.lgamma(r) + r * np.log(alpha) + math.lgamma(a + b) + _lgamma(b + x) - math.lgamma(b) - _lgamma(a + b + x)
    alive = -(r + x) * np.log(alpha + t)
    dead = np.where(x > 0, np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + tx), -np.inf)
    return float(np.sum(w * (one + np.logaddexp(alive, dead))))


def simplex(f, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder-Mead minimiser."""
    n = len(start)
    pts = [start] + [start + 0.5 * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        o = np.argsort(val)
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if abs(val[-1] - val[0]) < 1e-9 * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        ref = mid + (mid - pts[-1])
        fr = f(ref)
        if fr < val[0]:
            far = mid + 2 * (mid - pts[-1])
            ff = f(far)
            pts[-1], val[-1] = (far, ff) if ff < fr else (ref, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = ref, fr
        else:
            near = mid + 0.5 * (pts[-1] - mid)
            fn = f(near)
            if fn < val[-1]:
                pts[-1], val[-1] = near, fn
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def predictive(p: DataFrame, as_of: str, horizon: int, cells: int = 4000) -> DataFrame:
    """BG/NBD expected purchases within ``horizon`` days and Gamma-Gamma spend a purchase, for each customer.

    The likelihood is fitted on the driver to counts of customers in cells of (x, t_x, t), those without a repeat purchase apart, whose width grows until there are at most
    ``cells`` of them, so what is collected doesn't grow with the customers."""
    s = summary(p, as_of).where("t > 0")
    width = 1
    while True:
        c = s.groupBy(F.ceil(F.col("x") / width).alias("xx"), (F.floor(F.col("t_x") / width) * width).alias("tx"), (F.floor(F.col("t") / width) * width).alias("tt")).agg(F.count("*").alias("w"), F.avg("x").alias("x"), F.avg("t_x").alias("t_x"), F.avg("t").alias("t"))
        got = c.limit(cells + 1).toPandas()
        if len(got) <= cells:
            break
        width = max(width + 1, int(width * 2))
    x, tx, t, w = (got[k].to_numpy(float) for k in ("x", "t_x", "t", "w"))
    scale = max(1.0, float(t.max())) if len(t) else 1.0
    r, alpha, a, b = np.exp(simplex(lambda th: -_bgnbd_loglik(np.clip(th, -8, 8), x, tx / scale, t / scale, w), np.zeros(4))) if len(t) else np.ones(4)
    g = s.where("x > 0 and spend > 0").agg(F.avg("spend").alias("m"), F.var_samp("spend").alias("v"), F.avg(1 / F.col("x")).alias("i")).first()
    mean = g["m"] or 0.0
    spread = max(1e-9, (g["v"] or 0.0)) / max(mean, 1e-9) ** 2
    weight = 1 / max(spread, 1e-6)  # pseudo-purchases that the population's mean counts for
    h = horizon / scale

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in parts:
            xx, tt, tl = q["x"].to_numpy(float), q["t"].to_numpy(float) / scale, q["t_x"].to_numpy(float) / scale
            odds = np.where(xx > 0, a / (b + np.maximum(xx, 1) - 1) * ((alpha + tt) / (alpha + tl)) ** (r + xx), 0.0)
            alive = 1 / (1 + odds)
            spend = (q["spend"].fillna(mean).to_numpy(float) * xx + mean * weight) / (xx + weight)
            yield pd.DataFrame({"customer": q["customer"], "p_alive": alive, "expected_purchases": alive * (r + xx) / (alpha + tt) * h * b / (a + b), "expected_spend": spend})

    return s.mapInPandas(run, "customer long, p_alive double, expected_purchases double, expected_spend double")


def cai_permutation(intervals: DataFrame, draws: int, seed: int = 5) -> DataFrame:
    """(customer, cai, p_value): share of ``draws`` random orders of a customer's gaps whose index is as far from 0. Draws are seeded
    by the customer, so they don't depend on how rows are spread. A customer is one row with its gaps in order, so that Python gets many at once;
    equal gaps have one order only and need no draws."""

    def test(customer: int, g: np.ndarray) -> tuple[float, float]:
        mle = g.mean()
        if mle == 0:
            return 0.0, 1.0
        j = np.arange(1.0, len(g) + 1)
        cai = lambda v: (mle - v @ j / j.sum()) / mle * 100
        here = cai(g)
        if (g == g[0]).all():
            return here, 1.0
        null = cai(np.random.default_rng([seed, int(customer)]).permuted(np.tile(g, (draws, 1)), axis=1))
        return here, (1 + np.count_nonzero(abs(null) >= abs(here) - 1e-12)) / (draws + 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in parts:
            out = [test(c, np.asarray(g, float)) for c, g in zip(q["customer"], q["g"])]
            yield pd.DataFrame({"customer": q["customer"], "cai": [a for a, _ in out], "p_value": [p for _, p in out]})

    rows = intervals.groupBy("customer").agg(F.sort_array(F.collect_list(F.struct("j", "gap"))).getField("gap").alias("g"))
    # few bytes, much work: partitions by size would be too few
    spark = intervals.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "customer")
    return rows.mapInPandas(run, "customer long, cai double, p_value double")
