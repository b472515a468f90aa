"""Rank comparisons, residual diagnostics, matching, cluster preparation, resampling, master-data checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import distributions as dist
from brindle.operators import ordered, statistics as st
from brindle.session import discard, materialise


def bootstrap(rows: DataFrame, group: str, y: str, draws: int = 2000, seed: int = 3) -> DataFrame:
    """Mean and its 95 % percentile interval by the Poisson bootstrap: a row's weight in a draw is a Poisson number from the hash of
    (seed, draw, key), so draws are partial sums that combine in any order and no group is collected.

    ``rows`` must hold a column ``key`` that tells rows apart."""
    # inverse of the Poisson(1) distribution at a hashed uniform number
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    cuts = np.array(steps)
    base = rows.where(F.col(y).isNotNull()).select(F.col(group).alias("grp"), F.col(y).cast("double").alias("y"), F.xxhash64(F.lit(seed), "key").alias("h"))

    def run(parts):
        for q in parts:
            out = []
            for g, x in q.groupby("grp", dropna=False):
                s, n = np.zeros(draws), np.zeros(draws)
                h, v = x["h"].to_numpy().view(np.uint64), x["y"].to_numpy()
                for a in range(0, len(v), 500):
                    z = h[a : a + 500, None] + np.arange(draws, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(cuts, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53), "right")
                    s += v[a : a + 500] @ w
                    n += w.sum(0)
                out.append((g, s.tolist(), n.tolist()))
            yield pd.DataFrame(out, columns=["grp", "s", "n"])

    each = base.mapInPandas(run, "grp string, s array<double>, n array<double>").select("grp", F.posexplode(F.arrays_zip("s", "n")).alias("draw", "x"))
    m = each.groupBy("grp", "draw").agg((F.sum("x.s") / F.nullif(F.sum("x.n"), F.lit(0.0))).alias("m"))
    ci = m.groupBy("grp").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return base.groupBy("grp").agg(F.count("*").alias("n"), F.avg("y").alias("mean")).join(ci, "grp")


def mann_whitney(rows: DataFrame, group: str, y: str) -> DataFrame:
    """U of group 1 against 0 with the tie-corrected normal z."""
    r = st.ranked(rows.select(group, y), y)
    a = r.agg(F.sum((F.col(group) == 1).cast("double")).alias("n1"), F.sum((F.col(group) == 0).cast("double")).alias("n0"), F.sum(F.when(F.col(group) == 1, F.col("rank"))).alias("s"), F.sum(F.col("ties").cast("double") ** 2 - 1).alias("tie"))
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    u = F.col("s") - n1 * (n1 + 1) / 2
    return a.select(u.alias("u"), ((u - n1 * n0 / 2) / F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("tie") / (n * (n - 1))))).alias("z"))


def dunn(rows: DataFrame, group: str, y: str) -> DataFrame:
    """Dunn's comparisons of mean ranks, all pairs, with normal p-values; adjust them with ``statistics.adjust``."""
    r = st.ranked(rows.select(F.col(group).alias("grp"), F.col(y).alias("y")), "y")
    g = r.groupBy("grp").agg(F.count("*").alias("n"), F.avg("rank").alias("m")).orderBy("grp").collect()  # groups
    tie = r.agg(F.sum(F.col("ties").cast("double") ** 2 - 1)).first()[0] or 0.0
    n = sum(x["n"] for x in g)
    var = n * (n + 1) / 12 - tie / (12 * (n - 1))
    out = [(str(a["grp"]), str(b["grp"]), float((z := (a["m"] - b["m"]) / math.sqrt(var * (1 / a["n"] + 1 / b["n"])))), 2 * (1 - dist.normal_cdf(abs(z)))) for i, a in enumerate(g) for b in g[i + 1 :]]
    return rows.sparkSession.createDataFrame(out, "a string, b string, z double, p_value double")


def residuals(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Rows with fit, residual, leverage, studentised residual and Cook's distance; the cross-products are inverted on the driver and go into native
    expressions of each row. High leverage is the isolated kind: only upper limits flag."""
    g = st.gram(rows, xs, y)
    k = len(xs) + 1
    inv = np.linalg.inv(g[:k, :k])
    b = inv @ g[:k, k]
    s2 = float((g[k, k] - b @ g[:k, k]) / (g[0, 0] - k))
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    fit = sum((float(v) * c for v, c in zip(b, x)), F.lit(0.0))
    lev = sum((float(inv[i, j]) * x[i] * x[j] for i in range(k) for j in range(k)), F.lit(0.0))
    out = rows.withColumn("fit", fit).withColumn("residual", F.col(y) - F.col("fit")).withColumn("leverage", lev)
    out = out.withColumn("studentised", F.col("residual") / F.sqrt(F.lit(s2) * (1 - F.col("leverage"))))
    return out.withColumn("cooks_d", F.col("studentised") ** 2 * F.col("leverage") / ((1 - F.col("leverage")) * k)).withColumn("isolated", F.col("leverage") > 2 * k / float(g[0, 0]))


def durbin_watson(r: DataFrame, order: str, residual: str = "residual") -> DataFrame:
    d = r.withColumn("_d", F.col(residual) - F.lag(residual).over(Window.orderBy(order)))
    return d.agg((F.sum(F.col("_d") ** 2) / F.sum(F.col(residual) ** 2)).alias("durbin_watson"))


def breusch_pagan(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Lagrange multiplier n R² of squared residuals on the predictors, and its tail."""
    r = residuals(rows, xs, y).withColumn("_e2", F.col("residual") ** 2)
    g = st.gram(r, xs, "_e2")
    k, n = len(xs) + 1, g[0, 0]
    beta = np.linalg.solve(g[:k, :k], g[:k, k])
    total = g[k, k] - g[0, k] ** 2 / n
    lm = float(n * (1 - (g[k, k] - beta @ g[:k, k]) / total))
    return rows.sparkSession.createDataFrame([(lm, dist.chi2_sf(lm, k - 1))], "lm double, p_value double")


def ks_normal(rows: DataFrame, y: str) -> DataFrame:
    """Largest distance between the empirical distribution and the normal one of the same mean and deviation, at 1,000 quantiles."""
    q = [i / 1000 for i in range(1, 1000)]
    a = rows.agg(F.avg(y).alias("m"), F.stddev_samp(y).alias("s"), F.count(y).alias("n")).first()
    v = ordered.quantiles(rows, y, q).first()
    d = max(abs(p - dist.normal_cdf((x - a["m"]) / a["s"])) for p, x in zip(q, v["q"])) if a["s"] else None
    return rows.sparkSession.createDataFrame([(d, a["n"], 1.358 / math.sqrt(a["n"]) if a["n"] else None)], "distance double, n long, critical double")


def smearing(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Duan's factor for a fit of ln y, and the half-elasticities exp(b) - 1 of its terms."""
    r = rows.where(F.col(y) > 0).withColumn("_ln", F.ln(y))
    b = st.ols(r, xs, "_ln").select("term", (F.exp("estimate") - 1).alias("half_elasticity"))
    return b.crossJoin(F.broadcast(residuals(r, xs, "_ln").agg(F.avg(F.exp("residual")).alias("smearing"))))


def matched(rows: DataFrame, treated: str, xs: list[str], y: str, key: str, caliper: float = 0.05, strata: int = 50) -> DataFrame:
    """Propensity strata: effect of treatment within equal slices of the fitted propensity, weighted by treated rows, with overlap and the standardised
    differences before and after. Slices narrower than the caliper stand for matching within it, without a pairing of rows."""
    v = VectorAssembler(inputCols=xs, outputCol="features").transform(rows)
    m = LogisticRegression(labelCol=treated, regParam=1e-6).fit(v)
    from pyspark.ml.functions import vector_to_array

    p = m.transform(v).withColumn("p", vector_to_array("probability")[1]).withColumn("slice", F.least(F.floor(F.col("p") / min(caliper, 1 / strata)), F.lit(10**6)))
    t = F.col(treated) == 1
    s = p.groupBy("slice").agg(F.sum(t.cast("long")).alias("nt"), F.sum((~t).cast("long")).alias("nc"), (F.avg(F.when(t, F.col(y))) - F.avg(F.when(~t, F.col(y)))).alias("d"), *[(F.avg(F.when(t, F.col(x))) - F.avg(F.when(~t, F.col(x)))).alias(f"d_{x}") for x in xs])
    both = s.where("nt > 0 and nc > 0")
    sd = p.agg(*[F.sqrt((F.var_samp(F.when(t, F.col(x))) + F.var_samp(F.when(~t, F.col(x)))) / 2).alias(f"s_{x}") for x in xs], *[(F.avg(F.when(t, F.col(x))) - F.avg(F.when(~t, F.col(x)))).alias(f"b_{x}") for x in xs], F.sum(t.cast("long")).alias("all_t"))
    w = lambda c: F.sum(F.col("nt") * F.col(c)) / F.sum("nt")
    e = both.agg(w("d").alias("effect"), F.sum("nt").alias("used"), *[w(f"d_{x}").alias(f"a_{x}") for x in xs]).crossJoin(sd)
    return e.select("effect", (F.col("used") / F.col("all_t")).alias("overlap"), F.greatest(*[F.abs(F.col(f"b_{x}") / F.col(f"s_{x}")) for x in [*xs, xs[0]]]).alias("smd_before"), F.greatest(*[F.abs(F.col(f"a_{x}") / F.col(f"s_{x}")) for x in [*xs, xs[0]]]).alias("smd_after"))


def prepared(rows: DataFrame, xs: list[str], key: str, skewed: float = 1.0) -> DataFrame:
    """Cluster input: log1p of skewed non-negative columns, then z-scores. The order is fixed: shape first, scale last."""
    n = rows.agg(*[x for c in xs for x in (F.skewness(c).alias(f"k_{c}"), F.min(c).alias(f"m_{c}"))]).first()
    t = rows.select(key, *[(F.log1p(c) if (n[f"k_{c}"] or 0) > skewed and n[f"m_{c}"] >= 0 else F.col(c).cast("double")).alias(c) for c in xs])
    m = t.agg(*[x for c in xs for x in (F.avg(c).alias(f"a_{c}"), F.nullif(F.stddev_samp(c), F.lit(0.0)).alias(f"s_{c}"))])
    return t.crossJoin(F.broadcast(m)).select(key, *[F.coalesce((F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}"), F.lit(0.0)).alias(c) for c in xs])


def stability(points: DataFrame, xs: list[str], key: str, k: int, rounds: int = 5, seed: int = 1) -> DataFrame:
    """Adjusted Rand index between clusterings of the whole and of hashed 80 % samples, with the three bands 0.75 and 0.60."""
    v = VectorAssembler(inputCols=xs, outputCol="features").transform(points).select(key, "features")
    whole = KMeans(k=k, seed=seed, predictionCol="a").fit(v).transform(v).select(key, "features", "a").persist()
    out = None
    for i in range(rounds):
        part = whole.where(F.pmod(F.xxhash64(F.lit(i), key), F.lit(10)) < 8)
        m = KMeans(k=k, seed=seed + i, predictionCol="b").fit(part)
        one = st.adjusted_rand(m.transform(whole), "a", "b").withColumn("round", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.avg("ari").alias("ari")).withColumn("band", F.when(F.col("ari") >= 0.75, "stable").when(F.col("ari") >= 0.6, "doubtful").otherwise("unstable"))


def folds(rows: DataFrame, day: str, first: str, step_days: int, count: int, gap_days: int) -> DataFrame:
    """Rolling-origin folds: each row once a fold as train (up to the origin less the gap) or test (the step after the origin)."""
    f = rows.sparkSession.range(count).select(F.col("id").alias("fold"), F.date_add(F.lit(first).cast("date"), (F.col("id") * step_days).cast("int")).alias("origin"))
    part = F.when(F.col(day) <= F.date_sub("origin", gap_days), "train").when((F.col(day) > F.col("origin")) & (F.col(day) <= F.date_add("origin", step_days)), "test")
    return rows.crossJoin(F.broadcast(f)).withColumn("part", part).where("part is not null")


def permutation_importance(rows: DataFrame, xs: list[str], y: str, key: str) -> DataFrame:
    """Loss of AUC of a logistic model when a column is put out of order: each row gets the value of another, by two hash orders of one key. Rows are
    written once, and once more beside the values that they get, whatever the number of columns."""
    rows = materialise(rows.select(key, y, *xs), "importance-rows")
    v = VectorAssembler(inputCols=xs, outputCol="features")
    m = LogisticRegression(labelCol=y, regParam=0.001).fit(v.transform(rows))
    from pyspark.ml.functions import vector_to_array

    def auc(d: DataFrame) -> float:
        s = m.transform(v.transform(d)).select(vector_to_array("probability")[1].alias("p"), y)
        return float(st.auc(s, "p", y).first()["auc"] or 0.5)

    base, out = auc(rows), []
    a = ordered.positions(rows, [F.xxhash64(F.lit(1), key), key], "_i").drop(key)
    b = ordered.positions(rows.drop(y), [F.xxhash64(F.lit(2), key), key], "_i").select("_i", *[F.col(c).alias(f"_{c}") for c in xs])
    both = materialise(a.join(b, "_i").drop("_i"), "importance-pairs")
    for c in xs:
        out.append((c, base, base - auc(both.drop(c).withColumnRenamed(f"_{c}", c))))
    for t in (rows, both):
        discard(t)
    return rows.sparkSession.createDataFrame(out, "term string, auc double, loss double")


def principal_components(rows: DataFrame, xs: list[str]) -> DataFrame:
    """Loadings and shares of variance from the correlation matrix, with the Kaiser-Meyer-Olkin measure."""
    g = st.gram(rows, xs, xs[0])[: len(xs) + 1, : len(xs) + 1]
    n = g[0, 0]
    cov = g[1:, 1:] / n - np.outer(g[0, 1:], g[0, 1:]) / n**2
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd)
    value, vec = np.linalg.eigh(r)
    inv = np.linalg.inv(r)
    part = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(len(xs), dtype=bool)
    kmo = float((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (part[off] ** 2).sum()))
    out = [(c + 1, x, float(vec[i, -1 - c] * math.sqrt(max(value[-1 - c], 0)) * np.sign(vec[np.argmax(abs(vec[:, -1 - c])), -1 - c])), float(value[-1 - c] / len(xs)), kmo) for c in range(len(xs)) for i, x in enumerate(xs)]
    return rows.sparkSession.createDataFrame(out, "component int, term string, loading double, share double, kmo double")


def beta_ab(rows: DataFrame, arm: str, y: str, draws: int = 20_000, seed: int = 1) -> DataFrame:
    """Probability that arm 1 has the higher rate, from Beta posteriors of four counts."""
    a = rows.agg(*[x for i in (0, 1) for x in (F.sum(F.when(F.col(arm) == i, F.col(y))).alias(f"x{i}"), F.sum((F.col(arm) == i).cast("long")).alias(f"n{i}"))]).first()
    rng = np.random.default_rng(seed)
    p = [rng.beta(1 + (a[f"x{i}"] or 0), 1 + (a[f"n{i}"] or 0) - (a[f"x{i}"] or 0), draws) for i in (0, 1)]
    return rows.sparkSession.createDataFrame([(float((p[1] > p[0]).mean()), float((p[1] - p[0]).mean()))], "p_better double, difference double")


def mapped_channels(rows: DataFrame, mapping: DataFrame, cols: tuple[str, str, str] = ("source", "medium", "campaign")) -> DataFrame:
    """Channel group by patterns (``*`` stands for anything), the pattern with most letters first; null where none fits. ``rows`` need a unique ``key``."""
    m = F.broadcast(mapping.withColumn("_w", sum((F.length(F.regexp_replace(f"p_{c}", r"\*", "")) for c in cols), F.lit(0))))
    like = lambda c: F.like(F.lower(F.trim(F.col(c))), F.replace(F.lower(f"p_{c}"), F.lit("*"), F.lit("%")))
    j = rows.join(m, like(cols[0]) & like(cols[1]) & like(cols[2]), "left")
    return j.groupBy("key").agg(F.max_by("channel_group", F.struct("_w", "channel_group")).alias("channel_group"))


def code_changes(stores: DataFrame, days: int = 31) -> DataFrame:
    """Stores that end where another begins at the same address within ``days``."""
    a = stores.where("close_date is not null").select(F.col("store").alias("old"), "address", "close_date")
    b = stores.select(F.col("store").alias("new"), "address", "open_date")
    return a.join(b, "address").where((F.col("old") != F.col("new")) & F.datediff("open_date", "close_date").between(0, days)).select("old", "new", "address")


def reissued(cards: DataFrame) -> DataFrame:
    """Cards of one customer with equal opening date, limit and tier: one card in several numbers."""
    return cards.groupBy("customer", "open_date", "card_limit", "tier").agg(F.sort_array(F.collect_list("card")).alias("cards")).where(F.size("cards") > 1)


def flagged_bots(e: DataFrame, agents: str = r"(?i)bot|crawl|spider|headless", networks: tuple = (), most: float = 0.999) -> DataFrame:
    """Events with ``is_bot`` and the reasons: user agent, network, more events a day than nearly all, or a lone view of no length. Nothing is dropped."""
    n = F.count("*").over(Window.partitionBy("user_id", F.col("ts").cast("date")))
    x = e.withColumn("_n", n)
    top = x.groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.max("_n").alias("c")).agg(F.percentile("c", most).alias("_top"))
    reasons = F.array_compact(F.array(F.when(F.col("user_agent").rlike(agents), "agent"), F.when(F.col("ip").isin(*networks), "network") if networks else F.lit(None).cast("string"), F.when(F.col("_n") > F.col("_top"), "volume"), F.when((F.col("_n") == 1) & (F.col("seconds") == 0), "empty")))
    return x.crossJoin(F.broadcast(top)).withColumn("reasons", reasons).withColumn("is_bot", F.size("reasons") > 0).drop("_n", "_top")


def double_ml(rows: DataFrame, treatment: str, y: str, xs: list[str], key: str, placebo: bool = False) -> DataFrame:
    """Effect of a treatment in a partially linear model: outcome and treatment are predicted from ``xs`` on the other half of the rows, and the residuals
    are set against each other. ``placebo`` puts the treatment out of order by a hash; the effect should then be near 0."""
    half = F.pmod(F.xxhash64(F.lit(7), key), F.lit(2)).alias("_half")
    if placebo:  # rows of one key are told apart by their values, so that the order is total; the pairs are written, as they are read three times
        a = ordered.positions(rows.select(key, y, *xs), [F.xxhash64(F.lit(3), key), key, y, *xs], "_i").select("_i", half, y, *xs)
        b = ordered.positions(rows.select(key, treatment), [F.xxhash64(F.lit(4), key), key, treatment], "_i").select("_i", treatment)
        rows = materialise(a.join(b, "_i").drop("_i"), "placebo")
    else:
        rows = rows.select(half, y, treatment, *xs)
    g = st.grams(rows, xs, [y, treatment], "_half")
    k = len(xs) + 1
    none = np.zeros((k + 1, k + 1))

    def residual(target: str, h: int):
        m = g.get((1 - h, target), none)
        b = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
        return F.col(target) - sum((float(v) * F.col(c) for v, c in zip(b[1:], xs)), F.lit(float(b[0])))

    parts = rows.select(*[F.when(F.col("_half") == 0, residual(c, 0)).otherwise(residual(c, 1)).alias(n) for c, n in ((y, "ry"), (treatment, "rt"))])
    t = parts.agg((F.sum(F.col("ry") * F.col("rt")) / F.sum(F.col("rt") ** 2)).alias("effect"))
    e = (F.col("ry") - F.col("effect") * F.col("rt")) * F.col("rt")
    return parts.crossJoin(F.broadcast(t)).groupBy("effect").agg((F.sqrt(F.sum(e * e)) / F.sum(F.col("rt") ** 2)).alias("se"))


def concordance(rows: DataFrame, time: str, event: str, risk: str, slices: int = 200) -> DataFrame:
    """Harrell's C for right-censored times: of pairs whose order is known, the share where the earlier event had the higher risk. Times and risks are
    first put in equal slices, so the pairs are of slices and not of rows; ties count a half."""
    r = ordered.tiles(rows.withColumn("_k", F.monotonically_increasing_id()), [risk, "_k"], slices, "_r")
    c = r.groupBy(F.col(time).alias("t"), "_r").agg(F.sum(F.col(event).cast("double")).alias("d"), F.count("*").cast("double").alias("n"))
    a, b = c.select(F.col("t").alias("ta"), F.col("_r").alias("ra"), "d").where("d > 0"), c.select(F.col("t").alias("tb"), F.col("_r").alias("rb"), "n")
    j = a.join(b, F.col("tb") > F.col("ta"))
    w = F.col("d") * F.col("n")
    return j.agg((F.sum(w * F.when(F.col("ra") > F.col("rb"), 1.0).when(F.col("ra") == F.col("rb"), 0.5).otherwise(0.0)) / F.sum(w)).alias("c_index"))
