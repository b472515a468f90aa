"""Tests that reduce to moments: one aggregation in Spark, tail probabilities on the driver from a few numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import distributions as dist
from brindle.operators import ordered
from brindle.session import materialise


def moments(rows: DataFrame, group: str, y: str) -> DataFrame:
    return rows.where(F.col(y).isNotNull()).groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_samp(y).alias("var"))


def anova(m: DataFrame) -> DataFrame:
    """One-way analysis of variance from group moments: f, degrees of freedom, eta squared."""
    t = m.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"))
    b = m.crossJoin(F.broadcast(t)).groupBy("k", t["n"].alias("total"), "within").agg(F.sum(m["n"] * (F.col("mean") - F.col("grand")) ** 2).alias("between"))
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("total") - F.col("k")))
    return b.select(f.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("total") - F.col("k")).alias("df2"), (F.col("between") / (F.col("between") + F.col("within"))).alias("eta2"))


def welch(m: DataFrame) -> DataFrame:
    """Welch's analysis of variance from group moments."""
    w = m.withColumn("w", F.col("n") / F.col("var"))
    t = w.agg(F.count("*").alias("k"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("grand"))
    x = w.crossJoin(F.broadcast(t)).groupBy("k").agg(F.sum(F.col("w") * (F.col("mean") - F.col("grand")) ** 2).alias("a"), F.sum((1 - F.col("w") / F.col("sw")) ** 2 / (F.col("n") - 1)).alias("l"))
    k2 = F.col("k") ** 2 - 1
    return x.select((F.col("a") / (F.col("k") - 1) / (1 + 2 * (F.col("k") - 2) / k2 * F.col("l"))).alias("f"), (F.col("k") - 1).alias("df1"), (k2 / (3 * F.col("l"))).alias("df2"))


def with_f_tail(r: DataFrame) -> DataFrame:
    """Add the tail probability of the single row (f, df1, df2)."""
    x = r.first()
    return r.withColumn("p_value", F.lit(dist.f_sf(x["f"], x["df1"], x["df2"]) if x and x["f"] is not None else None).cast("double"))


def ranked(rows: DataFrame, y: str) -> DataFrame:
    """Average ranks, from running counts of distinct values."""
    c = rows.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("ties"))
    r = ordered.running_total(c, [y], "ties", "_upto").select(F.col(y).alias("_y"), "ties", (F.col("_upto") - (F.col("ties") - 1) / 2).alias("rank"))
    return rows.join(r, F.col(y) == F.col("_y")).drop("_y")


def kruskal(rows: DataFrame, group: str, y: str) -> DataFrame:
    """Kruskal-Wallis h with the correction for ties, and its degrees of freedom."""
    r = ranked(rows.select(group, y), y)
    g = r.groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("s"))
    ties = r.groupBy(y).agg(F.first("ties").alias("t")).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("tie"))
    h = g.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("s") ** 2 / F.col("n")).alias("q"), (F.count("*") - 1).alias("df")).crossJoin(ties)
    n = F.col("n")
    return h.select(((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("tie") / (n**3 - n))).alias("h"), "df")


def levene(rows: DataFrame, group: str, y: str, center: str = "median") -> DataFrame:
    """Levene's (mean) or Brown and Forsythe's (median) test: the analysis of variance of distances from the group's centre."""
    c = ordered.quantiles(rows, y, [0.5], [group]).select(group, F.col("q")[0].alias("_c")) if center == "median" else rows.groupBy(group).agg(F.avg(y).alias("_c"))
    z = rows.join(c, group).withColumn("_z", F.abs(F.col(y) - F.col("_c")))
    return anova(moments(z, group, "_z"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories: statistic, degrees of freedom, Cramér's V, and whether expected counts carry it (under 5 in at
    most 20 % of the cells, none under 1)."""
    n = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("ra")), n.groupBy("b").agg(F.sum("n").alias("rb"))
    t = n.agg(F.sum("n").alias("t"))
    cells = ra.crossJoin(rb).join(n, ["a", "b"], "left").crossJoin(F.broadcast(t)).withColumn("e", F.col("ra") * F.col("rb") / F.col("t"))
    o = F.coalesce("n", F.lit(0.0))
    k = F.least(F.countDistinct("a"), F.countDistinct("b")) - 1
    s = cells.agg(F.sum((o - F.col("e")) ** 2 / F.col("e")).alias("chi2"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("df"), F.max("t").alias("t"), k.alias("k"), F.avg((F.col("e") < 5).cast("double")).alias("low"), F.min("e").alias("least"))
    return s.select("chi2", "df", F.sqrt(F.col("chi2") / (F.col("t") * F.col("k"))).alias("cramers_v"), ((F.col("low") <= 0.2) & (F.col("least") >= 1)).alias("asymptotic"))


def odds_ratio(rows: DataFrame, exposed: str, outcome: str, design: str = "prospective") -> DataFrame:
    """Odds ratio with its 95 % interval; risks only where the design allows them."""
    c = rows.agg(*[F.sum(((F.col(exposed) == i) & (F.col(outcome) == j)).cast("double")).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    log_or = F.ln(F.col("n11") * F.col("n00") / (F.col("n10") * F.col("n01")))
    se = F.sqrt(1 / F.col("n11") + 1 / F.col("n00") + 1 / F.col("n10") + 1 / F.col("n01"))
    risk = lambda i: (F.col(f"n{i}1") / (F.col(f"n{i}1") + F.col(f"n{i}0"))) if design == "prospective" else F.lit(None).cast("double")
    return c.select(F.exp(log_or).alias("odds_ratio"), F.exp(log_or - 1.959964 * se).alias("low"), F.exp(log_or + 1.959964 * se).alias("high"), risk(1).alias("risk_exposed"), risk(0).alias("risk_other"))


def two_proportions(rows: DataFrame, arm: str, y: str) -> DataFrame:
    """z for the difference of two shares (pooled), its interval (unpooled), Wilson intervals of each, Cohen's h."""
    a = rows.agg(*[x for i in (0, 1) for x in (F.sum((F.col(arm) == i).cast("double")).alias(f"n{i}"), F.sum(F.when(F.col(arm) == i, F.col(y).cast("double"))).alias(f"x{i}"))])
    p0, p1, n0, n1 = F.col("x0") / F.col("n0"), F.col("x1") / F.col("n1"), F.col("n0"), F.col("n1")
    pool = (F.col("x0") + F.col("x1")) / (n0 + n1)
    z = 1.959964
    se = F.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)
    wilson = lambda p, n, s: (p + z * z / (2 * n) + s * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return a.select(p0.alias("p0"), p1.alias("p1"), ((p1 - p0) / F.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1))).alias("z"), (p1 - p0 - z * se).alias("low"), (p1 - p0 + z * se).alias("high"), wilson(p1, n1, -1).alias("wilson_low"), wilson(p1, n1, 1).alias("wilson_high"), (2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p0))).alias("cohens_h"))


def adjust(p: DataFrame, key: str, family: str | None = None) -> DataFrame:
    """Bonferroni, Šidák, Holm and Benjamini-Hochberg p-values within each family of (key, p_value)."""
    fam = Window.partitionBy(family) if family else Window.partitionBy()
    up = fam.orderBy("p_value", key)
    x = p.withColumn("_m", F.count("*").over(fam)).withColumn("_i", F.row_number().over(up))
    x = x.withColumn("_holm", (F.col("_m") - F.col("_i") + 1) * F.col("p_value")).withColumn("_bh", F.col("p_value") * F.col("_m") / F.col("_i"))
    one = F.lit(1.0)
    return x.select(*p.columns, F.least(one, F.col("p_value") * F.col("_m")).alias("bonferroni"), (1 - F.pow(1 - F.col("p_value"), F.col("_m"))).alias("sidak"), F.least(one, F.max("_holm").over(up.rowsBetween(Window.unboundedPreceding, 0))).alias("holm"), F.least(one, F.min("_bh").over(up.rowsBetween(0, Window.unboundedFollowing))).alias("bh"))


def cuped(rows: DataFrame, arm: str, y: str, x: str) -> DataFrame:
    """Difference of arms with the pre-period covariate's part taken out, theta pooled over arms, and the share of variance left."""
    t = rows.agg((F.covar_samp(y, x) / F.var_samp(x)).alias("theta"), F.avg(x).alias("mx"), F.corr(y, x).alias("r"))
    adj = F.col(y) - F.col("theta") * (F.col(x) - F.col("mx"))
    diff = lambda c: F.avg(F.when(F.col(arm) == 1, c)) - F.avg(F.when(F.col(arm) == 0, c))
    return rows.crossJoin(F.broadcast(t)).groupBy("theta", "r").agg(diff(F.col(y)).alias("raw"), diff(adj).alias("adjusted")).select("theta", "raw", "adjusted", (1 - F.col("r") ** 2).alias("variance_left"))


def did(rows: DataFrame, treated: str, post: str, y: str) -> DataFrame:
    """Difference in differences of cell means, with the standard error of independent cells."""
    cell = lambda i, j, f: f(F.when((F.col(treated) == i) & (F.col(post) == j), F.col(y)))
    a = rows.agg(*[x for i in (0, 1) for j in (0, 1) for x in (cell(i, j, F.avg).alias(f"m{i}{j}"), (cell(i, j, F.var_samp) / cell(i, j, F.count)).alias(f"v{i}{j}"))])
    return a.select((F.col("m11") - F.col("m10") - F.col("m01") + F.col("m00")).alias("effect"), F.sqrt(F.col("v11") + F.col("v10") + F.col("v01") + F.col("v00")).alias("se"))


def ratio_metric(rows: DataFrame, num: str, den: str) -> DataFrame:
    """A ratio of sums with its delta-method standard error."""
    a = rows.agg(F.count("*").alias("n"), F.avg(num).alias("x"), F.avg(den).alias("y"), F.var_samp(num).alias("vx"), F.var_samp(den).alias("vy"), F.covar_samp(num, den).alias("c"))
    r = F.col("x") / F.col("y")
    return a.select(r.alias("ratio"), F.sqrt((F.col("vx") - 2 * r * F.col("c") + r * r * F.col("vy")) / (F.col("n") * F.col("y") ** 2)).alias("se"))


def mde_mean(n1: float, n2: float, sd: float, alpha: float = 0.05, power: float = 0.8) -> float:
    return (dist.normal_ppf(1 - alpha / 2) + dist.normal_ppf(power)) * sd * math.sqrt(1 / n1 + 1 / n2)


def sample_size(p1: float, p2: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Per arm, for two shares with their own variances."""
    z = dist.normal_ppf(1 - alpha / 2) + dist.normal_ppf(power)
    return math.ceil(z * z * (p1 * (1 - p1) + p2 * (1 - p2)) / (p1 - p2) ** 2)


def mde_t(n1: int, n2: int, sd: float, alpha: float = 0.05, power: float = 0.8) -> float:
    """For few units: t quantiles in place of normal ones."""
    df = n1 + n2 - 2
    return (dist.t_ppf(1 - alpha / 2, df) + dist.t_ppf(power, df)) * sd * math.sqrt(1 / n1 + 1 / n2)


def design_effect(m: DataFrame) -> DataFrame:
    """Intraclass correlation by moments from group moments, design effect and effective sample size."""
    t = m.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g"), (F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))) / (F.sum("n") - F.count("*"))).alias("msw"), ((F.sum("n") - F.sum(F.col("n") ** 2) / F.sum("n")) / (F.count("*") - 1)).alias("n0"))
    b = m.crossJoin(F.broadcast(t)).groupBy("k", t["n"].alias("total"), "msw", "n0").agg((F.sum(m["n"] * (F.col("mean") - F.col("g")) ** 2) / (F.col("k") - 1)).alias("msb"))
    icc = F.greatest((F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("n0") - 1) * F.col("msw")), F.lit(0.0))
    deff = 1 + (F.col("total") / F.col("k") - 1) * icc
    return b.select(icc.alias("icc"), deff.alias("deff"), (F.col("total") / deff).alias("n_eff"))


def grams(rows: DataFrame, xs: list[str], ys: list[str], by: str) -> dict:
    """The cross-product matrix of (1, xs, y) for each group and y, all in one aggregation whatever the number of rows."""
    size = len(xs) + 2
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = []
    for k, y in enumerate(ys):
        cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
        keep = F.expr(" and ".join(f"`{c}` is not null" for c in [*xs, y]))
        sums += [F.sum(F.when(keep, cols[i] * cols[j])).alias(f"s{k}_{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy(by).agg(*sums).collect():  # groups
        for k, y in enumerate(ys):
            g = out[r[by], y] = np.zeros((size, size))
            for i, j in pairs:
                g[i, j] = g[j, i] = r[f"s{k}_{i}_{j}"] or 0.0
    return out


def gram(rows: DataFrame, xs: list[str], y: str) -> np.ndarray:
    """The cross-product matrix of (1, xs, y), one aggregation whatever the number of rows."""
    return grams(rows.withColumn("_all", F.lit(0)), xs, [y], "_all").get((0, y), np.zeros((len(xs) + 2, len(xs) + 2)))


def ols(rows: DataFrame, xs: list[str], y: str, robust: bool = False) -> DataFrame:
    """Least squares: term, estimate, se, t, p_value. Normal equations of a few columns are solved on the driver; ``robust`` gives HC3 errors
    from a second aggregation with each row's leverage."""
    g = gram(rows, xs, y)
    n, k = g[0, 0], len(xs) + 1
    xtx, xty = g[:k, :k], g[:k, k]
    inv = np.linalg.inv(xtx)
    beta = inv @ xty
    rss = g[k, k] - beta @ xty
    cov = inv * rss / (n - k)
    if robust:
        cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
        fit = sum((float(b) * c for b, c in zip(beta, cols)), F.lit(0.0))
        lev = sum((float(inv[i, j]) * cols[i] * cols[j] for i in range(k) for j in range(k)), F.lit(0.0))
        w = F.pow((F.col(y) - fit) / (1 - lev), 2)
        r = rows.where(" and ".join(f"`{c}` is not null" for c in [*xs, y])).agg(*[F.sum(w * cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        meat = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        cov = inv @ meat @ inv
    se = np.sqrt(np.diag(cov))
    out = [(name, float(b), float(s), float(b / s), float(dist.t_two_sided(float(b / s), float(n - k)))) for name, b, s in zip(["(intercept)", *xs], beta, se)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, se double, t double, p_value double")


def nested_f(rows: DataFrame, small: list[str], large: list[str], y: str) -> DataFrame:
    """F and likelihood-ratio tests of a model within another."""
    def rss(xs: list[str]) -> tuple[float, float]:
        g = gram(rows, xs, y)
        k = len(xs) + 1
        b = np.linalg.solve(g[:k, :k], g[:k, k])
        return float(g[k, k] - b @ g[:k, k]), float(g[0, 0])

    (a, n), (b, _) = rss(small), rss(large)
    d1, d2 = len(large) - len(small), n - len(large) - 1
    f, lr = (a - b) / d1 / (b / d2), n * math.log(a / b)
    return rows.sparkSession.createDataFrame([(f, float(d1), float(d2), dist.f_sf(f, d1, d2), lr, dist.chi2_sf(lr, d1))], "f double, df1 double, df2 double, p_f double, lr double, p_lr double")


def vif(rows: DataFrame, xs: list[str]) -> DataFrame:
    """Variance inflation from the inverse of the correlation matrix."""
    g = gram(rows, xs, xs[0])[: len(xs) + 1, : len(xs) + 1]
    n = g[0, 0]
    cov = g[1:, 1:] / n - np.outer(g[0, 1:], g[0, 1:]) / n**2
    sd = np.sqrt(np.diag(cov))
    v = np.diag(np.linalg.inv(cov / np.outer(sd, sd)))
    return rows.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(xs, v)], "term string, vif double")


def tukey(m: DataFrame) -> DataFrame:
    """Tukey-Kramer comparisons of all groups, from their moments on the driver."""
    g = m.orderBy("grp").collect()  # groups
    n = sum(r["n"] for r in g)
    df = n - len(g)
    mse = sum((r["n"] - 1) * (r["var"] or 0.0) for r in g) / df
    out = []
    for i, a in enumerate(g):
        for b in g[i + 1 :]:
            d = b["mean"] - a["mean"]
            q = abs(d) / math.sqrt(mse / 2 * (1 / a["n"] + 1 / b["n"]))
            out.append((str(a["grp"]), str(b["grp"]), float(d), float(q), dist.studentised_range_sf(q, len(g), df)))
    return m.sparkSession.createDataFrame(out, "a string, b string, difference double, q double, p_value double")


def games_howell(m: DataFrame) -> DataFrame:
    """Comparisons of all groups without equal variances."""
    g = m.orderBy("grp").collect()
    out = []
    for i, a in enumerate(g):
        for b in g[i + 1 :]:
            va, vb = a["var"] / a["n"], b["var"] / b["n"]
            d, df = b["mean"] - a["mean"], (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
            q = abs(d) / math.sqrt((va + vb) / 2)
            out.append((str(a["grp"]), str(b["grp"]), float(d), float(q), float(df), dist.studentised_range_sf(q, len(g), df)))
    return m.sparkSession.createDataFrame(out, "a string, b string, difference double, q double, df double, p_value double")


def kaplan_meier(rows: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """Survival curve of each group at its event times."""
    w = Window.partitionBy("grp").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    c = rows.groupBy(F.col(group).alias("grp"), F.col(time).alias("t")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    c = c.withColumn("at_risk", F.sum("n").over(w)).where("events > 0")
    log = F.sum(F.ln(F.when(F.col("at_risk") > F.col("events"), 1 - F.col("events") / F.col("at_risk")))).over(Window.partitionBy("grp").orderBy("t"))
    dead = F.max((F.col("at_risk") == F.col("events")).cast("int")).over(Window.partitionBy("grp").orderBy("t")) == 1
    return c.select("grp", "t", "at_risk", "events", F.when(dead, 0.0).otherwise(F.exp(log)).alias("survival"))


def logrank(rows: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """Two-group log-rank statistic (group 0 and 1)."""
    c = rows.groupBy(F.col(time).alias("t")).agg(F.count("*").alias("n"), F.sum(F.col(group).cast("double")).alias("n1"), F.sum(F.col(event).cast("double")).alias("d"), F.sum((F.col(event).cast("double")) * F.col(group)).alias("d1"))
    w = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("r", F.sum("n").over(w).cast("double")).withColumn("r1", F.sum("n1").over(w)).where("d > 0")
    e = F.col("d") * F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, e * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    s = c.agg(F.sum("d1").alias("o"), F.sum(e).alias("e"), F.sum(v).alias("v"))
    return s.select(F.col("o").alias("observed"), F.col("e").alias("expected"), ((F.col("o") - F.col("e")) ** 2 / F.col("v")).alias("chi2"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks."""
    c = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("ties"), F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    r = ordered.running_total(materialise(c, "scores"), [score], "ties", "_upto")
    a = r.agg(F.sum("_p").cast("double").alias("p"), F.sum("_q").cast("double").alias("n"), F.sum((F.col("_upto") - (F.col("ties") - 1) / 2) * F.col("_p")).alias("s"))
    return a.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("n"), F.lit(0.0))).alias("auc"))


def calibration(rows: DataFrame, p: str, y: str, edges: list[float]) -> DataFrame:
    """Left-closed bins, the last closed on both sides."""
    b = F.lit(len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        b = F.when(F.col(p) < edges[i + 1], i).otherwise(b)
    inside = rows.where(F.col(p).between(edges[0], edges[-1]))
    return inside.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def gain(rows: DataFrame, score: str, label: str, key: str, tiles: int = 10) -> DataFrame:
    """Lift and cumulative gain by tile of falling score."""
    t = ordered.tiles(rows, [F.desc(score), key], tiles, "tile")
    g = t.groupBy("tile").agg(F.count("*").alias("n"), F.sum(label).cast("double").alias("hits"))
    w, c = Window.partitionBy(), Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.sum("hits").over(w) / F.sum("n").over(w)
    return g.select("tile", "n", (F.col("hits") / F.col("n") / rate).alias("lift"), (F.sum("hits").over(c) / F.sum("hits").over(w)).alias("gain"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings from their contingency table."""
    n = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda d: d.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("x"))
    s = pairs(n).toDF("ij").crossJoin(pairs(n.groupBy(a).agg(F.sum("n").alias("n"))).toDF("i")).crossJoin(pairs(n.groupBy(b).agg(F.sum("n").alias("n"))).toDF("j")).crossJoin(n.agg(F.sum("n").alias("t")))
    e = F.col("i") * F.col("j") / (F.col("t") * (F.col("t") - 1) / 2)
    return s.select(F.coalesce((F.col("ij") - e) / F.nullif((F.col("i") + F.col("j")) / 2 - e, F.lit(0.0)), F.lit(1.0)).alias("ari"))
