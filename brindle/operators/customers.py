"""Customer features as of a date. Every function takes purchases (customer, day, amount, txn) and uses none after ``as_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import ratio
from brindle.operators import ordered


def until(p: DataFrame, as_of: str) -> DataFrame:
    return p.where(F.col("day") <= F.lit(as_of).cast("date"))


def rfm(p: DataFrame, as_of: str) -> DataFrame:
    """Recency in days, frequency at transaction and day grain, money."""
    return until(p, as_of).groupBy("customer").agg(F.datediff(F.lit(as_of).cast("date"), F.max("day")).cast("long").alias("r_days"), F.countDistinct("txn").alias("f_txn"), F.countDistinct("day").alias("f_days"), F.sum("amount").alias("m_gross"))


def scores(features: DataFrame, tiles: int = 5) -> DataFrame:
    """Quantile scores with the key as tie-break; recency is turned round, so that the top score is the best."""
    out = features.select("customer")
    for c, name in (("r_days", "r_score"), ("f_txn", "f_score"), ("m_gross", "m_score")):
        out = out.join(ordered.tiles(features.select("customer", c), [c, "customer"], tiles, name).select("customer", name), "customer")
    return out.select("customer", (F.lit(tiles + 1) - F.col("r_score")).alias("r_score"), "f_score", "m_score")


def stone_scores(features: DataFrame, c: float = 0.0025, cap: int = 10, tiers: tuple = ((90, 20), (180, 10), (270, 5), (365, 3))) -> DataFrame:
    """Weighted scores: points by recency tier (ours beyond the first tier), 4 a transaction, the floor of c x money up to ``cap``."""
    r = F.lit(1)
    for days, points in reversed(tiers):
        r = F.when(F.col("r_days") <= days, points).otherwise(r)
    f = F.col("f_txn") * 4
    m = F.least(F.floor(F.col("m_gross") * c), F.lit(cap))
    return features.select("customer", r.cast("long").alias("r_points"), f.cast("long").alias("f_points"), m.cast("long").alias("m_points"), (r + f + m).cast("long").alias("stone_score"))


def customer_days(p: DataFrame, as_of: str) -> DataFrame:
    return until(p, as_of).select("customer", "day").distinct()


def intervals(p: DataFrame, as_of: str) -> DataFrame:
    """Gaps between a customer's purchase days, numbered from the oldest; the open gap after the last day is left out."""
    w = Window.partitionBy("customer").orderBy("day")
    d = customer_days(p, as_of).withColumn("gap", F.datediff(F.lead("day").over(w), "day")).withColumn("j", F.row_number().over(w))
    return d.where("gap is not null")


def activity_index(p: DataFrame, as_of: str) -> DataFrame:
    """Mean gap (MLE), gap weighted by order (WMLE), their index CAI = (MLE - WMLE) / MLE x 100 (below 0: slowing down), open gap
    and its ratio to the mean, with the flag of likely churn beyond three means. Null without a gap; 0 with one."""
    g = intervals(p, as_of).groupBy("customer").agg(F.count("*").alias("n_intervals"), F.avg("gap").alias("mle"), (F.sum(F.col("gap") * F.col("j")) / F.sum("j")).alias("wmle"))
    last = until(p, as_of).groupBy("customer").agg(F.datediff(F.lit(as_of).cast("date"), F.max("day")).cast("long").alias("open_days"))
    out = last.join(g, "customer", "left")
    cai = (F.col("mle") - F.col("wmle")) / F.nullif("mle", F.lit(0.0)) * 100
    return out.select("customer", F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"), "mle", "wmle", cai.alias("cai"), "open_days", ratio("open_days", "mle").alias("churn_ratio"), F.coalesce(F.col("open_days") > 3 * F.col("mle"), F.lit(False)).alias("likely_churned"))


def shrunk_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Empirical-Bayes means on the log scale, variances by the method of moments: theta = w x mean + (1 - w) x grand mean, with
    w = n tau2 / (n tau2 + s2)."""
    x = rows.where(F.col(value) > 0).select(F.col(group).alias("grp"), F.ln(value).alias("x"))
    g = x.groupBy("grp").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    t = g.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu"), (F.sum((F.col("n") - 1) * F.col("v")) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))).alias("s2"), F.var_samp("mean").alias("between"), F.avg(1 / F.col("n")).alias("inv"))
    t = t.select("mu", "s2", F.greatest(F.col("between") - F.col("s2") * F.col("inv"), F.lit(0.0)).alias("tau2"))
    w = F.col("n") * F.col("tau2") / F.nullif(F.col("n") * F.col("tau2") + F.col("s2"), F.lit(0.0))
    return g.crossJoin(F.broadcast(t)).select("grp", "n", "mean", F.coalesce(w, F.lit(0.0)).alias("weight"), "mu", "s2", "tau2").withColumn("theta", F.col("weight") * F.col("mean") + (1 - F.col("weight")) * F.col("mu"))


def recency_index(shrunk: DataFrame) -> DataFrame:
    """CRI both ways: (IE - BE) / (IE - GE) x 100 from the individual, Bayes and group estimates, and (1 - w) x 100."""
    two = (F.col("mean") - F.col("theta")) / F.when(F.abs(F.col("mean") - F.col("mu")) > 1e-9, F.col("mean") - F.col("mu")) * 100
    return shrunk.select("grp", two.alias("cri"), ((1 - F.col("weight")) * 100).alias("cri_weight"))


def migration(states: DataFrame, all_states: list[str]) -> DataFrame:
    """Row-normalised transitions of (customer, period, state) from each period to the next over the full grid of states; a state
    that nobody leaves has null shares."""
    spark = states.sparkSession
    nxt = states.select("customer", (F.col("period") - 1).alias("period"), F.col("state").alias("to_state"))
    n = states.join(nxt, ["customer", "period"]).groupBy(F.col("state").alias("from_state"), "to_state").count()
    s = spark.createDataFrame([(x,) for x in all_states], "s string")
    grid = s.select(F.col("s").alias("from_state")).crossJoin(s.select(F.col("s").alias("to_state")))
    full = grid.join(n, ["from_state", "to_state"], "left").select("from_state", "to_state", F.coalesce("count", F.lit(0)).alias("n"))
    return full.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("from_state"))))


def cohorts(p: DataFrame) -> DataFrame:
    """Customers of each cohort (year of first purchase) active in each later year, with retention."""
    first = p.groupBy("customer").agg(F.min(F.year("day")).alias("cohort"))
    active = p.select("customer", F.year("day").alias("y")).distinct().join(first, "customer")
    n = active.groupBy("cohort", (F.col("y") - F.col("cohort")).alias("age")).agg(F.count("*").alias("customers"))
    size = F.max(F.when(F.col("age") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return n.select(F.col("cohort").cast("long").alias("cohort"), F.col("age").cast("long").alias("age"), "customers", ratio(F.col("customers"), size).alias("retention"))
