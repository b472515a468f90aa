"""Change decomposition, baskets, transitions, touches, sizing. Inputs are plain tables named in the docstrings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import ratio


def change_by_slice(rows: DataFrame, slice_: str, amount: str, in_a, in_b) -> DataFrame:
    """For each slice the value in periods a and b, the change, its share of the total's base (percentage points) and growth."""
    g = rows.groupBy(F.col(slice_).alias("slice")).agg(F.sum(F.when(in_a, F.col(amount)).otherwise(0.0)).alias("a"), F.sum(F.when(in_b, F.col(amount)).otherwise(0.0)).alias("b"))
    total = F.sum("a").over(Window.partitionBy())
    return g.select("slice", "a", "b", (F.col("b") - F.col("a")).alias("delta"), (ratio(F.col("b") - F.col("a"), total) * 100).alias("points"), ratio(F.col("b") - F.col("a"), F.col("a")).alias("growth"))


def growth_buckets(p: DataFrame, a, b) -> DataFrame:
    """Customers by whether they bought in periods a and b (retained, lost, gained), with the change of money split into effects of
    frequency, ticket and both together; the three sum to the change."""
    g = p.groupBy("customer").agg(*[x for k, c in (("a", a), ("b", b)) for x in (F.sum(F.when(c, F.col("amount")).otherwise(0.0)).alias(f"m_{k}"), F.sum(F.when(c, 1).otherwise(0)).alias(f"n_{k}"))])
    bucket = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), "retained").when(F.col("n_a") > 0, "lost").when(F.col("n_b") > 0, "gained")
    s = g.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("customers"), *[F.sum(c).alias(c) for c in ("m_a", "m_b", "n_a", "n_b")])
    t_a, t_b = F.coalesce(ratio("m_a", "n_a"), F.lit(0.0)), F.coalesce(ratio("m_b", "n_b"), F.lit(0.0))
    dn, dt = F.col("n_b") - F.col("n_a"), t_b - t_a
    return s.select("bucket", "customers", (F.col("m_b") - F.col("m_a")).alias("delta"), (dn * t_a).alias("by_frequency"), (F.col("n_a") * dt).alias("by_ticket"), (dn * dt).alias("by_both"))


def pair_rules(baskets: DataFrame, basket: str, item: str, least: int) -> DataFrame:
    """Pairs of items in one basket: support, confidence, lift, leverage, conviction and Zhang's metric of a -> b for a < b."""
    x = baskets.select(F.col(basket).alias("k"), F.col(item).alias("i")).distinct()
    n = x.agg(F.countDistinct("k").alias("n"))
    one = x.groupBy("i").agg(F.count("*").alias("c"))
    pair = x.withColumnRenamed("i", "a").join(x.withColumnRenamed("i", "b"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    j = pair.join(one.toDF("a", "ca"), "a").join(one.toDF("b", "cb"), "b").crossJoin(F.broadcast(n))
    s, pa, pb = (F.col(c) / F.col("n") for c in ("both", "ca", "cb"))
    conf = F.col("both") / F.col("ca")
    lev = s - pa * pb
    return j.select("a", "b", "both", s.alias("support"), conf.alias("confidence"), (conf / pb).alias("lift"), lev.alias("leverage"), ratio(1 - pb, F.when(conf < 1, 1 - conf)).alias("conviction"), ratio(lev, F.greatest(s * (1 - pa), pa * (pb - s))).alias("zhang"))


def transitions(rows: DataFrame, who: str, day: str, state: str) -> DataFrame:
    """Share of all moves between states of one who on consecutive (day, state) steps, ties by state."""
    w = Window.partitionBy(who).orderBy(day, state)
    s = rows.select(who, day, state).distinct().withColumn("_to", F.lead(state).over(w)).where("_to is not null")
    n = s.groupBy(F.col(state).alias("from_state"), F.col("_to").alias("to_state")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def touch_credit(touches: DataFrame) -> DataFrame:
    """Credit of channels for conversions from (journey, ts, channel, value): all to the first, to the last, and shared evenly."""
    w = Window.partitionBy("journey")
    o = w.orderBy("ts", "channel")
    t = touches.withColumn("_i", F.row_number().over(o)).withColumn("_n", F.count("*").over(w))
    return t.groupBy("channel").agg(F.sum(F.when(F.col("_i") == 1, F.col("value")).otherwise(0.0)).alias("first_touch"), F.sum(F.when(F.col("_i") == F.col("_n"), F.col("value")).otherwise(0.0)).alias("last_touch"), F.sum(F.col("value") / F.col("_n")).alias("linear"))


def removal_effect(paths: DataFrame) -> DataFrame:
    """Order-1 Markov attribution of (journey, ts, channel, converted): counts of moves in Spark, absorption probabilities with and without
    each channel solved on the driver (a matrix of channels)."""
    w = Window.partitionBy("journey").orderBy("ts", "channel")
    s = paths.withColumn("nxt", F.lead("channel").over(w)).withColumn("i", F.row_number().over(w))
    end = F.when(F.col("converted"), "(yes)").otherwise("(no)")
    moves = s.select(F.col("channel").alias("f"), F.coalesce("nxt", end).alias("t")).unionByName(s.where("i = 1").select(F.lit("(start)").alias("f"), F.col("channel").alias("t"))).groupBy("f", "t").count()
    got = moves.collect()  # channels x channels
    names = sorted({r["f"] for r in got})
    place = {c: i for i, c in enumerate(names)}
    q, yes = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in got:
        if r["t"] == "(yes)":
            yes[place[r["f"]]] += r["count"]
        elif r["t"] in place:
            q[place[r["f"]], place[r["t"]]] += r["count"]
    total = np.zeros(len(names))
    for r in got:
        total[place[r["f"]]] += r["count"]
    q, yes = q / total[:, None], yes / total

    def reach(without: int | None = None) -> float:
        a, b = q.copy(), yes.copy()
        if without is not None:
            a[:, without] = a[without] = 0
            b[without] = 0
        return float(np.linalg.solve(np.eye(len(names)) - a, b)[place["(start)"]])

    base = reach() if names else 0.0
    effect = {c: 1 - reach(place[c]) / base if base else 0.0 for c in names if c != "(start)"}
    all_ = sum(effect.values()) or 1.0
    return paths.sparkSession.createDataFrame([(c, e, e / all_) for c, e in effect.items()], "channel string, removal_effect double, share double")


def adstock(series: DataFrame, key: str, t: str, x: str, decay: float, half: float) -> DataFrame:
    """Carried-over spend a(t) = x(t) + decay a(t-1) and its saturation a / (a + half), folded in time order within each key."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).cast("double").alias("x"))))
    fold = F.aggregate("steps", F.array().cast("array<struct<t:date,x:double,a:double>>"), lambda acc, s: F.concat(acc, F.array(F.struct(s["t"].cast("date").alias("t"), s["x"].alias("x"), (s["x"] + decay * F.coalesce(F.try_element_at(acc, F.lit(-1))["a"], F.lit(0.0))).alias("a")))))
    out = series.groupBy(key).agg(steps.alias("steps")).select(key, F.explode(fold).alias("s"))
    return out.select(key, F.col("s.t").alias(t), F.col("s.x").alias(x), F.col("s.a").alias("adstock"), (F.col("s.a") / (F.col("s.a") + half)).alias("saturation"))


def sizing(plans: DataFrame) -> DataFrame:
    """Break-even response and net value of (name, n, reach, increment, margin, fixed, touch, rate_low, rate_mid, rate_high)."""
    gain = F.col("n") * F.col("reach") * F.col("increment") * F.col("margin")
    cost = F.col("fixed") + F.col("n") * F.col("reach") * F.col("touch")
    return plans.select("name", ratio(cost, gain).alias("break_even"), *[(gain * F.col(f"rate_{k}") - cost).alias(f"net_{k}") for k in ("low", "mid", "high")])


def simpson(rows: DataFrame, stratum: str, arm: str, y: str) -> DataFrame:
    """Whether the overall difference of y between arms 1 and 0 keeps its sign within strata: none, some or all of them opposite."""
    diff = F.avg(F.when(F.col(arm) == 1, F.col(y))) - F.avg(F.when(F.col(arm) == 0, F.col(y)))
    overall = rows.agg(diff.alias("overall"))
    s = rows.groupBy(stratum).agg(diff.alias("d")).crossJoin(F.broadcast(overall))
    opposite = F.sum((F.signum("d") == -F.signum("overall")).cast("int"))
    return s.groupBy("overall").agg(F.count("d").alias("strata"), opposite.cast("long").alias("opposite"), F.when(opposite == 0, "consistent").when(opposite == F.count("d"), "all opposite").otherwise("some opposite").alias("verdict"))
