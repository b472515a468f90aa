"""Changes, baskets, transitions, attribution, uplift, decisions."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions.scalars import ratio
from brindle.operators import commerce, ordered
from brindle.plans.base import Book
from brindle.tables import SPLIT, load, purchases

book = Book()
_D = "CAST(o_orderdate AS DATE)"


def _year(n):
    return F.year("day") == n


@book.query("""WITH g AS (SELECT c_mktsegment AS slice, sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice ELSE 0 END) AS a, sum(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice ELSE 0 END) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT slice, round(a, 2) AS a, round(b, 2) AS b, round(b - a, 2) AS delta, round((b - a) / nullif(sum(a) OVER (), 0) * 100, 6) AS points, round((b - a) / nullif(a, 0), 6) AS growth FROM g""")
def change_decomposition(spark, d):
    x = purchases(spark, d).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey"))
    c = commerce.change_by_slice(x, "c_mktsegment", "amount", _year(1999), _year(2000))
    return c.select("slice", *[F.round(k, 2).alias(k) for k in ("a", "b", "delta")], F.round("points", 6).alias("points"), F.round("growth", 6).alias("growth"))


@book.query("""WITH g AS (SELECT o_custkey AS c, sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice ELSE 0 END) AS ma, sum(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice ELSE 0 END) AS mb, sum((year(o_orderdate) = 1999)::INT) AS na, sum((year(o_orderdate) = 2000)::INT) AS nb FROM orders GROUP BY 1),
s AS (SELECT CASE WHEN na > 0 AND nb > 0 THEN 'retained' WHEN na > 0 THEN 'lost' WHEN nb > 0 THEN 'gained' END AS bucket, count(*) AS customers, sum(ma) AS ma, sum(mb) AS mb, sum(na)::DOUBLE AS na, sum(nb)::DOUBLE AS nb FROM g WHERE na + nb > 0 GROUP BY 1), t AS (SELECT *, coalesce(ma / nullif(na, 0), 0) AS ta, coalesce(mb / nullif(nb, 0), 0) AS tb FROM s)
SELECT bucket, customers, round(mb - ma, 2) AS delta, round((nb - na) * ta, 2) AS by_frequency, round(na * (tb - ta), 2) AS by_ticket, round((nb - na) * (tb - ta), 2) AS by_both FROM t""")
def growth_buckets(spark, d):
    g = commerce.growth_buckets(purchases(spark, d), _year(1999), _year(2000))
    return g.select("bucket", "customers", *[F.round(c, 2).alias(c) for c in ("delta", "by_frequency", "by_ticket", "by_both")])


_PROMO = f"""w AS (SELECT c_mktsegment AS seg, CASE WHEN {_D} BETWEEN DATE '2000-05-01' AND DATE '2000-05-31' THEN 'during' WHEN {_D} BETWEEN DATE '2000-06-01' AND DATE '2000-06-30' THEN 'after' WHEN {_D} BETWEEN DATE '1999-05-01' AND DATE '1999-05-31' THEN 'base' WHEN {_D} BETWEEN DATE '1999-06-01' AND DATE '1999-06-30' THEN 'base_after' END AS phase, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey)"""


@book.query(f"""WITH {_PROMO}, s AS (SELECT seg, coalesce(sum(x) FILTER (phase = 'during'), 0) AS during_p, coalesce(sum(x) FILTER (phase = 'after'), 0) AS after_p, coalesce(sum(x) FILTER (phase = 'base'), 0) AS base_p, coalesce(sum(x) FILTER (phase = 'base_after'), 0) AS base_after FROM w GROUP BY seg)
SELECT seg, round(during_p - base_p, 2) AS uplift, round(after_p - base_after, 2) AS pull_forward, round(-0.1 * during_p, 4) AS discount, round(during_p - base_p + after_p - base_after - 0.1 * during_p, 4) AS net, round(after_p / nullif(base_after, 0), 6) AS dip_ratio FROM s""")
def promo_decomposition(spark, d):
    """A promotion in May 2000 against the year before: uplift, demand pulled forward from June, a 10 % discount, the net, and the dip ratio."""
    x = purchases(spark, d).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey"))
    part = lambda a, b: F.coalesce(F.sum(F.when(F.col("day").between(a, b), F.col("amount"))), F.lit(0.0))
    s = x.groupBy(F.col("c_mktsegment").alias("seg")).agg(part("2000-05-01", "2000-05-31").alias("p"), part("2000-06-01", "2000-06-30").alias("q"), part("1999-05-01", "1999-05-31").alias("b"), part("1999-06-01", "1999-06-30").alias("c"))
    p, q, b, c = (F.col(k) for k in "pqbc")
    return s.select("seg", F.round(p - b, 2).alias("uplift"), F.round(q - c, 2).alias("pull_forward"), F.round(-0.1 * p, 4).alias("discount"), F.round(p - b + q - c - 0.1 * p, 4).alias("net"), F.round(ratio(q, c), 6).alias("dip_ratio"))


@book.query(f"""WITH d AS (SELECT DISTINCT o_custkey AS c, {_D} AS day FROM orders), g AS (SELECT c, day, date_diff('day', lag(day) OVER (PARTITION BY c ORDER BY day), day) AS gap FROM d), l AS (SELECT c, avg(gap) AS m FROM g GROUP BY c),
r AS (SELECT CASE WHEN month(day) = 5 THEN 'promo' ELSE 'control' END AS arm, gap / nullif(m, 0) AS x FROM g JOIN l USING (c) WHERE gap IS NOT NULL)
SELECT round((SELECT quantile_cont(x, 0.5) FROM r WHERE arm = 'promo') / (SELECT quantile_cont(x, 0.5) FROM r WHERE arm = 'control'), 6) AS stockpile_index""")
def stockpile_index(spark, d):
    days = purchases(spark, d).select("customer", "day").distinct()
    g = days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("customer").orderBy("day"))))
    mean = g.groupBy("customer").agg(F.avg("gap").alias("m"))
    r = g.where("gap is not null").join(mean, "customer").withColumn("x", ratio("gap", "m"))
    promo = F.month("day") == 5
    q = ordered.quantiles(r.select(promo.alias("promo"), "x"), "x", [0.5], ["promo"])
    m = lambda v: F.max(F.when(F.col("promo") == v, F.col("q")[0]))
    return q.agg(F.round(m(True) / m(False), 6).alias("stockpile_index"))


@book.query("""WITH x AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT k)::DOUBLE AS n FROM x), o AS (SELECT i, count(*)::DOUBLE AS c FROM x GROUP BY i), p AS (SELECT x.i AS a, y.i AS b, count(*) AS both_n FROM x JOIN x y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 5),
j AS (SELECT a, b, both_n, both_n / n AS s, u.c / n AS pa, v.c / n AS pb, both_n / u.c AS conf FROM p JOIN o u ON u.i = a JOIN o v ON v.i = b, n)
SELECT a, b, both_n AS both, round(s, 8) AS support, round(conf, 8) AS confidence, round(conf / pb, 6) AS lift, round(s - pa * pb, 8) AS leverage, round((1 - pb) / nullif(CASE WHEN conf < 1 THEN 1 - conf END, 0), 6) AS conviction, round((s - pa * pb) / nullif(greatest(s * (1 - pa), pa * (pb - s)), 0), 6) AS zhang FROM j""")
def basket_pairs(spark, d):
    x = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = commerce.pair_rules(x, "l_orderkey", "p_brand", 5)
    return r.select("a", "b", "both", *[F.round(c, 8).alias(c) for c in ("support", "confidence", "leverage")], *[F.round(c, 6).alias(c) for c in ("lift", "conviction", "zhang")])


@book.query()
def frequent_sets(spark, d):
    """Maximal frequent sets of brands by FP-growth."""
    x = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=0.002, minConfidence=0.05).fit(x).freqItemsets.select(F.sort_array("items").alias("items"), "freq")
    # a set is maximal unless some frequent set with one more item holds it
    smaller = sets.select(F.explode(F.transform("items", lambda i: F.array_except("items", F.array(i)))).alias("items")).distinct()
    return sets.join(smaller, "items", "left_anti")


@book.query("""WITH b AS (SELECT DISTINCT o_custkey AS c, p_type AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), n AS (SELECT count(DISTINCT c)::DOUBLE AS n FROM b), o AS (SELECT i, count(*)::DOUBLE AS c FROM b GROUP BY i), p AS (SELECT x.i AS a, y.i AS b, count(*)::DOUBLE AS both_n FROM b x JOIN b y ON x.c = y.c AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT a, b, round((n * both_n - u.c * v.c) / sqrt(nullif(u.c * (n - u.c) * v.c * (n - v.c), 0)), 6) AS phi FROM p JOIN o u ON u.i = a JOIN o v ON v.i = b, n""")
def category_correlation(spark, d):
    """Correlation of categories over customers (cells are bought or not), at least 5 customers in common."""
    x = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "txn").join(purchases(spark, d), "txn")
    b = x.select(F.col("customer").alias("c"), F.col("p_type").alias("i")).distinct()
    n, o = b.agg(F.countDistinct("c").cast("double").alias("n")), b.groupBy("i").agg(F.count("*").cast("double").alias("c"))
    p = b.withColumnRenamed("i", "a").join(b.withColumnRenamed("i", "b"), "c").where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("both")).where("both >= 5")
    j = p.join(o.toDF("a", "u"), "a").join(o.toDF("b", "v"), "b").crossJoin(F.broadcast(n))
    return j.select("a", "b", F.round(F.expr("(n * both - u * v) / sqrt(nullif(u * (n - u) * v * (n - v), 0))"), 6).alias("phi"))


@book.query(f"""WITH r AS (SELECT DISTINCT o_custkey AS c, {_D} AS day, p_type AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), t AS (SELECT s AS f, lead(s) OVER (PARTITION BY c ORDER BY day, s) AS t FROM r)
SELECT f AS from_state, t AS to_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM t WHERE t IS NOT NULL GROUP BY 1, 2""")
def category_transition(spark, d):
    x = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_orderkey", "txn").join(purchases(spark, d), "txn")
    return commerce.transitions(x, "customer", "day", "p_type").withColumn("share", F.round("share", 8))


_TOUCH = "t AS (SELECT user_id AS j, ts, event_type AS ch, sum(value) OVER (PARTITION BY user_id) AS v FROM events WHERE event_type IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY ts, ch) AS i, count(*) OVER (PARTITION BY j) AS n FROM t)"


@book.query(f"""WITH {_TOUCH} SELECT ch AS channel, round(sum(CASE WHEN i = 1 THEN v ELSE 0 END), 4) AS first_touch, round(sum(CASE WHEN i = n THEN v ELSE 0 END), 4) AS last_touch, round(sum(v / n), 4) AS linear FROM k GROUP BY ch""")
def first_last_linear_touch(spark, d):
    e = load(spark, d, "events").where("event_type is not null")
    v = e.groupBy("user_id").agg(F.sum("value").alias("value"))
    t = e.select("user_id", "ts", "event_type").join(v, "user_id").toDF("journey", "ts", "channel", "value")
    c = commerce.touch_credit(t)
    return c.select("channel", *[F.round(k, 4).alias(k) for k in ("first_touch", "last_touch", "linear")])


@book.query()
def markov_removal(spark, d):
    e = load(spark, d, "events")
    done = e.groupBy("user_id").agg((F.sum("value") > F.lit(0)).alias("converted"))
    return commerce.removal_effect(e.select("user_id", "ts", "event_type").join(done, "user_id").toDF("journey", "ts", "channel", "converted"))


@book.query("""WITH s AS (SELECT event_type AS ch, CAST(ts AS DATE) AS t, sum(value) AS x FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY t) AS i FROM s)
SELECT a.ch AS channel, a.t AS day, round(max(a.x), 4) AS spend, round(sum(b.x * power(0.6, a.i - b.i)), 6) AS adstock, round(sum(b.x * power(0.6, a.i - b.i)) / (sum(b.x * power(0.6, a.i - b.i)) + 5000), 6) AS saturation FROM o a JOIN o b ON a.ch = b.ch AND b.i <= a.i GROUP BY 1, 2""")
def adstock_saturation(spark, d):
    s = load(spark, d, "events").groupBy(F.col("event_type").alias("channel"), F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("spend"))
    a = commerce.adstock(s, "channel", "day", "spend", 0.6, 5000.0)
    return a.select("channel", "day", F.round("spend", 4).alias("spend"), F.round("adstock", 6).alias("adstock"), F.round("saturation", 6).alias("saturation"))


@book.query("""WITH p(name, n, reach, increment, margin, fixed, touch, lo, mid, hi) AS (VALUES ('dormant', 967.0, 1.0, 510.5, 1.0, 15000.0, 0.8, 0.05, 0.065, 0.08), ('new', 400.0, 0.9, 300.0, 0.4, 2000.0, 1.5, 0.02, 0.05, 0.1)), g AS (SELECT *, CAST(n AS DOUBLE) * reach * increment * margin AS gain, CAST(fixed AS DOUBLE) + CAST(n AS DOUBLE) * reach * touch AS cost FROM p)
SELECT name, round(cost / nullif(gain, 0), 6) AS break_even, round(gain * lo - cost, 2)::DOUBLE AS net_low, round(gain * mid - cost, 2)::DOUBLE AS net_mid, round(gain * hi - cost, 2)::DOUBLE AS net_high, row_number() OVER (ORDER BY gain * mid - cost DESC, name) AS priority FROM g""")
def breakeven_sizing(spark, d):
    p = spark.createDataFrame([("dormant", 967.0, 1.0, 510.5, 1.0, 15000.0, 0.8, 0.05, 0.065, 0.08), ("new", 400.0, 0.9, 300.0, 0.4, 2000.0, 1.5, 0.02, 0.05, 0.1)], "name string, n double, reach double, increment double, margin double, fixed double, touch double, rate_low double, rate_mid double, rate_high double")
    s = commerce.sizing(p)
    rank = F.row_number().over(Window.orderBy(F.desc("net_mid"), "name")).cast("long")
    return s.select("name", F.round("break_even", 6).alias("break_even"), *[F.round(f"net_{k}", 2).alias(f"net_{k}") for k in ("low", "mid", "high")], rank.alias("priority"))


@book.query("""WITH b AS (SELECT 967.0 AS n, 510.5 AS inc, 0.065 AS rate, 15000.0 AS fixed, 0.8 AS touch), f AS (SELECT unnest(['inc', 'rate', 'fixed']) AS assumption), k AS (SELECT unnest([0.5, 1.5]) AS factor)
SELECT assumption, factor::DOUBLE AS factor, round(n * inc * rate * CASE WHEN assumption IN ('inc', 'rate') THEN factor ELSE 1 END - fixed * CASE WHEN assumption = 'fixed' THEN factor ELSE 1 END - n * touch, 2)::DOUBLE AS net, n * inc * rate * CASE WHEN assumption IN ('inc', 'rate') THEN factor ELSE 1 END - fixed * CASE WHEN assumption = 'fixed' THEN factor ELSE 1 END - n * touch < 0 AS flips FROM b, f, k""")
def sensitivity(spark, d):
    g = spark.createDataFrame([(a, k) for a in ("inc", "rate", "fixed") for k in (0.5, 1.5)], "assumption string, factor double")
    net = F.lit(967.0 * 510.5 * 0.065) * F.when(F.col("assumption").isin("inc", "rate"), F.col("factor")).otherwise(1.0) - F.lit(15000.0) * F.when(F.col("assumption") == "fixed", F.col("factor")).otherwise(1.0) - F.lit(967.0 * 0.8)
    return g.select("assumption", "factor", F.round(net, 2).alias("net"), (net < 0).alias("flips"))


@book.query("""WITH m AS (SELECT CASE WHEN o_totalprice >= 250000 THEN 'big_ticket' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'regular' END AS list, o_custkey AS k FROM orders GROUP BY 1, 2), n AS (SELECT list, count(*) AS n FROM m GROUP BY 1)
SELECT a.list AS a, b.list AS b, count(*) AS both, round(count(*) / least(x.n, y.n), 6) AS overlap, CASE WHEN count(*) / least(x.n, y.n) > 0.3 THEN 'fail' WHEN count(*) / least(x.n, y.n) > 0.1 THEN 'warn' ELSE 'pass' END AS verdict FROM m a JOIN m b ON a.k = b.k AND a.list < b.list JOIN n x ON x.list = a.list JOIN n y ON y.list = b.list GROUP BY a.list, b.list, x.n, y.n""")
def recommendation_conflicts(spark, d):
    o = load(spark, d, "orders")
    m = o.select(F.when(F.col("o_totalprice") >= 250000, "big_ticket").when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("regular").alias("list"), F.col("o_custkey").alias("k")).distinct()
    n = m.groupBy("list").count()
    p = m.withColumnRenamed("list", "a").join(m.withColumnRenamed("list", "b"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    j = p.join(n.toDF("a", "x"), "a").join(n.toDF("b", "y"), "b").withColumn("overlap", F.col("both") / F.least("x", "y"))
    return j.select("a", "b", "both", F.round("overlap", 6).alias("overlap"), F.when(F.col("overlap") > 0.3, "fail").when(F.col("overlap") > 0.1, "warn").otherwise("pass").alias("verdict"))


@book.query("""WITH r AS (SELECT c_mktsegment AS s, (o_orderpriority LIKE '1%')::INT AS arm, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey), o AS (SELECT avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) AS overall FROM r), g AS (SELECT s, avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0) AS d FROM r GROUP BY s), k AS (SELECT overall, count(d) AS strata, sum((sign(d) = -sign(overall))::INT)::BIGINT AS opposite FROM g, o GROUP BY overall)
SELECT round(overall, 4) AS overall, strata, opposite, CASE WHEN opposite = 0 THEN 'consistent' WHEN opposite = strata THEN 'all opposite' ELSE 'some opposite' END AS verdict FROM k""")
def simpson_scan(spark, d):
    x = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.col("o_orderpriority").startswith("1").cast("int").alias("arm"), F.col("o_totalprice").alias("y"))
    return commerce.simpson(x, "c_mktsegment", "arm", "y").withColumn("overall", F.round("overall", 4))


@book.query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), z AS (SELECT day, v, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT date_trunc('week', day)::DATE AS week, sum(coalesce(abs(v - m) > s, false)::INT)::BIGINT AS alerts, sum(coalesce(abs(v - m) > s, false)::INT) > 20 AS too_many FROM z GROUP BY 1""")
def alert_backtest(spark, d):
    x = load(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.orderBy("day").rowsBetween(-7, -1)
    a = F.coalesce(F.abs(F.col("v") - F.avg("v").over(w)) > F.stddev_samp("v").over(w), F.lit(False)).cast("int")
    return x.select(F.trunc("day", "week").alias("week"), a.alias("a")).groupBy("week").agg(F.sum("a").alias("alerts"), (F.sum("a") > 20).alias("too_many"))


_UP = f"""c AS (SELECT o_custkey AS k, max((o_orderpriority LIKE '1%' AND {_D} < DATE '{SPLIT}')::INT) AS arm, count(*) FILTER ({_D} < DATE '{SPLIT}') AS past, max(({_D} >= DATE '{SPLIT}')::INT) AS y FROM orders GROUP BY 1)"""


def _uplift(spark, d):
    p = load(spark, d, "orders").withColumn("before", F.col("o_orderdate").cast("date") < SPLIT)
    return p.groupBy(F.col("o_custkey").alias("k")).agg(F.max((F.col("o_orderpriority").startswith("1") & F.col("before")).cast("int")).alias("arm"), F.count(F.when(F.col("before"), 1)).alias("past"), F.max((~F.col("before")).cast("int")).alias("y"))


@book.query(f"""WITH {_UP}, g AS (SELECT CASE WHEN past >= 10 THEN 'frequent' ELSE 'rare' END AS grp, avg(y) FILTER (arm = 1) AS t, avg(y) FILTER (arm = 0) AS c FROM c GROUP BY 1)
SELECT grp, round(t, 6) AS treated, round(c, 6) AS control, round(t - c, 6) AS uplift, CASE WHEN t - c >= 0.02 THEN 'persuadable' WHEN t - c < 0 THEN 'do not disturb' WHEN c >= 0.5 THEN 'sure thing' ELSE 'lost cause' END AS quadrant FROM g""")
def uplift_quadrants(spark, d):
    """Groups by uplift against the least that pays (cost / margin = 2 %)."""
    g = _uplift(spark, d).groupBy(F.when(F.col("past") >= 10, "frequent").otherwise("rare").alias("grp")).agg(F.avg(F.when(F.col("arm") == 1, F.col("y"))).alias("t"), F.avg(F.when(F.col("arm") == 0, F.col("y"))).alias("c"))
    u = F.col("t") - F.col("c")
    return g.select("grp", F.round("t", 6).alias("treated"), F.round("c", 6).alias("control"), F.round(u, 6).alias("uplift"), F.when(u >= 0.02, "persuadable").when(u < 0, "do not disturb").when(F.col("c") >= 0.5, "sure thing").otherwise("lost cause").alias("quadrant"))


@book.query(f"""WITH {_UP}, t AS (SELECT ntile(10) OVER (ORDER BY past DESC, k) AS decile, arm, y FROM c), s AS (SELECT decile, sum(arm)::DOUBLE AS nt, sum(1 - arm)::DOUBLE AS nc, sum(y * arm)::DOUBLE AS yt, sum(y * (1 - arm))::DOUBLE AS yc FROM t GROUP BY decile), m AS (SELECT decile, sum(nt) OVER w AS nt, sum(nc) OVER w AS nc, sum(yt) OVER w AS yt, sum(yc) OVER w AS yc FROM s WINDOW w AS (ORDER BY decile))
SELECT decile, round(yt - yc * nt / nullif(nc, 0), 6) AS qini FROM m""")
def qini_curve(spark, d):
    t = ordered.tiles(_uplift(spark, d), [F.desc("past"), "k"], 10, "decile")
    s = t.groupBy("decile").agg(F.sum("arm").alias("nt"), F.sum(1 - F.col("arm")).alias("nc"), F.sum(F.col("y") * F.col("arm")).alias("yt"), F.sum(F.col("y") * (1 - F.col("arm"))).alias("yc"))
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    cum = s.select("decile", *[F.sum(c).over(w).cast("double").alias(c) for c in ("nt", "nc", "yt", "yc")])
    return cum.select("decile", F.round(F.col("yt") - F.col("yc") * F.col("nt") / F.nullif("nc", F.lit(0.0)), 6).alias("qini"))
