"""Rank tests, residuals, matching, resampling, folds and master-data checks over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import customers, diagnostics as dg
from brindle.plans.base import Book
from brindle.tables import AS_OF, load, purchases

book = Book()


def _two(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderpriority").startswith("1").cast("int").alias("g"), F.col("o_totalprice").alias("y"), F.col("o_orderkey").alias("key"))


@book.query("""WITH r AS (SELECT (o_orderpriority LIKE '1%')::INT AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY o_totalprice) AS t FROM orders), a AS (SELECT sum(g)::DOUBLE AS n1, sum(1 - g)::DOUBLE AS n0, sum(r) FILTER (g = 1) AS s, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r), u AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, n1 + n0 AS n FROM a)
SELECT round(u, 2) AS u, round((u - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * (n + 1 - tie / (n * (n - 1)))), 6) AS z FROM u""")
def mann_whitney(spark, d):
    return dg.mann_whitney(_two(spark, d), "g", "y").select(F.round("u", 2).alias("u"), F.round("z", 6).alias("z"))


@book.query()
def dunn_pairs(spark, d):
    x = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return dg.dunn(x, "c_mktsegment", "o_totalprice")


@book.query()
def bootstrap_means(spark, d):
    x = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("key", F.col("o_orderkey"))
    return dg.bootstrap(x, "c_mktsegment", "o_totalprice")


@book.query("""WITH m AS (SELECT avg(l_quantity) AS mx, var_pop(l_quantity) AS v, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)) AS s FROM lineitem),
r AS (SELECT l_extendedprice - a - b * l_quantity AS e, 1.0 / n + power(l_quantity - mx, 2) / (n * v) AS h, s, n FROM lineitem, m) SELECT count(*) AS n, sum((h > 4.0 / n)::INT)::BIGINT AS isolated, round(max(power(e / (s * sqrt(1 - h)), 2) * h / ((1 - h) * 2)), 8) AS worst_cook, round(max(h), 8) AS top_leverage FROM r""")
def influence(spark, d):
    r = dg.residuals(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return r.agg(F.count("*").alias("n"), F.sum(F.col("isolated").cast("long")).alias("isolated"), F.round(F.max("cooks_d"), 8).alias("worst_cook"), F.round(F.max("leverage"), 8).alias("top_leverage"))


@book.query()
def residual_tests(spark, d):
    """Breusch-Pagan, and Durbin-Watson over months of sales."""
    bp = dg.breusch_pagan(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").select(F.lit("breusch-pagan").alias("test"), F.col("lm").alias("value"))
    m = purchases(spark, d).groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("amount").alias("y")).withColumn("t", F.months_between("month", F.lit("1995-01-01").cast("date")))
    dw = dg.durbin_watson(dg.residuals(m, ["t"], "y"), "t").select(F.lit("durbin-watson").alias("test"), F.col("durbin_watson").alias("value"))
    return bp.unionByName(dw)


@book.query()
def normality_ks(spark, d):
    return dg.ks_normal(load(spark, d, "orders"), "o_totalprice")


@book.query()
def retransform(spark, d):
    return dg.smearing(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")


@book.query()
def propensity_strata(spark, d):
    f = customers.rfm(purchases(spark, d), AS_OF).withColumn("t", (F.pmod(F.xxhash64("customer"), F.lit(10)) + F.col("f_txn") % 5 > 6).cast("int"))
    return dg.matched(f, "t", ["r_days", "f_txn"], "m_gross", "customer")


def _points(spark, d):
    return dg.prepared(customers.rfm(purchases(spark, d), AS_OF), ["r_days", "f_txn", "m_gross"], "customer")


@book.query()
def cluster_stability(spark, d):
    return dg.stability(_points(spark, d), ["r_days", "f_txn", "m_gross"], "customer", 4)


@book.query()
def components_of_rfm(spark, d):
    return dg.principal_components(_points(spark, d), ["r_days", "f_txn", "m_gross"])


@book.query()
def importance(spark, d):
    f = customers.rfm(purchases(spark, d), "2001-02-01")
    later = purchases(spark, d).where("day > '2001-02-01'").select("customer").distinct().withColumn("y", F.lit(1))
    return dg.permutation_importance(f.join(later, "customer", "left").withColumn("y", F.coalesce("y", F.lit(0))), ["r_days", "f_txn", "m_gross"], "y", "customer")


@book.query()
def bayes_ab(spark, d):
    e = load(spark, d, "events").select((F.col("user_id") % 2).alias("g"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return dg.beta_ab(e, "g", "y")


@book.query("""WITH f AS (SELECT range AS fold, DATE '1998-01-01' + CAST(range * 180 AS INTEGER) AS origin FROM range(4)), o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT fold, CASE WHEN day <= origin - 30 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM o, f WHERE day <= origin - 30 OR (day > origin AND day <= origin + 180) GROUP BY 1, 2""")
def rolling_folds(spark, d):
    return dg.folds(purchases(spark, d), "day", "1998-01-01", 180, 4, 30).groupBy("fold", "part").agg(F.count("*").alias("n"))


@book.query("""WITH z AS (SELECT o_custkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z FROM orders) SELECT sum((abs(z) > 3)::INT)::BIGINT AS beyond_3, sum((abs(z) > 1.5)::INT)::BIGINT AS beyond_15, round(max(z), 6) AS top FROM z""")
def z_outliers(spark, d):
    o = load(spark, d, "orders").select(F.col("o_totalprice").alias("x"))
    m = o.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    z = (F.col("x") - F.col("m")) / F.col("s")
    return o.crossJoin(F.broadcast(m)).agg(F.sum((F.abs(z) > 3).cast("long")).alias("beyond_3"), F.sum((F.abs(z) > 1.5).cast("long")).alias("beyond_15"), F.round(F.max(z), 6).alias("top"))


@book.query("""WITH e AS (SELECT event_id AS key, event_type AS source, CASE WHEN user_id % 3 = 0 THEN 'cpc' ELSE 'organic' END AS medium FROM events), c AS (SELECT key, CASE WHEN source = 'click' AND medium = 'cpc' THEN 'paid_click' WHEN medium = 'cpc' THEN 'paid' WHEN source LIKE 'v%' THEN 'views' END AS channel_group FROM e) SELECT channel_group, count(*) AS n FROM c GROUP BY 1""")
def channel_patterns(spark, d):
    m = spark.createDataFrame([("click", "cpc", "*", "paid_click"), ("*", "cpc", "*", "paid"), ("v*", "*", "*", "views")], "p_source string, p_medium string, p_campaign string, channel_group string")
    e = load(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("source"), F.when(F.col("user_id") % 3 == 0, "cpc").otherwise("organic").alias("medium"), F.lit("").alias("campaign"))
    return dg.mapped_channels(e, m).groupBy("channel_group").agg(F.count("*").alias("n"))


@book.query("""WITH s AS (SELECT s_suppkey AS store, 'a' || CAST(s_suppkey // 2 AS VARCHAR) AS address, DATE '2000-01-01' + CAST(s_suppkey % 2 * 20 AS INTEGER) AS open_date, CASE WHEN s_suppkey % 2 = 0 THEN DATE '2000-01-10' END AS close_date FROM supplier) SELECT a.store AS old, b.store AS new, a.address FROM s a JOIN s b ON a.address = b.address AND a.store <> b.store WHERE date_diff('day', a.close_date, b.open_date) BETWEEN 0 AND 31""")
def store_code_changes(spark, d):
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier").select(k.alias("store"), F.concat(F.lit("a"), F.floor(k / 2).cast("string")).alias("address"), F.date_add(F.lit("2000-01-01").cast("date"), (k % 2 * 20).cast("int")).alias("open_date"), F.when(k % 2 == 0, F.lit("2000-01-10").cast("date")).alias("close_date"))
    return dg.code_changes(s)


@book.query("""SELECT customer, list(card ORDER BY card) AS cards FROM (SELECT c_custkey AS card, c_nationkey AS customer, c_mktsegment AS tier FROM customer) GROUP BY customer, tier HAVING count(*) > 1""")
def reissued_cards(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("card"), F.col("c_nationkey").cast("long").alias("customer"), F.lit("2000-01-01").alias("open_date"), F.lit(1).alias("card_limit"), F.col("c_mktsegment").alias("tier"))
    return dg.reissued(c).select(F.col("customer").cast("int").alias("customer"), "cards")


@book.query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN user_id % 11 = 0 THEN 'agent' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1""")
def bot_reasons(spark, d):
    e = load(spark, d, "events").withColumn("user_agent", F.when(F.col("user_id") % 11 == 0, "SomeBot/1").otherwise("Browser")).withColumn("ip", F.lit("x")).withColumn("seconds", F.lit(5))
    return dg.flagged_bots(e, most=1.0).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@book.query()
def double_ml_effect(spark, d):
    """Price effect of a line's discount with quantity and tax taken out, and the placebo."""
    li = load(spark, d, "lineitem").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber"))
    a = dg.double_ml(li, "l_discount", "l_extendedprice", ["l_quantity", "l_tax"], "key").withColumn("kind", F.lit("effect"))
    return a.unionByName(dg.double_ml(li, "l_discount", "l_extendedprice", ["l_quantity", "l_tax"], "key", placebo=True).withColumn("kind", F.lit("placebo")))


@book.query("""WITH a AS (SELECT o_custkey % 20 AS k, sum(o_totalprice) AS one FROM orders GROUP BY 1), b AS (SELECT o_custkey % 20 AS k, sum(o_totalprice * CASE WHEN o_custkey % 20 = 3 THEN 1.2 ELSE 1 END) AS other FROM orders WHERE o_custkey % 20 <> 5 GROUP BY 1) SELECT k, round(one, 2) AS one, round(other, 2) AS other FROM a FULL JOIN b USING (k) WHERE one IS NULL OR other IS NULL OR abs(one - other) >= 0.01 * greatest(abs(one), abs(other))""")
def totals_of_two_sources(spark, d):
    from brindle.operators import checks

    o = load(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k"), F.col("o_totalprice").alias("v"))
    other = o.where("k <> 5").withColumn("v", F.col("v") * F.when(F.col("k") == 3, 1.2).otherwise(1.0))
    return checks.totals_differ(o, other, "k", "v").select("k", F.round("one", 2).alias("one"), F.round("other", 2).alias("other"))
