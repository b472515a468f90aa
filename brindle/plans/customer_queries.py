"""Customer features: recency, frequency, money, activity, shrinkage, migration, cohorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import clv, customers, ordered
from brindle.plans.base import Book
from brindle.tables import AS_OF, lines, load, purchases

book = Book()
_P = "p AS (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount, o_orderkey AS txn FROM orders)"
_RFM = f"""{_P}, rfm AS (SELECT customer, CAST(date_diff('day', max(day), DATE '{AS_OF}') AS BIGINT) AS r_days, count(DISTINCT txn) AS f_txn, count(DISTINCT day) AS f_days, sum(amount) AS m_gross FROM p WHERE day <= DATE '{AS_OF}' GROUP BY customer)"""
_GAPS = f"""{_P}, d AS (SELECT DISTINCT customer, day FROM p WHERE day <= DATE '{AS_OF}'), g0 AS (SELECT customer, day, date_diff('day', day, lead(day) OVER w) AS gap, row_number() OVER w AS j FROM d WINDOW w AS (PARTITION BY customer ORDER BY day)), g AS (SELECT * FROM g0 WHERE gap IS NOT NULL)"""


@book.query(f"WITH {_RFM} SELECT customer, r_days, f_txn, f_days, round(m_gross, 2) AS m_gross FROM rfm")
def rfm_base(spark, d):
    return customers.rfm(purchases(spark, d), AS_OF).withColumn("m_gross", F.round("m_gross", 2))


@book.query(f"WITH {_RFM} SELECT customer, 6 - ntile(5) OVER (ORDER BY r_days, customer) AS r_score, ntile(5) OVER (ORDER BY f_txn, customer) AS f_score, ntile(5) OVER (ORDER BY m_gross, customer) AS m_score FROM rfm")
def rfm_scores(spark, d):
    return customers.scores(customers.rfm(purchases(spark, d), AS_OF))


@book.query(f"""WITH {_RFM}, s AS (SELECT customer, CASE WHEN r_days <= 90 THEN 20 WHEN r_days <= 180 THEN 10 WHEN r_days <= 270 THEN 5 WHEN r_days <= 365 THEN 3 ELSE 1 END AS r, f_txn * 4 AS f, least(CAST(floor(m_gross * 0.0025) AS BIGINT), 10) AS m FROM rfm)
SELECT customer, CAST(r AS BIGINT) AS r_points, f AS f_points, m AS m_points, r + f + m AS stone_score FROM s""")
def rfm_bob_stone(spark, d):
    return customers.stone_scores(customers.rfm(purchases(spark, d), AS_OF))


@book.query(f"""WITH {_RFM}, s AS (SELECT customer, 6 - ntile(5) OVER (ORDER BY r_days, customer) AS r, ntile(5) OVER (ORDER BY f_txn, customer) AS f, ntile(5) OVER (ORDER BY m_gross, customer) AS m FROM rfm),
l AS (SELECT CASE WHEN r >= 4 AND f >= 4 THEN 'champion' WHEN r >= 4 THEN 'recent' WHEN f >= 4 THEN 'lapsing_loyal' WHEN m >= 4 THEN 'lapsing_big' ELSE 'dormant' END AS segment FROM s)
SELECT segment, count(*) AS customers FROM l GROUP BY segment""")
def rfm_segments(spark, d):
    s = customers.scores(customers.rfm(purchases(spark, d), AS_OF))
    label = F.when((F.col("r_score") >= 4) & (F.col("f_score") >= 4), "champion").when(F.col("r_score") >= 4, "recent").when(F.col("f_score") >= 4, "lapsing_loyal").when(F.col("m_score") >= 4, "lapsing_big").otherwise("dormant")
    return s.groupBy(label.alias("segment")).agg(F.count("*").alias("customers"))


@book.query(f"""WITH {_GAPS}, a AS (SELECT customer, count(*) AS n, avg(gap) AS mle, sum(gap * j) / sum(j) AS wmle FROM g GROUP BY customer),
l AS (SELECT customer, date_diff('day', max(day), DATE '{AS_OF}') AS open_days FROM d GROUP BY customer)
SELECT l.customer, coalesce(n, 0) AS n_intervals, round(mle, 6) AS mle, round(wmle, 6) AS wmle, round((mle - wmle) / nullif(mle, 0) * 100, 6) AS cai, open_days, round(open_days / nullif(mle, 0), 6) AS churn_ratio, coalesce(open_days > 3 * mle, false) AS likely_churned
FROM l LEFT JOIN a USING (customer)""")
def cai_features(spark, d):
    x = customers.activity_index(purchases(spark, d), AS_OF)
    return x.withColumns({c: F.round(c, 6) for c in ("mle", "wmle", "cai", "churn_ratio")})


@book.query(f"""WITH {_GAPS}, m AS (SELECT avg(gap) AS mle FROM g GROUP BY customer)
SELECT (SELECT count(*) FROM p) AS n_rows, (SELECT count(*) FROM d) AS customer_days, (SELECT count(*) FROM g) AS n_intervals, round((SELECT avg(gap) FROM g), 6) AS mean_gap, round((SELECT quantile_cont(gap, 0.5) FROM g), 6) AS median_gap, round((SELECT quantile_cont(mle, 0.5) FROM m), 6) AS median_mle""")
def interval_stats(spark, d):
    p = purchases(spark, d)
    g = customers.intervals(p, AS_OF)
    per = g.groupBy("customer").agg(F.count("*").alias("n"), F.sum("gap").alias("s"), F.avg("gap").alias("mle"))
    a = p.agg(F.count("*").alias("n_rows"))
    b = customers.customer_days(p, AS_OF).agg(F.count("*").alias("customer_days"))
    c = per.agg(F.sum("n").alias("n_intervals"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_gap"))
    m = ordered.quantiles(per, "mle", [0.5]).select(F.round(F.col("q")[0], 6).alias("median_mle"))
    e = g.agg(F.round(F.percentile("gap", 0.5), 6).alias("median_gap"))
    return a.crossJoin(b).crossJoin(c).crossJoin(m).crossJoin(e)


@book.query("""SELECT o_custkey AS customer, count(*) AS f_lines, count(DISTINCT l_orderkey) AS f_txn, count(DISTINCT CAST(o_orderdate AS DATE)) AS f_days, count(DISTINCT CAST(o_orderdate AS DATE)) <= count(DISTINCT l_orderkey) AND count(DISTINCT l_orderkey) <= count(*) AS ordered
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def f_grains(spark, d):
    p = purchases(spark, d)
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn")).join(p, "txn").groupBy("customer").agg(F.count("*").alias("f_lines"), F.countDistinct("txn").alias("f_txn"), F.countDistinct("day").alias("f_days"))
    return x.withColumn("ordered", (F.col("f_days") <= F.col("f_txn")) & (F.col("f_txn") <= F.col("f_lines")))


@book.query("""SELECT l_suppkey AS store, round(sum(CASE WHEN l_returnflag <> 'R' THEN abs(l_extendedprice) ELSE 0 END), 2) AS m_gross, round(sum(CASE WHEN l_returnflag = 'R' THEN abs(l_extendedprice) ELSE 0 END), 2) AS m_return, round(sum(CASE WHEN l_returnflag = 'R' THEN -abs(l_extendedprice) ELSE abs(l_extendedprice) END), 2) AS m_net
FROM lineitem GROUP BY l_suppkey""")
def money_gross_return_net(spark, d):
    a = F.abs("amount")
    ret = F.col("kind") == "return"
    return lines(spark, d).groupBy("store").agg(F.round(F.sum(F.when(~ret, a).otherwise(0.0)), 2).alias("m_gross"), F.round(F.sum(F.when(ret, a).otherwise(0.0)), 2).alias("m_return"), F.round(F.sum(F.when(ret, -a).otherwise(a)), 2).alias("m_net"))


_HB = """x AS (SELECT o_custkey AS grp, ln(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), g AS (SELECT grp, count(*) AS n, avg(x) AS mean, coalesce(var_samp(x), 0) AS v FROM x GROUP BY grp),
t0 AS (SELECT sum(n * mean) / sum(n) AS mu, sum((n - 1) * v) / nullif(sum(n - 1), 0) AS s2, var_samp(mean) AS between_v, avg(1.0 / n) AS inv FROM g), t AS (SELECT mu, s2, greatest(between_v - s2 * inv, 0) AS tau2 FROM t0),
h AS (SELECT grp, n, mean, mu, coalesce(n * tau2 / nullif(n * tau2 + s2, 0), 0) AS w FROM g, t)"""


@book.query(f"WITH {_HB} SELECT grp AS customer, n, round(mean, 6) AS mean, round(w, 6) AS weight, round(w * mean + (1 - w) * mu, 6) AS theta FROM h")
def hb_shrinkage(spark, d):
    s = customers.shrunk_means(purchases(spark, d), "customer", "amount")
    return s.select(F.col("grp").alias("customer"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "weight", "theta")])


@book.query(f"""WITH {_HB} SELECT grp AS customer, round((1 - w) * 100, 5) AS cri, true AS two_ways_agree FROM h""")
def cri_two_ways(spark, d):
    c = customers.recency_index(customers.shrunk_means(purchases(spark, d), "customer", "amount"))
    agree = F.coalesce(F.abs(F.col("cri") - F.col("cri_weight")) <= 1e-4, F.lit(True))
    return c.select(F.col("grp").alias("customer"), F.round("cri_weight", 5).alias("cri"), agree.alias("two_ways_agree"))


_STATES = """st AS (SELECT o_custkey AS customer, year(o_orderdate) AS period, CASE WHEN sum(o_totalprice) >= 1000000 THEN 'high' WHEN sum(o_totalprice) >= 300000 THEN 'mid' ELSE 'low' END AS state FROM orders GROUP BY 1, 2)"""
_STATE_NAMES = ["low", "mid", "high", "none"]


def _states(spark, d):
    y = purchases(spark, d).groupBy("customer", F.year("day").alias("period")).agg(F.sum("amount").alias("m"))
    return y.select("customer", "period", F.when(F.col("m") >= 1_000_000, "high").when(F.col("m") >= 300_000, "mid").otherwise("low").alias("state"))


@book.query(f"""WITH {_STATES}, n AS (SELECT a.state AS f, b.state AS t, count(*) AS n FROM st a JOIN st b ON a.customer = b.customer AND b.period = a.period + 1 GROUP BY 1, 2),
s AS (SELECT unnest(['low', 'mid', 'high', 'none']) AS s), grid AS (SELECT a.s AS f, b.s AS t FROM s a, s b), full_n AS (SELECT f, t, coalesce(n, 0) AS n FROM grid LEFT JOIN n USING (f, t))
SELECT f AS from_state, t AS to_state, n, round(n / nullif(sum(n) OVER (PARTITION BY f), 0), 6) AS share FROM full_n""")
def migration_matrix(spark, d):
    return customers.migration(_states(spark, d), _STATE_NAMES).withColumn("share", F.round("share", 6))


@book.query()
def markov_clv(spark, d):
    """Lifetime value of each state, finite and infinite horizon, by the chain's matrix on the driver."""
    return clv.markov_value(customers.migration(_states(spark, d), _STATE_NAMES[:3]), {"low": 100.0, "mid": 500.0, "high": 2000.0}, 0.1, 5)


@book.query()
def clv_bgnbd(spark, d):
    """Expected purchases over the next year and spend a purchase from the frequency-recency summary."""
    return clv.predictive(customers.until(purchases(spark, d), AS_OF), AS_OF, 365)


@book.query()
def cai_permutation(spark, d):
    """Permutation p-value of each customer's activity index."""
    return clv.cai_permutation(customers.intervals(purchases(spark, d), AS_OF), 2000)


@book.query("""WITH f AS (SELECT o_custkey AS c, min(year(o_orderdate)) AS cohort FROM orders GROUP BY 1), a AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y FROM orders), n AS (SELECT cohort, y - cohort AS age, count(*) AS customers FROM a JOIN f USING (c) GROUP BY 1, 2)
SELECT cohort, age, customers, round(customers / max(CASE WHEN age = 0 THEN customers END) OVER (PARTITION BY cohort), 6) AS retention FROM n""")
def cohort_retention(spark, d):
    return customers.cohorts(purchases(spark, d)).withColumn("retention", F.round("retention", 6))


@book.query("""WITH f AS (SELECT o_custkey AS c, min(year(o_orderdate)) AS cohort FROM orders GROUP BY 1), s AS (SELECT cohort, count(*) AS n FROM f GROUP BY 1), m AS (SELECT cohort, year(o_orderdate) - cohort AS age, sum(o_totalprice) AS money FROM orders JOIN f ON c = o_custkey GROUP BY 1, 2)
SELECT cohort, age, round(sum(money) OVER (PARTITION BY cohort ORDER BY age) / n, 2) AS ltv FROM m JOIN s USING (cohort)""")
def cumulative_ltv(spark, d):
    p = purchases(spark, d)
    first = p.groupBy("customer").agg(F.min(F.year("day")).alias("cohort"))
    size = first.groupBy("cohort").agg(F.count("*").alias("n"))
    m = p.join(first, "customer").groupBy("cohort", (F.year("day") - F.col("cohort")).alias("age")).agg(F.sum("amount").alias("money"))
    w = Window.partitionBy("cohort").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    return m.join(size, "cohort").select(F.col("cohort").cast("long"), F.col("age").cast("long"), F.round(F.sum("money").over(w) / F.col("n"), 2).alias("ltv"))


@book.query("""WITH f AS (SELECT o_custkey AS c, min(CAST(o_orderdate AS DATE)) AS f FROM orders GROUP BY 1), s AS (SELECT year(f) AS cohort, count(*) * 300000.0 AS cost FROM f GROUP BY 1),
m AS (SELECT year(f) AS cohort, CAST(floor(date_diff('day', f, CAST(o_orderdate AS DATE)) / 30) AS BIGINT) AS month_no, sum(o_totalprice) * 0.3 AS margin FROM orders JOIN f ON c = o_custkey GROUP BY 1, 2),
k AS (SELECT cohort, month_no, sum(margin) OVER (PARTITION BY cohort ORDER BY month_no) AS cum FROM m) SELECT s.cohort, min(CASE WHEN cum >= cost THEN month_no END) AS payback_month FROM s LEFT JOIN k USING (cohort) GROUP BY s.cohort""")
def cac_payback(spark, d):
    """Months until a cohort's cumulated margin (30 %) covers an acquisition cost of 300,000 a customer."""
    p = purchases(spark, d)
    first = p.groupBy("customer").agg(F.min("day").alias("f"))
    cost = first.groupBy(F.year("f").alias("cohort")).agg((F.count("*") * 300000.0).alias("cost"))
    m = p.join(first, "customer").groupBy(F.year("f").alias("cohort"), F.floor(F.datediff("day", "f") / 30).alias("month_no")).agg((F.sum("amount") * 0.3).alias("margin"))
    cum = m.withColumn("cum", F.sum("margin").over(Window.partitionBy("cohort").orderBy("month_no").rowsBetween(Window.unboundedPreceding, 0)))
    return cost.join(cum, "cohort", "left").groupBy(F.col("cohort").cast("long").alias("cohort")).agg(F.min(F.when(F.col("cum") >= F.col("cost"), F.col("month_no"))).alias("payback_month"))


@book.query("""WITH c AS (SELECT customer, count(DISTINCT day) AS days FROM (SELECT o_custkey AS customer, CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY 1), a AS (SELECT count(*) AS population, sum((days IS NOT NULL)::INT) AS r, sum((coalesce(days, 0) >= 3)::INT) AS cai, sum((coalesce(days, 0) >= 6)::INT) AS cai_reliable FROM customer LEFT JOIN c ON customer = c_custkey)
SELECT m AS metric, round(n / population, 6) AS coverage, CASE WHEN n / population < 0.3 THEN 'unusable' WHEN n / population < 0.6 THEN 'partial' WHEN n / population < 0.8 THEN 'caution' ELSE 'good' END AS band FROM a, LATERAL (VALUES ('recency', r), ('cai', cai), ('cai_reliable', cai_reliable)) v(m, n)""")
def coverage_table(spark, d):
    """Share of all customers for whom a metric can be computed, with the four bands."""
    days = purchases(spark, d).groupBy("customer").agg(F.countDistinct("day").alias("days"))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("customer")).join(days, "customer", "left")
    n = F.coalesce("days", F.lit(0))
    wide = c.agg(F.avg((n >= 1).cast("double")).alias("recency"), F.avg((n >= 3).cast("double")).alias("cai"), F.avg((n >= 6).cast("double")).alias("cai_reliable"))
    long = wide.unpivot([], ["recency", "cai", "cai_reliable"], "metric", "coverage")
    band = F.when(F.col("coverage") < 0.3, "unusable").when(F.col("coverage") < 0.6, "partial").when(F.col("coverage") < 0.8, "caution").otherwise("good")
    return long.select("metric", F.round("coverage", 6).alias("coverage"), band.alias("band"))
