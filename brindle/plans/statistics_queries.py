"""Tests, models' evaluation and clustering."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from brindle.operators import models, statistics as st
from brindle.plans.base import Book
from brindle.tables import AS_OF, SPLIT, load, purchases

book = Book()
_Y = "y AS (SELECT c_mktsegment AS g, o_totalprice AS y FROM orders JOIN customer ON o_custkey = c_custkey)"
_M = "m AS (SELECT g, count(*)::DOUBLE AS n, avg(y) AS mean, var_samp(y) AS v FROM y GROUP BY g)"


def _y(spark, d):
    return purchases(spark, d).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("g"), F.col("amount").alias("y"), "customer", "day")


def _r(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@book.query(f"""WITH {_Y}, {_M}, t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS g, sum((n - 1) * v) AS w FROM m), b AS (SELECT k, t.n AS n, w, sum(m.n * power(mean - t.g, 2)) AS b FROM m, t GROUP BY ALL)
SELECT round(b / (k - 1) / (w / (n - k)), 6) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2, round(b / (b + w), 8) AS eta2 FROM b""")
def anova_oneway(spark, d):
    return _r(st.anova(st.moments(_y(spark, d), "g", "y")), f=6, eta2=8)


@book.query(f"""WITH {_Y}, {_M}, w AS (SELECT *, n / v AS w FROM m), t AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * mean) / sum(w) AS grand FROM w), x AS (SELECT k, sum(w * power(mean - grand, 2)) AS a, sum(power(1 - w / sw, 2) / (n - 1)) AS l FROM w, t GROUP BY k)
SELECT round(a / (k - 1) / (1 + 2.0 * (k - 2) / (k * k - 1) * l), 6) AS f, k - 1 AS df1, round((k * k - 1) / (3 * l), 4) AS df2 FROM x""")
def welch_anova(spark, d):
    return _r(st.welch(st.moments(_y(spark, d), "g", "y")), f=6, df2=4)


@book.query()
def anova_tails(spark, d):
    m = st.moments(_y(spark, d), "g", "y")
    a, w = st.with_f_tail(st.anova(m)), st.with_f_tail(st.welch(m))
    return a.select(F.lit("anova").alias("test"), "f", "p_value").unionByName(w.select(F.lit("welch").alias("test"), "f", "p_value"))


@book.query(f"""WITH {_Y}, r AS (SELECT g, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY y) AS t FROM y), g AS (SELECT g, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY g), k AS (SELECT sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM r), h AS (SELECT sum(n) AS n, sum(s * s / n) AS q, count(*) - 1 AS df FROM g)
SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 5) AS h, df FROM h, k""")
def kruskal_wallis(spark, d):
    return _r(st.kruskal(_y(spark, d), "g", "y"), h=5)


@book.query(f"""WITH {_Y}, c AS (SELECT g, quantile_cont(y, 0.5) AS c FROM y GROUP BY g), z AS (SELECT y.g, abs(y - c) AS y FROM y JOIN c ON y.g = c.g), m AS (SELECT g, count(*)::DOUBLE AS n, avg(y) AS mean, var_samp(y) AS v FROM z GROUP BY g), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS g, sum((n - 1) * v) AS w FROM m), b AS (SELECT k, t.n AS n, w, sum(m.n * power(mean - t.g, 2)) AS b FROM m, t GROUP BY ALL)
SELECT round(b / (k - 1) / (w / (n - k)), 6) AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2, round(b / (b + w), 8) AS eta2 FROM b""")
def levene_median(spark, d):
    return _r(st.levene(_y(spark, d).select("g", "y"), "g", "y"), f=6, eta2=8)


@book.query()
def post_hoc_pairs(spark, d):
    """Tukey-Kramer and Games-Howell comparisons of segments."""
    m = st.moments(_y(spark, d), "g", "y")
    return st.tukey(m).withColumn("method", F.lit("tukey")).unionByName(st.games_howell(m).drop("df").withColumn("method", F.lit("games-howell")))


@book.query("""WITH n AS (SELECT lang AS a, quality AS b, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS ra FROM n GROUP BY a), rb AS (SELECT b, sum(n) AS rb FROM n GROUP BY b), t AS (SELECT sum(n) AS t FROM n), c AS (SELECT a, b, coalesce(n, 0) AS o, ra * rb / t AS e, t FROM ra CROSS JOIN rb LEFT JOIN n USING (a, b), t)
SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, round(sqrt(sum((o - e) * (o - e) / e) / (max(t) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) AS cramers_v, avg((e < 5)::INT) <= 0.2 AND min(e) >= 1 AS asymptotic FROM c""")
def chi2_cramers_v(spark, d):
    x = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return _r(st.chi_square(x, "lang", "quality"), chi2=6, cramers_v=6)


@book.query("""WITH c AS (SELECT sum((quality = 1 AND toxic = 1)::INT)::DOUBLE AS n11, sum((quality = 1 AND toxic = 0)::INT)::DOUBLE AS n10, sum((quality = 0 AND toxic = 1)::INT)::DOUBLE AS n01, sum((quality = 0 AND toxic = 0)::INT)::DOUBLE AS n00 FROM labels), l AS (SELECT *, ln(n11 * n00 / (n10 * n01)) AS lo, sqrt(1 / n11 + 1 / n10 + 1 / n01 + 1 / n00) AS se FROM c)
SELECT round(exp(lo), 6) AS odds_ratio, round(exp(lo - 1.959964 * se), 6) AS low, round(exp(lo + 1.959964 * se), 6) AS high, round(n11 / (n11 + n10), 6) AS risk_exposed, round(n01 / (n01 + n00), 6) AS risk_other FROM l""")
def odds_ratio(spark, d):
    return _r(st.odds_ratio(load(spark, d, "labels"), "quality", "toxic"), odds_ratio=6, low=6, high=6, risk_exposed=6, risk_other=6)


@book.query("""WITH a AS (SELECT count(*) FILTER (user_id % 2 = 0)::DOUBLE AS n0, count(*) FILTER (user_id % 2 = 1)::DOUBLE AS n1, count(*) FILTER (user_id % 2 = 0 AND event_type = 'purchase')::DOUBLE AS x0, count(*) FILTER (user_id % 2 = 1 AND event_type = 'purchase')::DOUBLE AS x1 FROM events), p AS (SELECT *, x0 / n0 AS p0, x1 / n1 AS p1, (x0 + x1) / (n0 + n1) AS pool, sqrt(x0 / n0 * (1 - x0 / n0) / n0 + x1 / n1 * (1 - x1 / n1) / n1) AS se, 1.959964 AS z FROM a)
SELECT round(p0, 6) AS p0, round(p1, 6) AS p1, round((p1 - p0) / sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1)), 6) AS z, round(p1 - p0 - z * se, 6) AS low, round(p1 - p0 + z * se, 6) AS high, round((p1 + z * z / (2 * n1) - z * sqrt(p1 * (1 - p1) / n1 + z * z / (4 * n1 * n1))) / (1 + z * z / n1), 6) AS wilson_low, round((p1 + z * z / (2 * n1) + z * sqrt(p1 * (1 - p1) / n1 + z * z / (4 * n1 * n1))) / (1 + z * z / n1), 6) AS wilson_high, round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p0)), 6) AS cohens_h FROM p""")
def two_prop_z(spark, d):
    e = load(spark, d, "events").select((F.col("user_id") % 2).alias("arm"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    x = st.two_proportions(e, "arm", "y")
    return _r(x, **{c: 6 for c in x.columns})


@book.query("""WITH p AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 25 + 1) / 200.0 AS p FROM nation), x AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, k) AS i FROM p)
SELECT k, round(p, 6)::DOUBLE AS p_value, round(least(1, p * m), 6)::DOUBLE AS bonferroni, round(1 - power(1 - p, m), 6) AS sidak, round(least(1, max((m - i + 1) * p) OVER (ORDER BY p, k)), 6)::DOUBLE AS holm, round(least(1, min(p * m / i) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS bh FROM x""")
def bh_adjust(spark, d):
    p = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 7 % 25 + 1) / 200.0).alias("p_value"))
    return _r(st.adjust(p, "k"), p_value=6, bonferroni=6, sidak=6, holm=6, bh=6)


_CU = f"""c AS (SELECT o_custkey AS k, o_custkey % 2 AS arm, coalesce(sum(o_totalprice) FILTER (CAST(o_orderdate AS DATE) < DATE '{SPLIT}'), 0) AS x, coalesce(sum(o_totalprice) FILTER (CAST(o_orderdate AS DATE) >= DATE '{SPLIT}'), 0) AS y FROM orders GROUP BY 1)"""


def _halves(spark, d):
    p = purchases(spark, d)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0))
    return p.groupBy("customer").agg(part(F.col("day") < SPLIT).alias("x"), part(F.col("day") >= SPLIT).alias("y")).withColumn("arm", F.col("customer") % 2)


@book.query(f"""WITH {_CU}, t AS (SELECT covar_samp(y, x) / var_samp(x) AS theta, avg(x) AS mx, corr(y, x) AS r FROM c) SELECT round(theta, 8) AS theta, round(avg(y) FILTER (arm = 1) - avg(y) FILTER (arm = 0), 4) AS raw, round(avg(y - theta * (x - mx)) FILTER (arm = 1) - avg(y - theta * (x - mx)) FILTER (arm = 0), 4) AS adjusted, round(1 - r * r, 8) AS variance_left FROM c, t GROUP BY theta, r""")
def cuped(spark, d):
    return _r(st.cuped(_halves(spark, d), "arm", "y", "x"), theta=8, raw=4, adjusted=4, variance_left=8)


@book.query("""WITH r AS (SELECT o_custkey % 2 AS t, (year(o_orderdate) >= 1999)::INT AS p, o_totalprice AS y FROM orders), a AS (SELECT t, p, avg(y) AS m, var_samp(y) / count(y) AS v FROM r GROUP BY 1, 2)
SELECT round(sum(CASE WHEN t = p THEN m ELSE -m END), 4) AS effect, round(sqrt(sum(v)), 4) AS se FROM a""")
def did_cell_means(spark, d):
    r = purchases(spark, d).select((F.col("customer") % 2).alias("t"), (F.year("day") >= 1999).cast("int").alias("p"), "amount")
    return _r(st.did(r, "t", "p", "amount"), effect=4, se=4)


@book.query("""WITH n AS (SELECT user_id % 2 AS arm, count(DISTINCT user_id)::DOUBLE AS n FROM events GROUP BY 1), t AS (SELECT sum(n) / 2 AS e FROM n) SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2 FROM n, t""")
def sample_ratio_mismatch(spark, d):
    n = load(spark, d, "events").groupBy((F.col("user_id") % 2).alias("arm")).agg(F.countDistinct("user_id").cast("double").alias("n"))
    e = n.agg((F.sum("n") / 2).alias("e"))
    return n.crossJoin(F.broadcast(e)).agg(F.round(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")), 6).alias("chi2"))


@book.query("""WITH u AS (SELECT user_id, sum(value) AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1), a AS (SELECT count(*) AS n, avg(x) AS x, avg(y) AS y, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM u)
SELECT round(x / y, 6) AS ratio, round(sqrt((vx - 2 * x / y * c + x / y * x / y * vy) / (n * y * y)), 6) AS se FROM a""")
def ratio_delta(spark, d):
    u = load(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("x"), F.count("*").cast("double").alias("y"))
    return _r(st.ratio_metric(u, "x", "y"), ratio=6, se=6)


@book.query(f"""WITH {_Y}, {_M}, t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * mean) / sum(n) AS g, sum((n - 1) * v) / (sum(n) - count(*)) AS msw, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM m), b AS (SELECT k, t.n AS n, msw, n0, sum(m.n * power(mean - t.g, 2)) / (k - 1) AS msb FROM m, t GROUP BY k, t.n, msw, n0), i AS (SELECT *, greatest((msb - msw) / (msb + (n0 - 1) * msw), 0) AS icc FROM b)
SELECT round(icc, 8) AS icc, round(1 + (n / k - 1) * icc, 6) AS deff, round(n / (1 + (n / k - 1) * icc), 3) AS n_eff FROM i""")
def design_effect(spark, d):
    return _r(st.design_effect(st.moments(_y(spark, d), "g", "y")), icc=8, deff=6, n_eff=3)


@book.query("""SELECT '(intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def ols_simple(spark, d):
    return st.ols(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").select("term", F.round("estimate", 4).alias("estimate"))


@book.query()
def ols_robust(spark, d):
    return st.ols(load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", robust=True)


@book.query()
def nested_model_tests(spark, d):
    return st.nested_f(load(spark, d, "lineitem"), ["l_quantity"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@book.query()
def variance_inflation(spark, d):
    return st.vif(load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


_SURV = """s AS (SELECT o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS a FROM orders GROUP BY 1), w AS (SELECT o.o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS b FROM orders o JOIN s ON o.o_custkey = s.k WHERE CAST(o_orderdate AS DATE) > a GROUP BY 1), v AS (SELECT s.k % 2 AS g, date_diff('day', a, coalesce(b, DATE '2001-08-02')) AS t, (b IS NOT NULL)::INT AS e FROM s LEFT JOIN w USING (k))"""


def _survival(spark, d):
    p = purchases(spark, d)
    a = p.groupBy("customer").agg(F.min("day").alias("a"))
    b = p.join(a, "customer").where("day > a").groupBy("customer").agg(F.min("day").alias("b"))
    return a.join(b, "customer", "left").select((F.col("customer") % 2).alias("g"), F.datediff(F.coalesce("b", F.lit(AS_OF).cast("date")), "a").cast("long").alias("t"), F.col("b").isNotNull().cast("int").alias("e"))


@book.query(f"""WITH {_SURV}, c AS (SELECT g, t, count(*) AS n, sum(e)::BIGINT AS events FROM v GROUP BY 1, 2), r AS (SELECT g, t, events, (sum(n) OVER (PARTITION BY g ORDER BY t DESC))::BIGINT AS at_risk FROM c), k AS (SELECT * FROM r WHERE events > 0)
SELECT g AS grp, t, at_risk, events, round(CASE WHEN min(at_risk - events) OVER w = 0 THEN 0 ELSE exp(sum(ln(CASE WHEN at_risk > events THEN 1 - events / at_risk END)) OVER w) END, 10) AS survival FROM k WINDOW w AS (PARTITION BY g ORDER BY t)""")
def km_curve(spark, d):
    return _r(st.kaplan_meier(_survival(spark, d), "g", "t", "e"), survival=10)


@book.query(f"""WITH {_SURV}, c AS (SELECT t, count(*)::DOUBLE AS n, sum(g)::DOUBLE AS n1, sum(e)::DOUBLE AS d, sum(e * g)::DOUBLE AS d1 FROM v GROUP BY t), r AS (SELECT t, d, d1, sum(n) OVER (ORDER BY t DESC) AS r, sum(n1) OVER (ORDER BY t DESC) AS r1 FROM c)
SELECT sum(d1) AS observed, round(sum(d * r1 / r), 6) AS expected, round(power(sum(d1) - sum(d * r1 / r), 2) / sum(CASE WHEN r > 1 THEN d * r1 / r * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END), 6) AS chi2 FROM r WHERE d > 0""")
def logrank(spark, d):
    return _r(st.logrank(_survival(spark, d), "g", "t", "e"), expected=6, chi2=6)


_PRED = f"""f AS (SELECT o_custkey AS k, date_diff('day', max(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) < DATE '{SPLIT}'), DATE '{SPLIT}') AS r, count(*) FILTER (CAST(o_orderdate AS DATE) < DATE '{SPLIT}') AS past, max((CAST(o_orderdate AS DATE) >= DATE '{SPLIT}')::INT) AS y FROM orders GROUP BY 1), z AS (SELECT k, -r AS s, past, y FROM f WHERE r IS NOT NULL)"""


def _predict(spark, d):
    before = F.col("day") < SPLIT
    f = purchases(spark, d).groupBy("customer").agg(F.datediff(F.lit(SPLIT).cast("date"), F.max(F.when(before, F.col("day")))).alias("r"), F.count(F.when(before, 1)).alias("past"), F.max((~before).cast("int")).alias("y"))
    return f.where("r is not null").select("customer", (-F.col("r")).alias("s"), "past", "y")


@book.query(f"""WITH {_PRED}, t AS (SELECT ntile(10) OVER (ORDER BY s DESC, k) AS tile, y FROM z), g AS (SELECT tile, count(*) AS n, sum(y)::DOUBLE AS hits FROM t GROUP BY tile)
SELECT tile, n, round(hits / n / (sum(hits) OVER () / sum(n) OVER ()), 6) AS lift, round(sum(hits) OVER (ORDER BY tile) / sum(hits) OVER (), 6) AS gain FROM g""")
def lift_gain_deciles(spark, d):
    return _r(st.gain(_predict(spark, d), "s", "y", "customer"), lift=6, gain=6)


@book.query(f"""WITH {_PRED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM z) SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)), 8) AS auc FROM r""")
def auc_baseline_r(spark, d):
    return _r(st.auc(_predict(spark, d), "s", "y"), auc=8)


@book.query(f"""WITH {_PRED}, p AS (SELECT 1 / (1 + exp(-(past - 9) / 4.0)) AS p, y FROM z), b AS (SELECT CASE WHEN p < 0.25 THEN 0 WHEN p < 0.5 THEN 1 WHEN p < 0.75 THEN 2 ELSE 3 END AS bin, p, y FROM p WHERE p BETWEEN 0 AND 1)
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, round(avg((p - y) * (p - y)), 6) AS brier FROM b GROUP BY bin""")
def calibration_bins(spark, d):
    x = _predict(spark, d).withColumn("p", 1 / (1 + F.exp(-(F.col("past") - 9) / 4.0)))
    return _r(st.calibration(x, "p", "y", [0.0, 0.25, 0.5, 0.75, 1.0]), predicted=6, observed=6, brier=6)


@book.query("""WITH n AS (SELECT label AS a, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS ij, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM n GROUP BY a)) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM n GROUP BY b)) AS j, (SELECT sum(n) FROM n) AS t)
SELECT round((ij - i * j / (t * (t - 1) / 2)) / nullif((i + j) / 2 - i * j / (t * (t - 1) / 2), 0), 8) AS ari FROM s""")
def ari_table(spark, d):
    e = load(spark, d, "embeddings").select("label", (F.col("embedding")[0] > 0).cast("int").alias("b"))
    return _r(st.adjusted_rand(e, "label", "b"), ari=8)


@book.query()
def kmeans_profile(spark, d):
    """Cluster sizes and Calinski-Harabasz indices for k = 2..6, with the smallest-cluster gate."""
    return models.choose_k(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector("embedding").alias("features")), range(2, 7))


@book.query()
def seasonal_baseline(spark, d):
    """Monthly sales with the level that trend and month explain, and what is above it."""
    m = purchases(spark, d).groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("amount").alias("y"))
    return models.seasonal_baseline(m)


@book.query("""WITH m AS (SELECT c_mktsegment AS seg, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), f AS (SELECT *, lag(y, 12) OVER (PARTITION BY seg ORDER BY month) AS naive FROM m)
SELECT seg, count(naive) AS n, round(avg(abs(y - naive)), 2) AS mae, round(avg(abs(y - naive) / y), 6) AS mape FROM f GROUP BY seg""")
def seasonal_naive(spark, d):
    from pyspark.sql import Window

    m = purchases(spark, d).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), F.trunc("day", "month").alias("month")).agg(F.sum("amount").alias("y"))
    f = m.withColumn("naive", F.lag("y", 12).over(Window.partitionBy("seg").orderBy("month")))
    e = F.abs(F.col("y") - F.col("naive"))
    return f.groupBy("seg").agg(F.count("naive").alias("n"), F.round(F.avg(e), 2).alias("mae"), F.round(F.avg(e / F.col("y")), 6).alias("mape"))


@book.query()
def ets_forecast(spark, d):
    m = purchases(spark, d).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("series"), F.trunc("day", "month").alias("ds")).agg(F.sum("amount").alias("y"))
    return models.ets(m, 12, 6)


@book.query()
def repeat_model(spark, d):
    """Logistic model of buying again, against the recency baseline out of time."""
    return models.repeat_model(_predict(spark, d))


@book.query()
def glm_poisson(spark, d):
    return models.glm(_predict(spark, d).withColumn("x", F.col("s") / 100.0), ["x"], "past", "poisson", "log")


