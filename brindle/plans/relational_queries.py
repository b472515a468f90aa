"""Projection, joins, aggregates, windows, sets: one query a family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions.scalars import business_date, money, normal_text, unless_sentinel, yeo_johnson
from brindle.operators import joins, ordered
from brindle.plans.base import Book
from brindle.tables import lines, load, purchases

book = Book()


@book.query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("2001-06-01 00:00:00")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@book.query("""SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL""")
def star_join(spark, d):
    o = load(spark, d, "orders").where(F.col("o_orderdate").cast("date").between("1997-01-01", "1998-12-31"))
    x = o.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


_STATES = """h AS (SELECT s_suppkey AS store, CAST(v AS DATE) AS valid_from, 'grade' || CAST((s_suppkey + i) % 3 AS VARCHAR) AS grade FROM supplier, (VALUES (0, DATE '1995-01-01'), (1, DATE '1997-03-01'), (2, DATE '1999-09-15')) t(i, v))"""


def _grades(spark, d):
    t = spark.createDataFrame([(0, "1995-01-01"), (1, "1997-03-01"), (2, "1999-09-15")], "i int, v string")
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("store")).crossJoin(F.broadcast(t))
    return s.select("store", F.col("v").cast("date").alias("valid_from"), F.concat(F.lit("grade"), ((F.col("store") + F.col("i")) % 3).cast("string")).alias("grade"))


@book.query(f"""WITH {_STATES}, f AS (SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS amount FROM lineitem)
SELECT grade, count(*) AS n, round(sum(amount), 2) AS amount FROM f ASOF LEFT JOIN h ON f.store = h.store AND f.day >= h.valid_from GROUP BY grade""")
def scd2_asof_join(spark, d):
    f = lines(spark, d).select("store", "day", "amount")
    j = joins.as_of(f, _grades(spark, d), "store", "day", "valid_from", ["grade"])
    return j.groupBy("grade").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@book.query(f"""WITH {_STATES}, r AS (SELECT store, grade, valid_from, lead(valid_from) OVER (PARTITION BY store ORDER BY valid_from) AS valid_to FROM h), f AS (SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT grade, count(*) AS n FROM f LEFT JOIN r ON f.store = r.store AND valid_from <= day AND (day < valid_to OR valid_to IS NULL) GROUP BY grade""")
def validity_range_join(spark, d):
    dim = _grades(spark, d).withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("store").orderBy("valid_from")))
    return joins.in_validity(lines(spark, d).select("store", "day"), dim, "store", "day").groupBy("grade").agg(F.count("*").alias("n"))


@book.query(f"""WITH {_STATES}, c AS (SELECT *, lag(grade) OVER w AS p, row_number() OVER w AS n FROM h WINDOW w AS (PARTITION BY store ORDER BY valid_from)), k AS (SELECT * FROM c WHERE n = 1 OR p IS DISTINCT FROM grade)
SELECT store, grade, valid_from, lead(valid_from) OVER (PARTITION BY store ORDER BY valid_from) AS valid_to, lead(valid_from) OVER (PARTITION BY store ORDER BY valid_from) IS NULL AS is_current FROM k""")
def scd2_build(spark, d):
    return joins.history(_grades(spark, d), "store", "valid_from", "grade")


@book.query("""WITH fx(currency, day, rate) AS (VALUES ('AUD', DATE '1997-01-01', 20.5), ('EUR', DATE '1997-01-01', 35.25)), o AS (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'AUD' WHEN 1 THEN 'EUR' ELSE 'XXX' END AS currency, o_totalprice FROM orders)
SELECT o.currency, count(*) AS n, sum((rate IS NULL)::INT) AS missing_rate, round(sum(o_totalprice * rate), 2) AS amount FROM o LEFT JOIN fx USING (currency) GROUP BY o.currency""")
def fx_left_join(spark, d):
    """A missing rate leaves the amount null and is counted; it is never taken as 1."""
    fx = spark.createDataFrame([("AUD", 20.5), ("EUR", 35.25)], "currency string, rate double")
    o = load(spark, d, "orders")
    c = F.when(F.col("o_custkey") % 3 == 0, "AUD").when(F.col("o_custkey") % 3 == 1, "EUR").otherwise("XXX")
    j = o.select(c.alias("currency"), "o_totalprice").join(F.broadcast(fx), "currency", "left")
    return j.groupBy("currency").agg(F.count("*").alias("n"), F.sum(F.col("rate").isNull().cast("long")).alias("missing_rate"), F.round(F.sum(F.col("o_totalprice") * F.col("rate")), 2).alias("amount"))


@book.query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT a.k AS later, b.k AS earlier, date_diff('day', b.day, a.day) AS gap FROM o a JOIN o b ON a.c = b.c AND date_diff('day', b.day, a.day) BETWEEN 0 AND 30 WHERE a.k <> b.k AND (b.day < a.day OR b.k < a.k)""")
def identity_stitch(spark, d):
    o = purchases(spark, d).select("customer", "txn", "day")
    j = joins.near_in_time(o.toDF("customer", "later", "day_a"), o.toDF("customer", "earlier", "day_b"), "customer", "day_a", "day_b", 30)
    return j.where("later <> earlier and (day_b < day_a or earlier < later)").select("later", "earlier", F.datediff("day_a", "day_b").cast("long").alias("gap"))


@book.query("""SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphan_orders, (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS silent_customers, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE year(l_shipdate) = 1996 INTERSECT SELECT l_suppkey FROM lineitem WHERE year(l_shipdate) = 1997)) AS stores_in_both""")
def semi_anti_orphans(spark, d):
    o, c, li = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "lineitem")
    a = o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg(F.count("*").alias("orphan_orders"))
    b = c.join(o, o.o_custkey == c.c_custkey, "left_anti").agg(F.count("*").alias("silent_customers"))
    y = lambda n: li.where(F.year("l_shipdate") == n).select("l_suppkey")
    return a.crossJoin(b).crossJoin(y(1996).intersect(y(1997)).agg(F.count("*").alias("stores_in_both")))


@book.query("""WITH c AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '1995-01-01', DATE '2001-09-01', INTERVAL 1 DAY)), f AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(o_totalprice) AS amount FROM orders GROUP BY 1)
SELECT c.day, coalesce(n, 0) AS n, round(coalesce(amount, 0), 2) AS amount FROM c LEFT JOIN f USING (day)""")
def calendar_dense_sales(spark, d):
    f = purchases(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    return joins.dense(f, joins.calendar(spark, "1995-01-01", "2001-08-31"), "day", ["n", "amount"]).withColumn("amount", F.col("amount").cast("double"))


@book.query("""SELECT CAST(range AS DATE) AS day, CAST(dayofweek(range) AS BIGINT) AS weekday, CAST(month(range) AS BIGINT) AS month, CAST(week(range) AS BIGINT) AS week, dayofweek(range) IN (0, 6) AS weekend FROM range(DATE '2009-01-01', DATE '2014-01-01', INTERVAL 1 DAY)""")
def calendar_days(spark, d):
    return joins.calendar(spark, "2009-01-01", "2013-12-31")


@book.query("""WITH c AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '1995-01-01', DATE '2001-08-02', INTERVAL 1 DAY)), f AS (SELECT c.day, count(o_orderkey) AS n FROM c LEFT JOIN orders ON CAST(o_orderdate AS DATE) = c.day GROUP BY 1),
w AS (SELECT day, n, quantile_cont(n, 0.5) OVER (PARTITION BY dayofweek(day) ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS expected FROM f) SELECT day, n, round(expected, 4) AS expected, coalesce(abs(n - expected) / nullif(expected, 0) > 0.3, false) AS incomplete FROM w""")
def weekday_median_completeness(spark, d):
    f = purchases(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    x = joins.dense(f, joins.calendar(spark, "1995-01-01", "2001-08-01"), "day", ["n"])
    w = Window.partitionBy(F.dayofweek("day")).orderBy("day").rowsBetween(-4, -1)
    x = x.withColumn("n", F.col("n").cast("long")).withColumn("expected", F.percentile("n", 0.5).over(w))
    return x.select("day", "n", F.round("expected", 4).alias("expected"), F.coalesce(F.abs(F.col("n") - F.col("expected")) / F.nullif("expected", F.lit(0.0)) > 0.3, F.lit(False)).alias("incomplete"))


@book.query("""WITH m AS (SELECT DISTINCT l_suppkey AS g, o_custkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT g, count(*) AS n FROM m GROUP BY g), p AS (SELECT a.g AS a, b.g AS b, count(*) AS both_n FROM m a JOIN m b ON a.k = b.k AND a.g < b.g GROUP BY 1, 2)
SELECT a, b, both_n AS both, round(both_n / (x.n + y.n - both_n), 6) AS jaccard FROM p JOIN n x ON x.g = a JOIN n y ON y.g = b""")
def audience_jaccard(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn"), F.col("l_suppkey").alias("store")).join(purchases(spark, d), "txn")
    return joins.overlaps(m, "store", "customer").withColumn("jaccard", F.round("jaccard", 6))


@book.query("""SELECT coalesce(a.s, b.s) AS store, a.s IS NULL AS unexpected, b.s IS NULL AS missing FROM (SELECT s_suppkey AS s FROM supplier) a FULL JOIN (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1998-06-01') b ON a.s = b.s""")
def expected_actual_stores(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("a"))
    b = lines(spark, d).where(F.col("day") == "1998-06-01").select(F.col("store").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("store"), F.col("a").isNull().alias("unexpected"), F.col("b").isNull().alias("missing"))


@book.query("""SELECT 'amount' AS metric, count(*) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3, min(x) AS low, max(x) AS high, round(stddev_samp(x) / avg(x), 6) AS cv, round(skewness(x), 5) AS skew, round(sum((x - m) * (x - m) * (x - m) * (x - m)) / count(*) / power(var_pop(x), 2) - 3, 5) AS kurt_pop, round(avg(abs(x - m)), 4) AS mad, round(var_pop(x), 0) AS var_pop, round(exp(avg(ln(x))), 4) AS geometric, round(count(*) / sum(1 / x), 4) AS harmonic
FROM (SELECT o_totalprice AS x, (SELECT avg(o_totalprice) FROM orders) AS m FROM orders)""")
def five_number_profile(spark, d):
    o = load(spark, d, "orders").select(F.col("o_totalprice").alias("x"))
    m = o.agg(F.avg("x").alias("m"))
    n = F.count("*").cast("double")
    skew = F.skewness("x") * F.sqrt(n * (n - 1)) / (n - 2)
    a = o.crossJoin(F.broadcast(m)).agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.stddev_samp("x") / F.avg("x"), 6).alias("cv"), F.round(skew, 5).alias("skew"), F.round(F.kurtosis("x"), 5).alias("kurt_pop"), F.round(F.avg(F.abs(F.col("x") - F.col("m"))), 4).alias("mad"), F.round(F.var_pop("x"), 0).alias("var_pop"), F.round(F.exp(F.avg(F.ln("x"))), 4).alias("geometric"), F.round(n / F.sum(1 / F.col("x")), 4).alias("harmonic"))
    q = ordered.quantiles(o, "x", [0.25, 0.5, 0.75])
    return a.crossJoin(F.broadcast(q)).select(F.lit("amount").alias("metric"), *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("q1", "median", "q3"))], *a.columns)


@book.query("""WITH q AS (SELECT c_mktsegment AS seg, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT seg, count(*) AS n, sum((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT)::BIGINT AS outside_inner, sum((x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1))::INT)::BIGINT AS outside_outer FROM (SELECT c_mktsegment AS seg, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey) JOIN q USING (seg) GROUP BY seg""")
def outlier_fences(spark, d):
    x = purchases(spark, d).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("seg"), F.col("amount").alias("x"))
    q = ordered.quantiles(x, "x", [0.25, 0.75], ["seg"])
    iqr = F.col("q")[1] - F.col("q")[0]
    out = lambda k: F.sum(((F.col("x") < F.col("q")[0] - k * iqr) | (F.col("x") > F.col("q")[1] + k * iqr)).cast("long"))
    return x.join(q, "seg").groupBy("seg").agg(F.count("*").alias("n"), out(1.5).alias("outside_inner"), out(3).alias("outside_outer"))


@book.query("""WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(ceil(1 + log2(count(*))) AS BIGINT) AS k FROM orders), b AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / k)) AS BIGINT), k - 1) AS bin, n AS total FROM orders, s),
c AS (SELECT bin, count(*) AS n, max(total) AS total FROM b GROUP BY bin) SELECT bin, n, round(n / total, 6) AS share, round(sum(n) OVER (ORDER BY bin) / total, 6) AS cumulative FROM c""")
def histogram_sturges(spark, d):
    o = load(spark, d, "orders").select(F.col("o_totalprice").alias("x"))
    s = o.agg(F.count("*").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("k", F.ceil(1 + F.log2("total")))
    bins = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("k"))), F.col("k") - 1)
    c = o.crossJoin(F.broadcast(s)).groupBy(bins.alias("bin"), "total").agg(F.count("*").alias("n"))
    return c.select("bin", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(F.sum("n").over(Window.orderBy("bin")) / F.col("total"), 6).alias("cumulative"))


@book.query("""SELECT c_mktsegment, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1995), 2) AS y1995, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS y1996, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997), 2) AS y1997 FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) <= 1997 GROUP BY 1""")
def pivot_segment_year(spark, d):
    a = purchases(spark, d).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey")).groupBy("c_mktsegment", F.concat(F.lit("y"), F.year("day")).alias("y")).agg(F.sum("amount").alias("m"))
    return a.groupBy("c_mktsegment").pivot("y", ["y1995", "y1996", "y1997"]).agg(F.round(F.sum("m"), 2))


@book.query("""WITH w AS (SELECT c_mktsegment AS seg, CAST(count(*) AS DOUBLE) AS n, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low FROM customer GROUP BY 1) UNPIVOT w ON n, mean, low INTO NAME metric VALUE v""")
def unpivot_metrics(spark, d):
    w = load(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").cast("double").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.min("c_acctbal").alias("low"))
    return w.unpivot(["seg"], ["n", "mean", "low"], "metric", "v")


@book.query("""SELECT r_name, n_name, c_mktsegment, CAST(grouping(r_name) * 4 + grouping(n_name) * 2 + grouping(c_mktsegment) AS BIGINT) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (c_mktsegment), ())""")
def grouping_sets_slices(spark, d):
    for t in ("customer", "nation", "region"):
        load(spark, d, t).createOrReplaceTempView(f"_gs_{t}")
    return spark.sql("SELECT r_name, n_name, c_mktsegment, CAST(grouping(r_name) * 4 + grouping(n_name) * 2 + grouping(c_mktsegment) AS BIGINT) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM _gs_customer JOIN _gs_nation ON c_nationkey = n_nationkey JOIN _gs_region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (c_mktsegment), ())")


@book.query("""WITH a AS (SELECT c_mktsegment AS seg, o_custkey AS c, sum(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), t AS (SELECT *, sum(m) OVER (PARTITION BY seg) AS total FROM a)
SELECT seg, count(*) AS n, round(avg(m), 2) AS mean, round(quantile_cont(m, 0.5), 2) AS median, round(max(m / total), 8) AS top1_share, round(sum((m / total) * (m / total)), 8) AS hhi FROM t GROUP BY seg""")
def group_estimates_hhi(spark, d):
    a = purchases(spark, d).groupBy("customer").agg(F.sum("amount").alias("m")).join(load(spark, d, "customer"), F.col("customer") == F.col("c_custkey"))
    total = a.groupBy("c_mktsegment").agg(F.sum("m").alias("total"))
    s = F.col("m") / F.col("total")
    q = ordered.quantiles(a, "m", [0.5], ["c_mktsegment"])
    return a.join(total, "c_mktsegment").join(q, "c_mktsegment").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"), F.round(F.avg("m"), 2).alias("mean"), F.round(F.first(F.col("q")[0]), 2).alias("median"), F.round(F.max(s), 8).alias("top1_share"), F.round(F.sum(s * s), 8).alias("hhi"))


@book.query("""SELECT round(corr(l_quantity, l_extendedprice), 8) AS r_qty_price, round(covar_samp(l_quantity, l_discount), 8) AS cov_qty_disc, round((corr(l_extendedprice, l_tax) - corr(l_extendedprice, l_quantity) * corr(l_tax, l_quantity)) / sqrt((1 - power(corr(l_extendedprice, l_quantity), 2)) * (1 - power(corr(l_tax, l_quantity), 2))), 8) AS partial_price_tax FROM lineitem""")
def correlation_measures(spark, d):
    li = load(spark, d, "lineitem")
    r = li.agg(F.corr("l_quantity", "l_extendedprice").alias("a"), F.covar_samp("l_quantity", "l_discount").alias("v"), F.corr("l_extendedprice", "l_tax").alias("b"), F.corr("l_tax", "l_quantity").alias("c"))
    part = (F.col("b") - F.col("a") * F.col("c")) / F.sqrt((1 - F.col("a") ** 2) * (1 - F.col("c") ** 2))
    return r.select(F.round("a", 8).alias("r_qty_price"), F.round("v", 8).alias("cov_qty_disc"), F.round(part, 8).alias("partial_price_tax"))


@book.query("""WITH s AS (SELECT n_name, sum(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), r AS (SELECT n_name, m, row_number() OVER (ORDER BY m DESC, n_name) AS rn FROM s)
SELECT CASE WHEN rn <= 5 THEN n_name ELSE 'other' END AS name, round(sum(m), 2) AS m FROM r GROUP BY 1""")
def top_n_and_other(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = purchases(spark, d).join(c, F.col("customer") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("amount").alias("m"))
    r = s.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("m"), "n_name")))
    return r.groupBy(F.when(F.col("rn") <= 5, F.col("n_name")).otherwise("other").alias("name")).agg(F.round(F.sum("m"), 2).alias("m"))


@book.query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS m FROM orders GROUP BY 1) SELECT month, round(m, 2) AS m, round(m - lag(m) OVER (ORDER BY month), 2) AS on_month, round(m / nullif(lag(m, 12) OVER (ORDER BY month), 0) - 1, 6) AS on_year FROM m""")
def period_changes(spark, d):
    m = purchases(spark, d).groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("amount").alias("m"))
    w = Window.orderBy("month")
    return m.select("month", F.round("m", 2).alias("m"), F.round(F.col("m") - F.lag("m").over(w), 2).alias("on_month"), F.round(F.col("m") / F.nullif(F.lag("m", 12).over(w), F.lit(0.0)) - 1, 6).alias("on_year"))


@book.query("""SELECT text, CAST(try_cast(regexp_replace(trim(text), '(?i)^(nt\\$|us\\$|\\$)|,', '', 'g') AS DECIMAL(18,4)) AS DOUBLE) AS amount FROM (VALUES ('NT$1,234.50'), (' 99 '), ('abc'), ('-5'), ('$0.1'), (NULL)) t(text)""")
def money_parse(spark, d):
    t = spark.createDataFrame([("NT$1,234.50",), (" 99 ",), ("abc",), ("-5",), ("$0.1",), (None,)], "text string")
    return t.select("text", money("text").cast("double").alias("amount"))


@book.query("""SELECT user_id, count(*) AS n, min(CAST(ts - INTERVAL 6 HOUR AS DATE)) AS first_day, count(DISTINCT CAST(ts - INTERVAL 6 HOUR AS DATE)) AS days, sum(CASE WHEN value = 0 THEN NULL ELSE 1 END)::BIGINT AS valued, round(sum(CASE WHEN value >= 0 THEN (power(value + 1, 0.5) - 1) / 0.5 END), 4) AS yj FROM events GROUP BY user_id""")
def business_days_of_users(spark, d):
    e = load(spark, d, "events")
    day = business_date("ts", 6)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.countDistinct(day).alias("days"), F.sum(F.when(unless_sentinel("value", 0.0).isNotNull(), 1)).alias("valued"), F.round(F.sum(F.when(F.col("value") >= 0, yeo_johnson(F.col("value"), 0.5))), 4).alias("yj"))


@book.query("""SELECT c_mktsegment AS seg, list(n_name ORDER BY n_name) AS names FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def list_aggregation(spark, d):
    x = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()
    return x.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))


@book.query("""SELECT count(*) AS n, count(DISTINCT lower(trim(o_orderpriority))) AS priorities, sum((o_orderpriority LIKE '%\\_%' ESCAPE '\\')::INT)::BIGINT AS odd, mode(o_orderpriority ORDER BY o_orderpriority) AS common FROM orders""")
def text_predicates(spark, d):
    o = load(spark, d, "orders")
    common = o.groupBy("o_orderpriority").count().agg(F.max_by("o_orderpriority", F.struct("count", F.lit(1))).alias("common"))
    return o.agg(F.count("*").alias("n"), F.countDistinct(normal_text("o_orderpriority")).alias("priorities"), F.sum(F.col("o_orderpriority").contains("_").cast("long")).alias("odd")).crossJoin(common)


@book.query("""WITH a AS (SELECT o_custkey AS c FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT o_custkey AS c FROM orders WHERE year(o_orderdate) = 1997) SELECT (SELECT count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) AS stacked, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_years, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS surplus""")
def set_operations(spark, d):
    y = lambda n: purchases(spark, d).where(F.year("day") == n).select("customer")
    c = lambda x, k: x.agg(F.count("*").alias(k))
    a, b = y(1996), y(1997)
    return c(a.unionByName(b), "stacked").crossJoin(c(a.union(b).distinct(), "either")).crossJoin(c(a.intersect(b), "both_years")).crossJoin(c(a.exceptAll(b), "surplus"))
