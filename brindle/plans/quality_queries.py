"""Quality gates over the star schema, restatement and evidence gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import checks, evidence, joins
from brindle.operators.checks import WARNING, Gate
from brindle.plans.base import Book
from brindle.tables import load, purchases

book = Book()


def gates(spark, d) -> list[Gate]:
    o, li, c, e = (load(spark, d, t) for t in ("orders", "lineitem", "customer", "events"))
    return [
        Gate("Q16_orders_customer", checks.orphans(o, "o_custkey", c, "c_custkey")),
        Gate("Q17_orders_grain", checks.grain_unique(o, ["o_orderkey"])),
        Gate("Q17_lineitem_grain", checks.grain_unique(li, ["l_orderkey", "l_linenumber"])),
        Gate("Q23_status", checks.in_domain(o, "o_orderstatus", ("F", "O", "P"))),
        Gate("Q23_amount", o.where("o_totalprice < 0")),
        Gate("Q23_key", checks.not_null(o, "o_orderkey")),
        Gate("Q25_discount", li.where("l_discount < 0 or l_discount > 1"), WARNING),
        Gate("Q10_event_value", checks.sentinel_suspects(e, "user_id", "value")),
        Gate("Q24_line_orders", checks.orphans(li, "l_orderkey", o, "o_orderkey"), WARNING),
        Gate("Q25_future", o.where(F.col("o_orderdate").cast("date") > "2001-08-02")),
    ]


@book.query("""WITH g(gate, violations, sev) AS (
SELECT 'Q16_orders_customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), 1 UNION ALL
SELECT 'Q17_orders_grain', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)), 1 UNION ALL
SELECT 'Q17_lineitem_grain', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 1 UNION ALL
SELECT 'Q23_status', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P')), 1 UNION ALL
SELECT 'Q23_amount', (SELECT count(*) FROM orders WHERE o_totalprice < 0), 1 UNION ALL
SELECT 'Q23_key', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL), 1 UNION ALL
SELECT 'Q25_discount', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1), 2 UNION ALL
SELECT 'Q10_event_value', (SELECT count(*) FROM (SELECT value FROM events WHERE value IS NOT NULL GROUP BY value HAVING count(*) = (SELECT count(DISTINCT user_id) FROM events) AND count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events))), 1 UNION ALL
SELECT 'Q24_line_orders', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), 2 UNION ALL
SELECT 'Q25_future', (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2001-08-02'), 1)
SELECT gate, violations, CAST(CASE WHEN violations = 0 THEN 0 ELSE sev END AS BIGINT) AS code FROM g""")
def quality_gates_summary(spark, d):
    return checks.summary(spark, gates(spark, d))


@book.query("""WITH r AS (SELECT o_custkey % 50 AS k, o_orderkey AS v, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2), g AS (SELECT k, arg_min(x, v) AS first_value, arg_max(x, v) AS last_value FROM r GROUP BY k) SELECT k, first_value, last_value FROM g WHERE abs(last_value - first_value) > 0.05 * abs(first_value)""")
def restatement(spark, d):
    r = load(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("v")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    return checks.restated(r, ["k"], "x", "v")


@book.query("""SELECT norm, variants FROM (SELECT regexp_replace(lower(trim(s)), '[\\s_-]+', '', 'g') AS norm, list(DISTINCT s ORDER BY s) AS variants FROM (SELECT CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS s FROM events) GROUP BY 1) WHERE len(variants) > 1""")
def spelling_variants(spark, d):
    e = load(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("s"))
    return checks.spelling_variants(e, "s")


@book.query("""WITH b AS (SELECT event_type AS s, count(*) AS n FROM events GROUP BY 1), t AS (SELECT s, n, sum(CASE WHEN s NOT IN ('click', 'view') THEN n ELSE 0 END) OVER () / sum(n) OVER () AS share FROM b) SELECT s, n AS count, round(share, 6) AS share FROM t WHERE s NOT IN ('click', 'view') AND share > 0.01""")
def unmapped_channels(spark, d):
    m = spark.createDataFrame([("click",), ("view",)], "s string")
    return checks.unmapped(load(spark, d, "events").select(F.col("event_type").alias("s")), "s", m).withColumn("share", F.round("share", 6))


@book.query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg((value > 0)::INT), 6) AS rate, coalesce(abs(avg((value > 0)::INT) - lag(avg((value > 0)::INT), 7) OVER (ORDER BY CAST(ts AS DATE))) > 0.05, false) AS jumped FROM events GROUP BY 1""")
def rate_jump(spark, d):
    """Q14's form: a daily share that moved by more than 5 points within a week."""
    from pyspark.sql import Window

    g = load(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("value") > 0).cast("int")).alias("r"))
    return g.select("day", "n", F.round("r", 6).alias("rate"), F.coalesce(F.abs(F.col("r") - F.lag("r", 7).over(Window.orderBy("day"))) > 0.05, F.lit(False)).alias("jumped"))


@book.query("""SELECT day FROM (SELECT CAST(range AS DATE) AS day FROM range(DATE '1995-01-01', DATE '2001-08-02', INTERVAL 1 DAY)) WHERE day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def missing_days(spark, d):
    return joins.calendar(spark, "1995-01-01", "2001-08-01").select("day").join(purchases(spark, d).select("day").distinct(), "day", "left_anti")


@book.query("""SELECT c.name AS claim, CASE WHEN c.stated = 'experiment' AND has_control AND randomised THEN 'experiment' WHEN c.stated IN ('experiment', 'quasi-experiment') AND has_control THEN 'quasi-experiment' WHEN c.stated <> 'correlation' AND out_of_time THEN 'prediction' ELSE 'correlation' END AS level
FROM (VALUES ('a', 'experiment', true, true, true), ('b', 'experiment', true, false, true), ('c', 'experiment', false, false, true), ('d', 'quasi-experiment', false, false, false), ('e', 'prediction', false, false, true), ('f', 'correlation', true, true, true)) c(name, stated, has_control, randomised, out_of_time)""")
def evidence_levels(spark, d):
    rows = [("a", "experiment", True, True, True), ("b", "experiment", True, False, True), ("c", "experiment", False, False, True), ("d", "quasi-experiment", False, False, False), ("e", "prediction", False, False, True), ("f", "correlation", True, True, True)]
    c = spark.createDataFrame(rows, "claim string, stated string, has_control boolean, randomised boolean, out_of_time boolean")
    return evidence.levels(c).select("claim", "level")


@book.query("""SELECT o_custkey % 7 AS terminal, count(*) AS n, sum((o_totalprice <= 2000)::INT)::BIGINT AS small FROM orders WHERE o_totalprice <= 2000 OR o_custkey % 7 = 3 GROUP BY 1""")
def pos_test_rows(spark, d):
    o = load(spark, d, "orders").select(F.col("o_totalprice").alias("amount"), F.lit("M").alias("member_id"), (F.col("o_custkey") % 7).alias("terminal_id"))
    t = checks.test_transactions(o, ("TEST",), (3,), 2000.0)
    return t.groupBy(F.col("terminal_id").alias("terminal")).agg(F.count("*").alias("n"), F.sum(F.array_contains("reasons", "amount").cast("int")).alias("small"))
