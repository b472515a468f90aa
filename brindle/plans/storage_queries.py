"""Sources, loads and snapshots: each writes below the shared folder and gives what can be read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.operators import lineage
from brindle.plans.base import Book
from brindle.session import shared_dir
from brindle.sources import files
from brindle.sources.lake import Lake
from brindle.tables import load

book = Book()


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@book.query("SELECT c_custkey, c_mktsegment, c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 5 UNION ALL SELECT -c_custkey, 'NEW', 1.0 FROM customer WHERE c_custkey % 100 = 1")
def merge_upsert_delete(spark, d):
    """A merge that updates a tenth of the customers, deletes a tenth and adds some."""
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    t = Lake(spark, _place(spark, "lake"))
    t.commit(c, "load")
    up = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100).withColumn("gone", F.lit(False))
    gone = c.where("c_custkey % 10 = 5").withColumn("gone", F.lit(True))
    new = c.where("c_custkey % 100 = 1").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"), F.lit(False).alias("gone"))
    t.merge(up.unionByName(gone).unionByName(new), ["c_custkey"], delete="gone")
    return t.read()


@book.query("SELECT 'inserted' AS change, count(*) AS n FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'deleted', count(*) FROM customer WHERE c_custkey % 10 IN (0, 5)")
def snapshot_changes(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    t = Lake(spark, _place(spark, "lake"))
    t.commit(c, "load")
    t.commit(c.where("c_custkey % 10 <> 5").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))), "edit")
    return t.insertions(1, 2).agg(F.lit("inserted").alias("change"), F.count("*").alias("n")).unionByName(t.deletions(1, 2).agg(F.lit("deleted").alias("change"), F.count("*").alias("n")))


@book.query("SELECT n_nationkey AS key, n_name AS label, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def time_travel_names(spark, d):
    """The first version under the names of the last, after a rename and a widened type."""
    t = Lake(spark, _place(spark, "lake"))
    t.commit(load(spark, d, "nation"), "load")
    t.rename_column("n_name", "label")
    t.rename_column("n_nationkey", "key")
    t.widen_column("n_regionkey", "bigint")
    t.compact(1)
    t.protect(1)
    t.expire(1)
    return t.with_history_names(1).select("key", "label", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


@book.query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def idempotent_reload(spark, d):
    """Partitions loaded, then one of them again: the others stay and nothing doubles."""
    o = load(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    path = _place(spark, "load")
    files.write_partitions(o, path, ["year"])
    files.write_partitions(o.where("year = 1997"), path, ["year"])
    return spark.read.parquet(path).groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@book.query("SELECT r_regionkey AS k, r_name AS name, NULL::DOUBLE AS extra FROM region UNION ALL SELECT n_nationkey, n_name, n_nationkey * 0.5::DOUBLE FROM nation")
def union_by_name(spark, d):
    path = _place(spark, "union")
    load(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).write.parquet(f"{path}/a")
    load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 0.5).cast("double").alias("extra")).write.parquet(f"{path}/b")
    return files.parquet(spark, f"{path}/a", f"{path}/b", by_name=True).select("k", "name", "extra")


@book.query("SELECT n_nationkey AS k, '客戶' || n_name AS name FROM nation WHERE n_nationkey <> 3")
def csv_big5(spark, d):
    """A CSV in Big5 with a total row that isn't data."""
    path = _place(spark, "big5")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.when(F.col("n_nationkey") == 3, "總計").otherwise(F.concat(F.lit("客戶"), "n_name")).alias("name"))
    n.write.option("header", True).option("encoding", "big5").csv(path)
    rows, _ = files.without_pivot_rows(files.csv(spark, path, encoding="big5"), "name")
    return rows.select(F.col("k").cast("int").alias("k"), "name")


@book.query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 10")
def ordered_models(spark, d):
    """Three SQL models run in the order their reads ask for."""
    load(spark, d, "orders").createOrReplaceTempView("raw_orders")
    models = {
        "mart_years": "-- depends_on: stg_done\nSELECT * FROM stg_years WHERE n > 10",
        "stg_years": "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM stg_done GROUP BY 1",
        "stg_done": "SELECT * FROM raw_orders WHERE o_orderstatus = 'F'",
    }
    return lineage.run(spark, models)["mart_years"]


@book.query("SELECT 'orders' AS input, count(*) AS rows, round(sum(o_totalprice), 2) AS amount FROM orders UNION ALL SELECT 'lineitem', count(*), round(sum(l_extendedprice), 2) FROM lineitem")
def run_manifest(spark, d):
    r = lineage.run_record({"orders": load(spark, d, "orders"), "lineitem": load(spark, d, "lineitem")}, {"orders": "o_totalprice", "lineitem": "l_extendedprice"})
    return r.select("input", "rows", F.round("amount", 2).alias("amount"))
