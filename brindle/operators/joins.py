"""Joins that need more than a key: as-of, validity ranges, dense calendars, overlaps."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import materialise

PAIRS = 2_000_000  # to a partition, where pairs are counted


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time (null if there is none).

    One shuffle by key: both sides are stacked and the last right row is carried forward in time order, so nothing is
    expanded however long a right row stays valid. Right rows of one time: the greatest values win."""
    cols = [c for c in left.columns if c not in (by, left_time)]
    a = left.select(F.col(by).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("_r"))
    b = right.where(F.col(right_time).isNotNull()).select(F.col(by).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_r", F.when(F.col("_t").isNotNull() & F.col("_k").isNotNull(), F.last("_r", ignorenulls=True).over(w)))
    return both.where("_side = 1").select(F.col(f"_l.{by}"), F.col(f"_l.{left_time}"), *[F.col(f"_l.{c}") for c in cols], *[F.col(f"_r.{v}").alias(v) for v in values])


def in_validity(facts: DataFrame, dim: DataFrame, by: str, time: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Facts with the dimension row valid at their time: equal keys, start <= time, time < end (open where null)."""
    on = (facts[by] == dim[by]) & (dim[start] <= facts[time]) & ((facts[time] < dim[end]) | dim[end].isNull())
    return facts.join(dim, on, "left").drop(dim[by])


def near_in_time(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, days: int) -> DataFrame:
    """Pairs of rows with one key whose right time lies up to ``days`` before the left time. Time is cut into buckets of that
    length and a right row is put in its own and the next, so that the join is on equal (key, bucket) whatever the key's skew."""
    width = days + 1
    a = left.withColumn("_b", F.floor(F.unix_date(F.col(left_time).cast("date")) / width))
    own = F.floor(F.unix_date(F.col(right_time).cast("date")) / width)
    b = right.withColumn("_b", F.explode(F.array(own, own + 1)))
    gap = F.datediff(F.col(left_time).cast("date"), F.col(right_time).cast("date"))
    return a.join(b, [by, "_b"]).where(gap.between(0, days)).drop("_b")


def calendar(spark, first: str, last: str) -> DataFrame:
    """Days without a gap, with weekday (Sunday 0), month, week and flags."""
    d = spark.sql("SELECT explode(sequence(:a, :b, interval 1 day)) AS day", {"a": date.fromisoformat(first), "b": date.fromisoformat(last)})
    wd = (F.dayofweek("day") - 1).cast("long")
    return d.select("day", wd.alias("weekday"), F.month("day").cast("long").alias("month"), F.weekofyear("day").cast("long").alias("week"), wd.isin(0, 6).alias("weekend"))


def dense(facts: DataFrame, days: DataFrame, day: str, values: list[str]) -> DataFrame:
    """Every calendar day with the facts' values, 0 where there are none."""
    return days.select(F.col("day")).join(facts.withColumnRenamed(day, "day"), "day", "left").select("day", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def history(rows: DataFrame, key: str, time: str, attribute: str) -> DataFrame:
    """A slowly changing dimension from observations: one row for each run of equal values, without gap or overlap."""
    w = Window.partitionBy(key).orderBy(time)
    change = rows.select(key, time, attribute).distinct().withColumn("_p", F.lag(attribute).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_p").eqNullSafe(F.col(attribute)))
    end = F.lead(time).over(w)
    return change.select(key, attribute, F.col(time).alias("valid_from"), end.alias("valid_to"), end.isNull().alias("is_current"))


def overlaps(members: DataFrame, group: str, key: str) -> DataFrame:
    """(a, b, both, jaccard) of every two groups that share members.

    Each member's sorted groups go to every group among them, cut behind it; pairs are opened there and counted without another shuffle. The partitions
    follow from the exact number of pairs, so that the counts of one stay in memory."""
    m = members.select(F.col(group).alias("g"), F.col(key).alias("k")).where("g is not null").repartition("k").distinct()
    s = materialise(m.groupBy("k").agg(F.sort_array(F.collect_list("g")).alias("s")).select(F.col("k").isNotNull().alias("known"), "s"), "baskets")
    n = materialise(s.select(F.explode("s").alias("g")).groupBy("g").count(), "group-sizes")
    s = s.where("known and size(s) > 1")
    pairs = s.agg(F.sum(F.size("s").cast("double") * (F.size("s") - 1) / 2)).first()[0] or 0
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS))
    cut = s.select(F.posexplode("s").alias("i", "a"), "s").where("i < size(s) - 1").select("a", F.slice("s", F.col("i") + 2, F.size("s")).alias("s"))
    pair = cut.repartition(parts, "a").select("a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pair.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return out.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))
