"""Sessions, funnels and windows, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import business_date
from brindle.session import shared_dir


def idle_sessions(e: DataFrame, user: str, ts: str, gap: str):
    """Grouped by user and session window: works the same on a stream with a watermark."""
    return e.groupBy(user, F.session_window(ts, gap))


def cut(e: DataFrame, user: str, ts: str, tie: str, minutes: int, cutoff_hours: int, attributes: list[str]) -> DataFrame:
    """Rows with ``cut`` (why a session begins there: start, idle, day or the attribute that changed; null inside one) and ``session`` (its
    number for the user)."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    day = business_date(ts, cutoff_hours)
    e = e.withColumn("_day", day)
    why = F.when(F.lag(ts).over(w).isNull(), "start").when(F.col(ts).cast("timestamp") > F.lag(ts).over(w).cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes)), "idle").when(F.col("_day") != F.lag("_day").over(w), "day")
    for a in attributes:
        why = why.when(~F.col(a).eqNullSafe(F.lag(a).over(w)), a)
    return e.withColumn("cut", why).withColumn("session", F.count("cut").over(w)).drop("_day")


def funnel(e: DataFrame, user: str, ts: str, kind: str, steps: list[str]) -> DataFrame:
    """How many users did the steps in order: one row, one column a step. A user's events are one sorted array; each step takes the first event
    of its kind after the step before."""
    g = e.where(F.col(kind).isin(*steps)).groupBy(user).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(kind).alias("k")))).alias("s"))
    cols = []

    def after(step: str, prev):
        return F.filter("s", lambda x: (x["k"] == step) & (x["t"] > prev) if prev is not None else x["k"] == step)

    for i, k in enumerate(steps):
        g = g.withColumn(f"t{i}", F.get(after(k, F.col(f"t{i - 1}") if i else None), F.lit(0))["t"])
        cols.append(F.count(f"t{i}").alias(k))
    return g.agg(*cols)


def bot_share(e: DataFrame, user: str, ts: str, quantile: float) -> DataFrame:
    """Users a day with more events than the quantile of all user-days, and their share of events."""
    u = e.groupBy(user, F.col(ts).cast("date").alias("day")).agg(F.count("*").alias("n"))
    q = u.agg(F.percentile("n", quantile).alias("q"))
    hot = F.col("n") > F.col("q")
    return u.crossJoin(F.broadcast(q)).groupBy("day").agg(F.count("*").alias("users"), F.sum(hot.cast("int")).alias("suspects"), (F.sum(F.when(hot, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def stream_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily counts through Structured Streaming: files in, watermark of a day, windows to a table in the shared folder. State and progress are
    checkpointed there, so a restarted query goes on where it was."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    n = e.withWatermark("at", "1 day").groupBy(F.window("at", "1 day")).agg(F.count("*").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote
        batch.select(F.col("window.start").alias("start"), "n").write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = n.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch").alias("last"))
    return out.join(F.broadcast(last), F.col("batch") == F.col("last")).select(F.col("start").cast("date").alias("day"), "n")


def deduplicated(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
