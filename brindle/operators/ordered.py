"""Positions in a total order without putting all rows through one partition: ranges of the order are sorted apart, and the
counts before each range are added."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from brindle.session import discard, materialise

PER_RANGE = 2_000_000


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` in ranges of the order, written, so that the ranges stay as they are; column ``_part`` numbers them."""
    parts = max(1, math.ceil(df.count() / PER_RANGE))
    if parts == 1:  # one range is one sorted partition
        return df.withColumn("_part", F.lit(0))
    return materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def running_total(df: DataFrame, order: list, value: str | Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to and with this one. The order must be total."""
    v = F.col(value) if isinstance(value, str) else value
    r = _ranged(df.withColumn("_v", v), order)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = r.groupBy("_part").agg(F.sum("_v").alias("_s"))  # ranges, a few numbers
    base = sums.select(F.col("_part"), (F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_base"))
    return r.withColumn(name, F.sum("_v").over(w)).join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_v", "_part", "_base")


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Add the row number, from 1, in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), name)


def tiles(df: DataFrame, order: list, k: int, name: str) -> DataFrame:
    """Add the tile, 1..k, as NTILE does: sizes differ by one at most, the larger tiles come first."""
    n = df.agg(F.count("*").alias("_n"))
    p = positions(df, order, "_p").crossJoin(F.broadcast(n))
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    head = r * (q + 1)
    tile = F.when(F.col("_p") <= head, F.ceil(F.col("_p") / (q + 1))).otherwise(r + F.ceil((F.col("_p") - head) / F.greatest(q, F.lit(1))))
    return p.withColumn(name, tile.cast("long")).drop("_p", "_n")


def quantiles(df: DataFrame, y: str, at: list[float], by: list[str] | None = None, name: str = "q") -> DataFrame:
    """(by, ``name``): the exact quantiles of ``y`` in each group, interpolated as ``percentile`` does. That keeps all distinct values of a group in
    one task; here the values at the wanted places are read off the running counts of distinct values, and only these reach the driver."""
    by = by or []
    c = materialise(df.select(*by, F.col(y).cast("double").alias("_y")).groupBy(*by, "_y").agg(F.count("_y").alias("_n")), "distinct")
    sizes = c.groupBy(*by).agg(F.sum("_n").alias("_n"))
    groups = (sizes.orderBy(*by) if by else sizes).collect()  # groups
    first, want = 0, []
    for g in groups:
        n = g["_n"] or 0
        want.append((first + 1, [(n - 1) * p for p in at] if n else []))
        first += n
    places = np.unique([k + f(p) for k, w in want for p in w for f in (math.floor, math.ceil)]).astype(np.int64)

    def pick(parts):
        for q in parts:
            upto, v = q["_upto"].to_numpy(), q["_y"].to_numpy()
            a, b = np.searchsorted(places, upto - q["_n"].to_numpy(), "right"), np.searchsorted(places, upto, "right")
            hit = np.flatnonzero(b > a)
            yield pd.DataFrame({"k": np.concatenate([places[a[i] : b[i]] for i in hit] or [places[:0]]), "v": np.repeat(v[hit], (b - a)[hit])})

    found = {}
    if len(places):
        r = running_total(c.where("_n > 0"), [*by, "_y"], "_n", "_upto").select("_y", "_n", "_upto")
        found = {x["k"]: x["v"] for x in r.mapInPandas(pick, "k long, v double").collect()}
    discard(c)
    out = []
    for g, (k, w) in zip(groups, want):
        q = [(p, found[k + math.floor(p)], found[k + math.ceil(p)]) for p in w]
        out.append((*[g[c] for c in by], [a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in q] or None))
    return df.sparkSession.createDataFrame(out, StructType([*[StructField(k, df.schema[k].dataType) for k in by], StructField(name, ArrayType(DoubleType()))]))
