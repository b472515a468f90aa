"""Data-quality gates. A gate is a DataFrame of violating rows; none means it passes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERROR, WARNING, PASS = 1, 2, 0


@dataclass
class Gate:
    """``id`` names the gate, ``rows`` violate it; ``severity`` is the code if there are any, unless a contract overrides it."""

    id: str
    rows: DataFrame
    severity: int = ERROR

    def sample(self, n: int = 5):
        return self.rows.limit(n).collect()


def summary(spark: SparkSession, gates: list[Gate], overrides: dict[str, int] | None = None) -> DataFrame:
    """(gate, violations, code) of every gate, all counted in one job."""
    out = None
    for g in gates:
        sev = (overrides or {}).get(g.id, g.severity)
        one = g.rows.agg(F.count("*").alias("violations")).select(F.lit(g.id).alias("gate"), "violations", F.when(F.col("violations") == 0, PASS).otherwise(sev).cast("long").alias("code"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "gate string, violations long, code long")


@dataclass
class Contract:
    """What a source promises: column types, renames, grain, sentinels, allowed values, units."""

    columns: dict[str, str]
    grain: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)
    sentinels: dict[str, tuple] = field(default_factory=dict)
    domains: dict[str, tuple] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()


def contract_columns(df: DataFrame, c: Contract) -> DataFrame:
    """Q01: columns missing from or not in the contract, after renames."""
    have = {c.renames.get(x, x) for x in df.columns}
    rows = [(x, "missing") for x in c.columns if x not in have] + [(x, "extra") for x in sorted(have - set(c.columns))]
    return df.sparkSession.createDataFrame(rows, "column string, problem string")


def apply_contract(df: DataFrame, c: Contract) -> DataFrame:
    """Renamed, sentinels null, types cast without raising (loss is a gate of its own)."""
    for old, new in c.renames.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    for col, values in c.sentinels.items():
        df = df.withColumn(col, F.when(~F.col(col).isin(*values), F.col(col)))
    return df.select(*[F.col(n).try_cast(t).alias(n) for n, t in c.columns.items() if n in df.columns])


def grain_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q17."""
    return df.groupBy(*keys).count().where("count > 1")


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def in_domain(df: DataFrame, col: str, values: tuple) -> DataFrame:
    """Q23: values outside the list; a null isn't outside."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*values))


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Q16/Q20: keys without a parent, nulls left to the not-null gate."""
    p = parent.select(F.col(parent_key).alias("_p")).distinct()
    return df.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti")


def cast_loss(df: DataFrame, col: str, type_: str) -> DataFrame:
    """Q18: texts that aren't blank but don't cast."""
    return df.where((F.trim(col) != "") & F.col(col).try_cast(type_).isNull())


def sentinel_suspects(df: DataFrame, key: str, col: str) -> DataFrame:
    """Q10: a value that occurs exactly once for every key."""
    n = df.select(F.countDistinct(key).alias("n"))
    v = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
    return v.crossJoin(F.broadcast(n)).where("rows = n and keys = n and n > 1").select(col, "rows")


def history_faults(dim: DataFrame, key: str) -> DataFrame:
    """Q07: overlaps, gaps and keys without exactly one current row."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("valid_from")
    nxt = dim.withColumn("_n", F.lead("valid_from").over(w))
    fault = F.when(F.col("valid_to") > F.col("_n"), "overlap").when(F.col("valid_to") < F.col("_n"), "gap").when(F.col("_n").isNotNull() & F.col("valid_to").isNull(), "overlap")
    a = nxt.select(key, fault.alias("fault")).where("fault is not null")
    b = dim.groupBy(key).agg(F.sum(F.col("is_current").cast("int")).alias("n")).where("n <> 1").select(key, F.lit("current").alias("fault"))
    return a.unionByName(b)


def null_drift(before: DataFrame, after: DataFrame, cols: list[str], most: float = 0.2) -> DataFrame:
    """Q02: columns whose share of nulls moved by more than ``most`` between two loads."""
    rate = lambda d: d.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    a, b = (rate(d).unpivot([], cols, "column", v) for d, v in ((before, "was"), (after, "now")))
    return a.join(b, "column").where(F.abs(F.col("now") - F.col("was")) > most)


def restated(facts: DataFrame, keys: list[str], value: str, as_of: str, most: float = 0.05) -> DataFrame:
    """Q05: first against latest report of a figure."""
    g = facts.groupBy(*keys).agg(F.min_by(value, as_of).alias("first_value"), F.max_by(value, as_of).alias("last_value"))
    return g.where(F.abs(F.col("last_value") - F.col("first_value")) > most * F.abs("first_value"))


def unmapped(df: DataFrame, col: str, mapping: DataFrame, most: float = 0.01) -> DataFrame:
    """Q06: values without a mapping, if they are more than ``most`` of the rows."""
    m = mapping.select(F.col(col).alias("_m")).distinct()
    t = df.groupBy(col).count().join(m, F.col(col) == F.col("_m"), "left")
    from pyspark.sql import Window

    w = Window.partitionBy()
    share = F.sum(F.when(F.col("_m").isNull(), F.col("count")).otherwise(0)).over(w) / F.sum("count").over(w)
    return t.withColumn("share", share).where(F.col("_m").isNull() & (F.col("share") > most)).select(col, "count", "share")


def spelling_variants(df: DataFrame, col: str) -> DataFrame:
    """Q06: values that only differ by case, spaces, hyphens or underscores."""
    norm = F.regexp_replace(F.lower(F.trim(col)), r"[\s_-]+", "")
    return df.select(col, norm.alias("norm")).distinct().groupBy("norm").agg(F.sort_array(F.collect_list(col)).alias("variants")).where(F.size("variants") > 1)


def hour_shift(before: DataFrame, after: DataFrame, ts: str, hours: int = 8) -> DataFrame:
    """Q03: the hour-of-day profile fits better shifted by ``hours`` than as it is."""
    prof = lambda d, n: d.groupBy(F.hour(ts).alias("h")).agg(F.count("*").alias(n))
    a, b = prof(before, "a"), prof(after, "b")
    same = a.join(b, "h").agg(F.corr("a", "b").alias("same"))
    moved = a.withColumn("h", (F.col("h") + hours) % 24).join(b, "h").agg(F.corr("a", "b").alias("moved"))
    return same.crossJoin(moved).where("moved > same")


def test_transactions(pos: DataFrame, members: tuple, terminals: tuple, least: float = 10.0) -> DataFrame:
    """Q22: rows with the reasons why they look like tests of a till."""
    reasons = F.array_compact(F.array(F.when(F.col("amount") <= least, F.lit("amount")), F.when(F.col("member_id").isin(*members), F.lit("member")), F.when(F.col("terminal_id").isin(*terminals), F.lit("terminal"))))
    return pos.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def quarantine(df: DataFrame, suspect) -> tuple[DataFrame, DataFrame]:
    """(clean, suspect) rows; nothing is deleted."""
    bad = F.coalesce(suspect, F.lit(False))
    return df.where(~bad), df.where(bad)


def zero_denominators(df: DataFrame, key: str, denominator: str) -> DataFrame:
    """Q11."""
    return df.where(F.col(denominator).isNull() | (F.col(denominator) == 0)).select(key, denominator)


def crosses_change(trends: DataFrame, changes: DataFrame) -> DataFrame:
    """Q12: trends (metric, first_day, last_day) with a change of measurement (scope, change_date) inside."""
    on = (F.col("metric") == F.col("scope")) & (F.col("change_date") > F.col("first_day")) & (F.col("change_date") <= F.col("last_day"))
    return trends.join(changes, on)


def outside_hours(pos: DataFrame, hours: DataFrame) -> DataFrame:
    """Q13: transactions (store, ts) outside the store's opening hours (store, opens, closes), closing after midnight allowed."""
    h = F.hour("ts")
    inside = F.when(F.col("opens") <= F.col("closes"), (h >= F.col("opens")) & (h < F.col("closes"))).otherwise((h >= F.col("opens")) | (h < F.col("closes")))
    return pos.join(hours, "store").where(~inside)


def totals_differ(a: DataFrame, b: DataFrame, key: str, value: str, most: float = 0.01) -> DataFrame:
    """Q24: keys whose totals in two sources differ by ``most`` or more, or that only one has."""
    x, y = (d.groupBy(key).agg(F.sum(value).alias(n)) for d, n in ((a, "one"), (b, "other")))
    j = x.join(y, key, "full_outer")
    return j.where(F.col("one").isNull() | F.col("other").isNull() | (F.abs(F.col("one") - F.col("other")) >= most * F.greatest(F.abs("one"), F.abs("other"), F.lit(1e-12))))


def rows_grown(before: DataFrame, after: DataFrame) -> DataFrame:
    """A join that multiplied rows."""
    return before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).where("after > before")


def card_dates(customers: DataFrame, cards: DataFrame, as_of: str) -> DataFrame:
    """Q26: a first-card date after the earliest opening; cards expired at ``as_of`` or without a limit."""
    first = cards.groupBy("customer").agg(F.min("open_date").alias("earliest"))
    a = customers.join(first, "customer").where(F.col("first_card") > F.col("earliest")).select("customer", F.lit("first card").alias("fault"))
    b = cards.where(F.col("expiry_date") < F.lit(as_of).cast("date")).select("customer", F.lit("expired").alias("fault"))
    return a.unionByName(b).unionByName(cards.where("card_limit = 0").select("customer", F.lit("no limit").alias("fault")))


def ambiguous_keys(df: DataFrame, parts: list[str]) -> DataFrame:
    """Q27: different parts that are one text when put together without a separator."""
    d = df.select(*parts).distinct().withColumn("glued", F.concat(*[F.col(p).cast("string") for p in parts]))
    return d.groupBy("glued").count().where("count > 1")


def invariants(features: DataFrame) -> DataFrame:
    """Q25 on customer features: recency not negative, days within transactions, intervals one less than days."""
    bad = (F.col("r_days") < 0) | (F.col("f_days") > F.col("f_txn")) | (F.col("n_intervals") != F.col("f_days") - 1)
    return features.where(bad)
