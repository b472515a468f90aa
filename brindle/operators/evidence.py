"""Gates on results: what a claim may say, given the checks behind it. Each returns violating rows, or the level that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAUSAL = r"(?i)\b(cause[sd]?|leads? to|led to|drives?|drove|results? in|because of|thanks to|boost(s|ed)?)\b"


def levels(claims: DataFrame) -> DataFrame:
    """The stated level, lowered to what its checks carry, with the reason."""
    exp = (F.col("stated") == "experiment") & F.col("has_control") & F.col("randomised")
    quasi = F.col("stated").isin("experiment", "quasi-experiment") & F.col("has_control")
    pred = (F.col("stated") != "correlation") & F.col("out_of_time")
    level = F.when(exp, "experiment").when(quasi, "quasi-experiment").when(pred, "prediction").otherwise("correlation")
    why = F.when(level == F.col("stated"), F.lit(None)).when(~F.col("has_control"), "no control group").when(~F.col("randomised"), "not randomised").otherwise("no out-of-time check")
    return claims.withColumn("level", level).withColumn("reason", why)


def causal_words(claims: DataFrame, text: str = "text") -> DataFrame:
    """Causal verbs in claims that are correlations."""
    return claims.where((F.col("level") == "correlation") & F.col(text).rlike(CAUSAL))


def rates_of_retrospective(results: DataFrame) -> DataFrame:
    """A retrospective sample has no rates, only odds ratios."""
    return results.where((F.col("design") == "retrospective") & F.col("metric").rlike("(?i)rate|ratio|share|percent") & ~F.col("metric").rlike("(?i)odds"))


def tests_of_inputs(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Clustering inputs that carry a p-value, effect size or interval."""
    return results.where("p_value is not null or effect is not null or ci_low is not null").join(inputs, "variable", "left_semi")


def without_mde(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Results that aren't significant and don't say what they could have found."""
    return results.where((F.col("p_value") >= alpha) & F.col("mde").isNull())


def default_errors(models: DataFrame) -> DataFrame:
    """Default standard errors on data that isn't one row a customer."""
    return models.where((F.col("grain") != "customer") & (F.col("cov_type") == "nonrobust"))


def missing_record(results: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Results without the record (sensitivity, scan, decomposition, sizing) that must go with them."""
    return results.join(records, key, "left_anti")


def not_for_sizing(groups: DataFrame) -> DataFrame:
    """Fewer than 30, one customer above 20 %, or an interval wider than the median."""
    return groups.where("n < 30 or top1_share > 0.2 or ci_high - ci_low > median")


def small_clusters(sizes: DataFrame) -> DataFrame:
    """Clusters below the larger of 30 and 5 % of all."""
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).where(F.col("n") < F.greatest(F.lit(30.0), 0.05 * F.col("total")))


def corrected_twice(results: DataFrame) -> DataFrame:
    """A multiplicity correction on top of a method that has one."""
    return results.where(F.col("method").isin("tukey", "games-howell", "dunnett") & F.col("p_adjusted").isNotNull())


def unsorted(priorities: DataFrame, value: str = "net_value", rank: str = "rank") -> DataFrame:
    """Rows of a priority table that stand above a better one."""
    from pyspark.sql import Window

    return priorities.withColumn("_above", F.lag(value).over(Window.orderBy(rank))).where(F.col("_above") < F.col(value)).drop("_above")


def chart_limits(chart: DataFrame, series: str, most: int = 5) -> DataFrame:
    """A chart frame with more series than can be told apart."""
    return chart.agg(F.countDistinct(series).alias("series")).where(F.col("series") > most)
