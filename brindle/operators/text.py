"""Keywords of a class of texts, term weights, n-grams. Inputs are (doc, text[, cls]) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import ratio


def words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row a word: runs of lower-case letters of any script."""
    return docs.select(*keep, F.explode(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}+)', 1)")).alias("w"))


def keyword_scores(docs: DataFrame, least_df: int = 2) -> DataFrame:
    """Words of class 1 (cls) against all documents: a composite of document share, lift, chi-square and length-free tf-idf, each relative to
    its largest, with the support penalty min(1, df/3) min(1, df_all/5) and 0.05 for each further method that ranks it in its top 100.
    Only words with df >= 2, lift > 1 and chi-square > 0 are kept."""
    n = docs.agg(F.count("*").cast("double").alias("n"), F.sum("cls").cast("double").alias("n1"))
    df = words(docs, ["doc", "cls"]).distinct().groupBy("w").agg(F.sum("cls").cast("double").alias("df"), F.count("*").cast("double").alias("df_all"))
    x = df.crossJoin(F.broadcast(n)).where(F.col("df") >= least_df)
    share, lift = F.col("df") / F.col("n1"), (F.col("df") / F.col("n1")) / (F.col("df_all") / F.col("n"))
    a, b, c = F.col("df"), F.col("df_all") - F.col("df"), F.col("n1") - F.col("df")
    e = F.col("n") - F.col("n1") - b
    chi = ratio(F.col("n") * (a * e - b * c) * (a * e - b * c), (a + b) * (c + e) * (a + c) * (b + e))
    x = x.select("w", "df", "df_all", share.alias("share"), lift.alias("lift"), chi.alias("chi2"), (share * F.ln(F.col("n") / F.col("df_all"))).alias("tfidf")).where("lift > 1 and chi2 > 0")
    top = x.agg(*[F.max(k).alias(f"top_{k}") for k in ("share", "lift", "chi2", "tfidf")])
    x = x.crossJoin(F.broadcast(top))
    part = {k: F.col(k) / F.col(f"top_{k}") for k in ("share", "lift", "chi2", "tfidf")}
    methods = sum(((v >= 0.5).cast("int") for v in part.values()), F.lit(0))
    base = 0.25 * part["share"] + 0.30 * part["lift"] + 0.30 * part["chi2"] + 0.15 * part["tfidf"]
    score = base * F.least(F.lit(1.0), F.col("df") / 3) * F.least(F.lit(1.0), F.col("df_all") / 5) + 0.05 * F.greatest(methods - 1, F.lit(0))
    return x.select("w", "df", "df_all", "lift", "chi2", score.alias("score"))


def tfidf(docs: DataFrame, group: str, top: int) -> DataFrame:
    """The ``top`` words of each group by term share times inverse document frequency over groups, ties by word."""
    tf = words(docs, [group]).groupBy(group, "w").agg(F.count("*").alias("n"))
    groups = tf.agg(F.countDistinct(group).alias("g"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    size = tf.groupBy(group).agg(F.sum("n").alias("size"))
    x = tf.join(df, "w").join(size, group).crossJoin(F.broadcast(groups)).withColumn("tfidf", F.col("n") / F.col("size") * F.ln((1 + F.col("g")) / (1 + F.col("df"))))
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("tfidf", 12)), "w"))
    return x.withColumn("rank", r.cast("long")).where(F.col("rank") <= top).select(group, "rank", "w", "n", "tfidf")


def ngrams(docs: DataFrame, n: int, least: int) -> DataFrame:
    """Runs of ``n`` words that occur ``least`` times or more, in how many documents."""
    seq = docs.select("doc", F.expr(r"regexp_extract_all(lower(text), '(\\p{L}+)', 1)").alias("s")).where(F.size("s") >= n)
    g = seq.select("doc", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - n), lambda i: F.array_join(F.slice("s", i + 1, n), " "))).alias("gram"))
    # (gram, document) first, so that a frequent gram is counted in parts
    per = g.groupBy("gram", "doc").agg(F.count("*").alias("k"))
    return per.groupBy("gram").agg(F.sum("k").alias("n"), F.count("*").alias("docs")).where(F.col("n") >= least)


def association(docs: DataFrame, n_classes_col: str = "cls") -> DataFrame:
    """Mutual information log10(lift) - log10(N) of words and class 1."""
    n = docs.agg(F.count("*").cast("double").alias("n"), F.sum(n_classes_col).cast("double").alias("n1"))
    df = words(docs, ["doc", n_classes_col]).distinct().groupBy("w").agg(F.sum(n_classes_col).cast("double").alias("df"), F.count("*").cast("double").alias("df_all"))
    x = df.where("df > 0").crossJoin(F.broadcast(n))
    lift = F.col("df") * F.col("n") / (F.col("df_all") * F.col("n1"))
    return x.select("w", "df", "df_all", (F.log10(lift) - F.log10("n")).alias("mi"))
