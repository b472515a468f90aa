"""Text, sessions and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import text
from brindle.plans.base import Book
from brindle.streaming import sessions
from brindle.tables import load

book = Book()
_W = "regexp_extract_all(lower(text), '\\p{L}+')"
_DOCS = "d AS (SELECT doc_id AS doc, text, quality AS cls FROM documents JOIN labels USING (doc_id))"
_DF = f"w AS (SELECT DISTINCT doc, cls, unnest({_W}) AS w FROM d), n AS (SELECT count(*)::DOUBLE AS n, sum(cls)::DOUBLE AS n1 FROM d), f AS (SELECT w, sum(cls)::DOUBLE AS df, count(*)::DOUBLE AS df_all FROM w GROUP BY w)"


def _labelled(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("doc"), "text", F.col("quality").alias("cls"))


@book.query(f"""WITH {_DOCS}, {_DF}, x AS (SELECT w, df, df_all, df / n1 AS share, (df / n1) / (df_all / n) AS lift, n * power(df * (n - n1 - df_all + df) - (df_all - df) * (n1 - df), 2) / nullif(df_all * (n - df_all) * n1 * (n - n1), 0) AS chi2, df / n1 * ln(n / df_all) AS tfidf FROM f, n WHERE df >= 2), k AS (SELECT * FROM x WHERE lift > 1 AND chi2 > 0),
r AS (SELECT *, share / max(share) OVER () AS a, lift / max(lift) OVER () AS b, chi2 / max(chi2) OVER () AS c, tfidf / max(tfidf) OVER () AS e FROM k)
SELECT w, df, df_all, round(lift, 6) AS lift, round(chi2, 6) AS chi2, round((0.25 * a + 0.30 * b + 0.30 * c + 0.15 * e) * least(1, df / 3) * least(1, df_all / 5) + 0.05 * greatest((a >= 0.5)::INT + (b >= 0.5)::INT + (c >= 0.5)::INT + (e >= 0.5)::INT - 1, 0), 6) AS score FROM r""")
def keyword_scores(spark, d):
    k = text.keyword_scores(_labelled(spark, d))
    return k.withColumns({c: F.round(c, 6) for c in ("lift", "chi2", "score")})


@book.query(f"""WITH {_DOCS}, {_DF} SELECT w, df, df_all, round(log10(df * n / (df_all * n1)) - log10(n), 6) AS mi FROM f, n WHERE df > 0""")
def word_association(spark, d):
    return text.association(_labelled(spark, d)).withColumn("mi", F.round("mi", 6))


@book.query(f"""WITH t AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({_W}) AS w FROM documents) GROUP BY 1, 2), g AS (SELECT count(DISTINCT lang) AS g FROM t), f AS (SELECT w, count(*) AS df FROM t GROUP BY w), s AS (SELECT lang, sum(n)::BIGINT AS size FROM t GROUP BY 1), x AS (SELECT lang, w, n, n / size * ln((1.0 + g) / (1 + df)) AS v FROM t JOIN f USING (w) JOIN s USING (lang), g), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(v, 12) DESC, w) AS rank FROM x)
SELECT lang, rank, w, n, round(v, 10) AS tfidf FROM r WHERE rank <= 200""")
def tfidf_top(spark, d):
    """The 200 words of each language of highest weight (the report is a top list)."""
    return text.tfidf(load(spark, d, "documents"), "lang", 200).withColumn("tfidf", F.round("tfidf", 10))


@book.query(f"""WITH s AS (SELECT doc_id, {_W} AS s FROM documents), g AS (SELECT doc_id, s[i] || ' ' || s[i + 1] || ' ' || s[i + 2] AS gram FROM s, LATERAL (SELECT unnest(range(1, len(s) - 1)) AS i) WHERE len(s) >= 3)
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram HAVING count(*) >= 5""")
def ngram_counts(spark, d):
    return text.ngrams(load(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), 3, 5)


@book.query("""WITH l AS (SELECT *, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum((p IS NULL OR ts - p >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, s""")
def sessions_basic(spark, d):
    """Idle rule only."""
    e = load(spark, d, "events")
    return sessions.idle_sessions(e, "user_id", "ts", "30 minutes").agg(F.min("ts").alias("started"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select("user_id", "started", "n", "value")


@book.query("""WITH e AS (SELECT *, CAST(ts - INTERVAL 6 HOUR AS DATE) AS biz, json_extract_string(props, '$.campaign') AS utm FROM events), l AS (SELECT *, lag(ts) OVER w AS p, lag(biz) OVER w AS pb, lag(utm) OVER w AS pu FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN p IS NULL THEN 'start' WHEN ts - p > INTERVAL 30 MINUTE THEN 'idle' WHEN biz <> pb THEN 'day' WHEN utm IS DISTINCT FROM pu THEN 'utm' END AS cut FROM l) SELECT cut, count(*) AS n, count(DISTINCT user_id) AS users FROM c WHERE cut IS NOT NULL GROUP BY cut""")
def sessions_full_rule(spark, d):
    """Cuts at 30 idle minutes, at the business date and at a change of campaign, over all events (flagged bots are the caller's to leave out)."""
    e = load(spark, d, "events").withColumn("utm", F.get_json_object("props", "$.campaign"))
    s = sessions.cut(e, "user_id", "ts", "event_id", 30, 6, ["utm"])
    return s.where("cut is not null").groupBy("cut").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@book.query("""WITH v AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT e.user_id, min(ts) AS t FROM events e JOIN v USING (user_id) WHERE event_type = 'click' AND ts > v.t GROUP BY 1), p AS (SELECT e.user_id, min(ts) AS t FROM events e JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > c.t GROUP BY 1)
SELECT (SELECT count(*) FROM v) AS viewed, (SELECT count(*) FROM c) AS clicked, (SELECT count(*) FROM p) AS purchased""")
def funnel_steps(spark, d):
    return sessions.funnel(load(spark, d, "events"), "user_id", "ts", "event_type", ["view", "click", "purchase"]).toDF("viewed", "clicked", "purchased")


@book.query("""WITH u AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), q AS (SELECT quantile_cont(n, 0.999) AS q FROM u) SELECT day, count(*) AS users, sum((n > q)::INT)::BIGINT AS suspects, round(sum(CASE WHEN n > q THEN n ELSE 0 END) / sum(n), 6) AS share FROM u, q GROUP BY day""")
def bot_flags(spark, d):
    return sessions.bot_share(load(spark, d, "events"), "user_id", "ts", 0.999).withColumn("share", F.round("share", 6))


@book.query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, d):
    e = load(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n", "v")


@book.query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""")
def streamed_daily_counts(spark, d):
    """The daily counts by way of a stream with a watermark, read once over the whole table."""
    return sessions.stream_daily(spark, f"{d}/events.parque[t]")  # a pattern: the table may be one file or a folder
