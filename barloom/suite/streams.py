"""Streaming jobs over file streams, compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import news as nw
from barloom.session import fresh_path, settle
from barloom.sources import upsert as up
from barloom.sources.views import Views
from barloom.streaming import jobs
from barloom.suite.case import case
from barloom.suite.news import _AGG, _KEYS, _greedy, _shown
from barloom.suite.sql_views import with_views
from barloom.suite.tables import _SPLIT, _upsert_sql


def event_stream(v: Views):
    return jobs.file_stream(v.spark, v.folder, v.table("events").schema, "events.parquet")


@case("r01_streaming_sentiment", with_views(_AGG + " FROM sentiment_raw GROUP BY 1, 2", "sentiment_raw"))
def r01(v: Views):
    scored = event_stream(v).select(
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
        F.col("ts").alias("published_at"),
        F.col("event_type").alias("headline"),
        ((F.round(F.col("value") * 100) - 24500) / 24500).alias("sentiment_score"),
    )
    return _shown(jobs.run_streaming_sentiment(scored, fresh_path(v.spark, "sentiment")))


@case("r02_streaming_url_dedup", with_views(_KEYS + "SELECT DISTINCT norm_url FROM keyed", "articles"))
def r02_url(v: Views):
    """The stored articles as a file stream; one article per URL is left, all lie within the delay of each other."""
    rows = v.articles.select("article_id", "url", "published_at")
    path = fresh_path(v.spark, "articles")
    rows.write.parquet(path)
    stream = jobs.file_stream(v.spark, path, rows.schema)
    return jobs.run_streaming_url_dedup(stream, fresh_path(v.spark, "unique")).select("norm_url")


@case(
    "r02_streaming_dedup",
    with_views(
        _KEYS
        + _greedy("(SELECT *, (article_id % 3) * 1000000000 + article_id AS nth FROM keyed)", "nth")
        + "SELECT k.article_id, k.norm_url AS url FROM keyed k JOIN kept ON kept.nth % 1000000000 = k.article_id",
        "articles",
        recursive=True,
    ),
)
def r02(v: Views):
    """Three batches of articles, deduplicated by URL or headline against all batches before."""
    rows = v.articles.select("article_id", "headline", "url", "published_at")
    source = fresh_path(v.spark, "articles")
    accepted = fresh_path(v.spark, "accepted")
    for part in range(3):
        # Each run takes up the stream where the last one ended, and what is new is one batch.
        rows.filter(F.col("article_id") % 3 == part).write.mode("append").parquet(source)
        stream = jobs.file_stream(v.spark, source, rows.schema)
        out = jobs.run_streaming_dedup(stream, accepted, f"{accepted}-checkpoint")
    return out.select("article_id", "url")


@case("r03_streaming_upsert", with_views(_upsert_sql("bars", "date", up.BARS, [], {"close": "close * 2"}, _SPLIT), "bars"))
def r03(v: Views):
    """A stored table and a stream of new bars, upserted batch by batch."""
    stored, incoming = fresh_path(v.spark, "stored"), fresh_path(v.spark, "incoming")
    bars = v.bars
    up.upsert_table(v.spark, stored, bars.filter("date < date'1997-01-01'"), up.BARS)
    batch = bars.filter("date >= date'1996-01-01'").withColumn("close", F.col("close") * 2)
    batch.repartition(3).write.parquet(incoming)
    stream = jobs.file_stream(v.spark, incoming, batch.schema, files_per_batch=2)
    jobs.upsert_stream(stream, stored, up.BARS, fresh_path(v.spark, "checkpoint"), mode="append")
    return up.read_table(v.spark, stored)


@case(
    "r04_live_movers",
    """WITH q AS (SELECT event_type AS ticker, arg_max(value, (ts, event_id)) AS price, arg_min(value, (ts, event_id)) AS f, count(*) AS volume
               FROM events GROUP BY 1),
       p AS (SELECT ticker, price, price - f AS change, (price - f) / f * 100 AS change_percent, volume FROM q)
       SELECT *, 'top_active' AS ranking, row_number() OVER (ORDER BY volume DESC, ticker) AS rank FROM p UNION ALL
       SELECT *, 'top_advancers', row_number() OVER (ORDER BY change_percent DESC, ticker) FROM p UNION ALL
       SELECT *, 'top_decliners', row_number() OVER (ORDER BY change_percent, ticker) FROM p""",
)
def r04(v: Views):
    quotes = event_stream(v).select("event_id", F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"))
    return jobs.run_live_movers(quotes, fresh_path(v.spark, "movers"))
