"""Structured Streaming forms of the polling jobs.

State is bounded by a watermark where the key set grows with time, and by the ticker universe where
it does not. Every sink is idempotent, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.text import normalized_url
from barloom.operators.news import dedup_first_wins
from barloom.operators.serve import market_movers
from barloom.session import fresh_path
from barloom.sources.upsert import SENTIMENT, UpsertRule, upsert_table

LATE_NEWS = "7 days"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def streaming_sentiment(scored: DataFrame) -> DataFrame:
    """Daily sentiment per ticker over a stream of scored articles.

    The trading day is a tumbling window that starts at 11:00 UTC, and its date is the day the
    window ends on. Because the key is a time window, the watermark evicts finished days.
    """
    stamped = scored.withColumn("published_at", F.col("published_at").cast("timestamp")).withWatermark("published_at", LATE_NEWS)
    day = F.window("published_at", "1 day", "1 day", "11 hours")
    return (
        stamped.groupBy("ticker", day.alias("day"))
        .agg(F.avg("sentiment_score").alias("sentiment_score"), F.count("headline").cast("int").alias("article_count"))
        .select("ticker", F.to_date("day.end").alias("date"), "sentiment_score", "article_count")
    )


def upsert_stream(
    rows: DataFrame, path: str, rule: UpsertRule, checkpoint: str, date: str = "date", mode: str = "update", order: str | None = None
):
    """Write a stream into a keyed table; each micro-batch is one upsert of the months it touches.

    ``order`` decides between rows of one key inside a micro-batch. A micro-batch is computed once and
    kept while it is applied.
    """

    def apply(batch: DataFrame, _batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                upsert_table(batch.sparkSession, path, batch, rule, date, order)
        finally:
            batch.unpersist()

    return run_available(rows.writeStream.outputMode(mode).foreachBatch(apply), checkpoint)


def run_streaming_sentiment(scored: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Run what is available and return the daily table."""
    spark = scored.sparkSession
    upsert_stream(streaming_sentiment(scored), path, SENTIMENT, checkpoint or fresh_path(spark, "checkpoint"))
    return spark.read.parquet(path).drop("_month")


def streaming_dedup(articles: DataFrame, delay: str = LATE_NEWS) -> DataFrame:
    """Drop articles whose normalised URL was seen within the watermark delay: one key, state in the stream."""
    stamped = articles.withColumn("published_at", F.col("published_at").cast("timestamp"))
    keyed = stamped.withWatermark("published_at", delay).withColumn("norm_url", normalized_url("url"))
    return keyed.dropDuplicatesWithinWatermark(["norm_url"])


class AcceptedArticles:
    """Articles accepted so far, one folder per micro-batch: the state of the deduplication by two keys.

    Whether an article is admitted depends on its URL and on its headline at once, and a rejected one
    registers neither. State that is kept per key inside a stream cannot say that, since each key would
    have to know the verdict on the other; so the accepted keys are a table, and each micro-batch is one exact
    ordered pass over its rows behind those keys.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str | None = None):
        """``keep``: how long before the newest article of a batch its keys still count, e.g. ``7 days``; else for good."""
        self.spark, self.path, self.keep = spark, path, keep

    def _earlier(self, batch_id: int) -> DataFrame | None:
        """Accepted articles of complete batches before this one; a replayed batch does not meet itself."""
        pattern = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        folders = sorted(s.getPath().getParent().toString() for s in found)
        before = [f for f in folders if int(f.rsplit("-", 1)[1]) < batch_id]
        return self.spark.read.parquet(*before) if before else None

    def add(self, batch: DataFrame, batch_id: int, order: str = "article_id") -> None:
        """Write what the batch adds; a replay writes the same rows to the same folder."""
        stored = self._earlier(batch_id)
        if stored is not None and self.keep is not None:
            newest = batch.agg(F.max("published_at").alias("newest")).first()["newest"]
            if newest is not None:
                stored = stored.filter(F.col("published_at") >= F.lit(newest) - F.expr(f"interval {self.keep}"))
        dedup_first_wins(batch, order, stored).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id:012d}")

    def all(self) -> DataFrame:
        earlier = self._earlier(1 << 62)
        if earlier is None:
            raise ValueError(f"no batch has been accepted below {self.path}")
        return earlier


def run_streaming_dedup(
    articles: DataFrame, path: str, checkpoint: str | None = None, order: str = "article_id", keep: str | None = None
) -> DataFrame:
    """First article of each URL or headline over the whole stream, whatever batches it comes in.

    Within a batch articles are taken by ``order``, batches as they come. The result equals
    :func:`barloom.operators.news.dedup_first_wins` over the batches one after the other.
    """
    spark = articles.sparkSession
    accepted = AcceptedArticles(spark, path, keep)

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            accepted.add(batch, batch_id, order)
        finally:
            batch.unpersist()

    run_available(articles.writeStream.outputMode("append").foreachBatch(apply), checkpoint or fresh_path(spark, "checkpoint"))
    return accepted.all()


def run_streaming_url_dedup(articles: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """One article of each URL within the watermark's delay, with state that the stream evicts by itself."""
    spark = articles.sparkSession
    writer = streaming_dedup(articles).writeStream.outputMode("append").format("parquet").option("path", path)
    run_available(writer, checkpoint or fresh_path(spark, "checkpoint"))
    return spark.read.parquet(path)


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """First and latest price and number of quotes per ticker; the state is one row per ticker."""
    return quotes.groupBy("ticker").agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("price"),
        F.min_by("price", F.struct("ts", "event_id")).alias("_first"),
        F.count("*").alias("volume"),
    )


def run_live_movers(quotes: DataFrame, path: str, checkpoint: str | None = None, k: int | None = None) -> DataFrame:
    """Rank the latest quotes after each micro-batch into a folder of its own; see :func:`newest_rankings`."""
    spark = quotes.sparkSession

    def rank(batch: DataFrame, batch_id: int) -> None:
        change = F.col("price") - F.col("_first")
        rows = batch.select(
            "ticker", "price", change.alias("change"), (F.try_divide(change, F.col("_first")) * 100).alias("change_percent"), "volume"
        )
        # A replayed batch rewrites its own folder; readers stay on the last complete one meanwhile.
        market_movers(rows, k).write.mode("overwrite").parquet(f"{path}/batch-{batch_id:012d}")
        for old in _complete(spark, path)[:-2]:
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    writer = latest_quotes(quotes).writeStream.outputMode("complete").foreachBatch(rank)
    run_available(writer, checkpoint or fresh_path(spark, "checkpoint"))
    return newest_rankings(spark, path)


def _complete(spark: SparkSession, path: str) -> list:
    """Folders of finished batches, oldest first."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted((s.getPath().getParent() for s in found), key=lambda p: p.getName())


def newest_rankings(spark: SparkSession, path: str) -> DataFrame:
    """The rankings of the last batch that was written completely."""
    return spark.read.parquet(_complete(spark, path)[-1].toString())
