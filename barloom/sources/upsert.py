"""Keyed upserts of the base tables.

An upsert is one aggregation over the union of both sides, not an outer join: per key the newest
values of the updated columns and the oldest values of the others. It has one shuffle, combines
before it, and a key that comes many times in a batch costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.assemble import require_columns


@dataclass(frozen=True)
class UpsertRule:
    """``updates`` are refreshed on conflict; all other columns keep the stored value."""

    keys: tuple[str, ...]
    updates: tuple[str, ...]


BARS = UpsertRule(("ticker", "date"), ("open", "high", "low", "close", "volume"))
SENTIMENT = UpsertRule(("ticker", "date"), ("sentiment_score", "article_count"))
FUNDAMENTALS = UpsertRule(("ticker", "report_date"), ("eps", "pe_ratio", "roe", "debt_to_equity", "book_value_per_share"))
DIVIDENDS = UpsertRule(("ticker", "ex_dividend_date"), ("dividend_amount",))
MARKET_INDEX = UpsertRule(("index_name", "date"), ("open", "high", "low", "close", "volume", "is_synthetic_index"))
#: A conflict refreshes the local series only; the four global ones keep what was stored first.
MACRO = UpsertRule(("date",), ("sbp_policy_rate", "is_synthetic_rate", "pkr_usd_rate", "brent_oil_price"))
MACRO_ALL = UpsertRule(("date",), (*MACRO.updates, "sp500_close", "nasdaq_close", "dxy_close", "us10y_yield"))


def upsert(stored: DataFrame, batch: DataFrame, rule: UpsertRule, order: str | None = None) -> DataFrame:
    """The table after the batch.

    A value of the batch replaces the stored one even when it is null. If a key comes more than
    once in the batch, the row with the greatest ``order`` wins; without it, or among equal ones,
    the row with the greatest updated values, column by column, so that a replay gives the same table.
    """
    require_columns(batch, rule.keys + rule.updates)
    columns = stored.columns
    kept = [c for c in columns if c not in rule.keys and c not in rule.updates]
    rank = F.struct(F.lit(1).alias("side"), (F.col(order) if order else F.lit(0)).alias("nth"))
    new = batch.withColumn("_rank", rank).select(
        *[c for c in batch.columns if c in columns], "_rank"
    )
    nth = new.schema["_rank"].dataType["nth"].dataType
    old = stored.withColumn("_rank", F.struct(F.lit(0).alias("side"), F.lit(None).cast(nth).alias("nth")))
    both = old.unionByName(new, allowMissingColumns=True)
    newest = F.struct("_rank.side", "_rank.nth", *rule.updates)
    aggs = [F.max_by(F.struct(*rule.updates), newest).alias("_new")]
    if kept:
        aggs.append(F.min_by(F.struct(*kept), "_rank").alias("_old"))
    merged = both.groupBy(*rule.keys).agg(*aggs)
    return merged.select(
        *[
            F.col(c) if c in rule.keys else F.col("_new" if c in rule.updates else "_old")[c].alias(c)
            for c in columns
        ]
    )


#: Partition of the rows without a date.
NO_MONTH = "none"


def upsert_table(
    spark: SparkSession, path: str, batch: DataFrame, rule: UpsertRule, date: str = "date", order: str | None = None
) -> None:
    """Upsert into a Parquet table partitioned by month; only the months of the batch are rewritten.

    The months of a batch are bounded by the calendar. Spark stages the new partitions and swaps
    them in at commit, so a failed job leaves the table as it was; applying a batch twice gives the
    same table as applying it once. Rows without a date share one partition of their own.
    """
    if "_month" in batch.columns:
        raise ValueError("column name _month is reserved")
    month = F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(NO_MONTH))
    named = batch.withColumn("_month", month)
    if not table_exists(spark, path):
        empty = spark.createDataFrame([], batch.schema)
        result = upsert(empty, batch, rule, order)
    else:
        months = [r[0] for r in named.select("_month").distinct().collect()]
        stored = spark.read.parquet(path)
        stored = stored.filter(F.col("_month").isin(months)).drop("_month")
        result = upsert(stored, batch, rule, order)
    (
        result.withColumn("_month", month)
        .hint("rebalance", "_month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("_month")
        .parquet(path)
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_month")


def append_articles(articles: DataFrame, path: str) -> None:
    """Raw articles have no key; they are deduplicated before and simply added."""
    articles.write.mode("append").parquet(path)


def active_universe(meta: DataFrame) -> DataFrame:
    return meta.filter("is_active").select("ticker", "company_name", "sector").orderBy("ticker")


def known_tickers(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose upper-cased ticker belongs to the universe."""
    return rows.withColumn("ticker", F.upper("ticker")).join(universe.select("ticker"), "ticker", "left_semi")


def sync_completeness(universe: DataFrame, categories: dict[str, DataFrame]) -> DataFrame:
    """Per category, how many tickers of the universe have rows, and the sorted list of those without.

    The list is a report over the dimension table; each category contributes one row per ticker.
    """
    report = None
    for name, table in categories.items():
        have = table.select("ticker").distinct().withColumn("_have", F.lit(True))
        df = universe.select("ticker").join(have, "ticker", "left")
        row = df.agg(
            F.lit(name).alias("category"),
            F.count("*").alias("target"),
            F.count("_have").alias("successes"),
            F.count_if(F.col("_have").isNull()).alias("failures"),
            F.sort_array(F.collect_list(F.when(F.col("_have").isNull(), F.col("ticker")))).alias("failed_tickers"),
        )
        report = row if report is None else report.unionByName(row)
    return report
