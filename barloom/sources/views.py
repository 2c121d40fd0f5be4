"""Market views derived from the given tables.

The given tables hold no market data, so each view restates some of them as bars, events or
articles. Prices are whole cents (integer-valued doubles): sums of them are exact in any order, so
a distributed sum and a serial one agree to the last bit.

Every raw side is aggregated per (ticker, date) with map-side combine before anything is windowed,
so a hot supplier, customer or day costs one partial aggregate per task and nothing more.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import settle

#: Sector names of the regions; two of them pass the energy gate.
SECTOR_OF_REGION = {"AFRICA": "Oil & Gas Exploration", "ASIA": "Power Generation & Distribution"}


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100)


class Views:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_suppliers(self) -> int:
        return self.table("supplier").count()

    def _bars(self, lines: DataFrame) -> DataFrame:
        order = F.struct("l_orderkey", "l_linenumber", "px")
        return (
            lines.withColumn("px", cents("l_extendedprice"))
            .withColumn("date", F.to_date("l_shipdate"))
            .groupBy("ticker", "date")
            .agg(
                F.min_by("px", order).alias("open"),
                F.max("px").alias("high"),
                F.min("px").alias("low"),
                F.max_by("px", order).alias("close"),
                F.sum("l_quantity").cast("long").alias("volume"),
            )
        )

    @property
    def bars(self) -> DataFrame:
        lines = self.table("lineitem").withColumn("ticker", F.concat(F.lit("S"), F.col("l_suppkey")))
        return self._bars(lines)

    @cached_property
    def stored_bars(self) -> DataFrame:
        """The bars as a stored base table, for jobs that read them more than once."""
        return settle(self.bars, "bars")

    @cached_property
    def stored_macro(self) -> DataFrame:
        return settle(self.macro, "macro")

    @property
    def bars_dense(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.col("p_type").alias("ticker"))
        lines = self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
        return self._bars(lines)

    @property
    def meta(self) -> DataFrame:
        sector = F.col("r_name")
        for region, name in SECTOR_OF_REGION.items():
            sector = F.when(F.col("r_name") == region, name).otherwise(sector)
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
                F.col("s_name").alias("company_name"),
                sector.alias("sector"),
                (F.col("s_acctbal") > 0).alias("is_active"),
            )
        )

    @property
    def orders_of_tickers(self) -> DataFrame:
        return self.table("orders").select(
            F.concat(F.lit("S"), F.col("o_custkey") % self.n_suppliers).alias("ticker"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            cents("o_totalprice").alias("px"),
        )

    @property
    def macro_long(self) -> DataFrame:
        """One (series, date, close) row per order priority and day."""
        name = F.create_map(*[F.lit(x) for pair in MACRO_SERIES.items() for x in pair])
        orders = self.table("orders")
        day = F.to_date("o_orderdate").alias("date")
        series = orders.select(name[F.col("o_orderpriority")].alias("series"), day, cents("o_totalprice").alias("px"))
        every = orders.select(F.lit("us10y_yield").alias("series"), day, (cents("o_totalprice")).alias("px"))
        return series.unionByName(every).groupBy("series", "date").agg(F.avg("px").alias("close"))

    @property
    def macro(self) -> DataFrame:
        """The assembled macro table with a policy rate that changes every year."""
        from barloom.sources.assemble import macro_table

        return macro_table(self.macro_long, F.lit(20.0) + F.year("date") % 3)

    @property
    def dividends(self) -> DataFrame:
        return (
            self.orders_of_tickers.filter("priority = '1-URGENT'")
            .groupBy("ticker", F.col("date").alias("ex_dividend_date"))
            .agg((F.max("px") / 1e6).alias("dividend_amount"))
            .withColumn("dividend_type", F.lit("Cash"))
        )

    @property
    def fundamentals(self) -> DataFrame:
        quarter_end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))
        return (
            self.orders_of_tickers.groupBy("ticker", quarter_end.alias("report_date"))
            .agg(
                (F.avg("px") / 1e7 - 1.0).alias("eps"),
                (F.avg(F.when(F.col("status") == "F", F.col("px"))) / 1e8).alias("roe"),
                (F.count("*") / 4.0).alias("debt_to_equity"),
                (F.max("px") / 1e5).alias("book_value_per_share"),
            )
        )

    @property
    def daily_sentiment(self) -> DataFrame:
        """Daily scores on the calendar of the bars, about one day in five of a ticker is known."""
        return (
            self.orders_of_tickers.filter("priority in ('4-NOT SPECIFIED', '5-LOW')")
            .groupBy("ticker", "date")
            .agg(
                ((F.avg("px") - 25e6) / 25e6).alias("sentiment_score"),
                F.count("*").cast("int").alias("article_count"),
            )
        )

    @property
    def sentiment_raw(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id"),
            F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
            F.col("ts").alias("published_at"),
            F.col("event_type").alias("headline"),
            ((F.round(F.col("value") * 100) - 24500) / 24500).alias("sentiment_score"),
        )

    @property
    def articles(self) -> DataFrame:
        """One article per document: first line as headline, the lines after it as summary, whole text as content.

        Times and addresses meet first, so that the texts are moved once, and only streamed past them.
        """
        pages = self.table("pages").select("page_id", "url")
        n_pages = pages.count()
        docs = self.table("documents").select(F.col("doc_id").alias("article_id"), "text", "source")
        stamps = self.table("events").select(F.col("event_id").alias("article_id"), F.col("ts").alias("published_at"))
        stamps = stamps.join(docs.select("article_id"), "article_id", "left_semi")
        stamps = stamps.join(pages, F.col("article_id") % n_pages == F.col("page_id")).drop("page_id")
        return docs.join(stamps.hint("shuffle_hash"), "article_id").select(
            "article_id",
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"),
            F.when(F.contains("text", F.lit("\n")), F.expr("substring(text, instr(text, '\n') + 1)")).alias("summary"),
            F.col("text").alias("content"),
            "url",
            "source",
            "published_at",
        )

    @property
    def quotes(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id"), F.col("event_type").alias("ticker"), F.col("ts"), F.col("value").alias("price")
        )

    @property
    def predictions(self) -> DataFrame:
        """Fixed formulas standing in for four models, so that everything after a model is checkable."""
        from barloom.operators.technical import daily_returns

        df = daily_returns(self.bars, (1,)).select("ticker", "date", "close", "daily_return", "return_lag_1")
        r0 = F.coalesce("daily_return", F.lit(0.0))
        r1 = F.coalesce("return_lag_1", F.lit(0.0))
        return df.select(
            "ticker",
            "date",
            "close",
            (r0 * 0.5).alias("rf_return"),
            (r1 * 0.25).alias("lr_return"),
            (r0 * -0.1).alias("xgb_return"),
            ((r0 + r1) / 8).alias("lstm_return"),
        )


#: Which order priority stands for which macro series.
MACRO_SERIES = {
    "1-URGENT": "pkr_usd_rate",
    "2-HIGH": "brent_oil_price",
    "3-MEDIUM": "sp500_close",
    "4-NOT SPECIFIED": "nasdaq_close",
    "5-LOW": "dxy_close",
}
