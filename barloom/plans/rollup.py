"""The news roll-up as stored tables that grow by batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.news import analyse_whole, daily_state, merged_state, per_company
from barloom.session import settle
from barloom.sources.upsert import SENTIMENT, read_table, table_exists, upsert_table


class Rollup:
    """Accepted articles with their companies, their daily parts by batch, and daily sentiment, below one folder.

    A batch is one partition of the articles and of the parts, so adding it again replaces it: a batch that
    failed half-way is simply added once more. Articles are deduplicated against those of all other
    batches, and a day's row is put together from the parts of all batches, so late articles of an old day
    count without a second look at its texts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _replace(self, rows: DataFrame, name: str, batch: str) -> DataFrame:
        """Rows of one batch in place of those stored under its name."""
        path = f"{self.folder}/{name}/_batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def add(self, batch: str, articles: DataFrame, terms: DataFrame, lexicon: DataFrame, **options) -> None:
        """Match, deduplicate, score and store a batch of articles, and bring the days it touches up to date.

        If a batch is added again with other articles, the days of its former ones are brought up to date
        too; one that has no article left keeps a row with the count zero and no score.
        """
        if not re.fullmatch(r"\w[\w.-]*", batch):
            raise ValueError("the name of a batch is made of letters, digits, dots, dashes and underscores")
        batch = f"b-{batch}"  # never read back as a number
        stored, days = None, None
        if table_exists(self.spark, f"{self.folder}/articles"):
            stored = self._stored("articles").filter(F.col("_batch") != batch).select("url", "headline")
        if table_exists(self.spark, f"{self.folder}/parts/_batch={batch}"):
            days = settle(self._stored("parts").filter(F.col("_batch") == batch).select("ticker", "date"), "days")
        own = self._replace(analyse_whole(articles, terms, lexicon, stored=stored, **options), "articles", batch)
        touched = self._replace(daily_state(per_company(own)), "parts", batch).select("ticker", "date")
        if days is not None:
            touched = touched.unionByName(days)
        states = self._stored("parts").drop("_batch").join(touched.distinct(), ["ticker", "date"], "right")
        upsert_table(self.spark, f"{self.folder}/daily", merged_state(states), SENTIMENT)

    def articles(self) -> DataFrame:
        """All accepted articles, one row per company that they name."""
        return per_company(self._stored("articles").drop("_batch"))

    def daily(self) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/daily")
