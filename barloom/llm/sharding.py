"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.session import settle


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into ``shards`` contiguous shards along ``id_col``.

    Rows are laid out by range, each range gives its totals of bytes and rows, and the totals before a
    range (one row per range) shift the sums inside it. A row goes to the shard in which the middle of
    its bytes falls, so each shard differs from the equal target by less than one row at either end.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``. Null text counts as empty, null
    ids come last, ties are ordered by size and checksum (rows equal in all three are interchangeable),
    an empty table gives no rows, and other columns are ignored.
    """
    text = text_of(text_col)
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col("_id").asc_nulls_last(), F.col("size"), F.col("text_crc32"), F.col("_tie")]
    laid = settle(slim.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "shards")
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # One row per range: the number of shuffle partitions bounds the single-task window and the broadcast.
    ranges = laid.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    ranges = ranges.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_bytes_before") + F.sum("size").over(inside) - F.col("size")
    placed = laid.join(F.broadcast(ranges), "_range").select(
        "_id",
        "size",
        "text_crc32",
        F.expr("_total").alias("_total"),
        start.alias("_start"),
        (F.col("_rows_before") + F.sum(F.lit(1)).over(inside) - 1).alias("_row"),
    )
    middle = F.expr(f"cast(((2 * _start + size) * {int(shards)}) div (2 * _total) as int)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(shards - 1)))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
