"""Targets, dated splits, walk-forward windows, sequences and metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import by_ticker, ratio
from barloom.session import broadcast_within

TEST_DAYS = 250
MIN_TRAIN_DAYS = 500
DEFAULT_CUTOFF = dt.date(2023, 1, 1)
#: Smallest divisor of a relative error, the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16

# A window row is six dates and numbers.
_WINDOW_ROW_BYTES = 96


def with_target(panel: DataFrame) -> DataFrame:
    """Return of the next bar; the last bar of a ticker has none and is dropped."""
    following = F.lead("close").over(by_ticker())
    df = panel.withColumn("target_return_t1", ratio(following - F.col("close"), F.col("close")))
    return df.filter(F.col("target_return_t1").isNotNull())


def between_dates(panel: DataFrame, start, end) -> DataFrame:
    return panel.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def trading_dates(bars: DataFrame) -> DataFrame:
    """One row per day on which anything traded, bounded by the calendar."""
    return bars.select("date").distinct()


def global_cutoff(dates: DataFrame, test_days: int = TEST_DAYS, min_train_days: int = MIN_TRAIN_DAYS) -> DataFrame:
    """One row: the date that leaves ``test_days`` newer dates.

    With too few dates it is the one a fifth from the newest; with none a fixed day.
    """
    newest = Window.partitionBy().orderBy(F.col("date").desc())
    numbered = dates.select("date", (F.row_number().over(newest) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    wanted = F.when(F.col("n") < test_days + min_train_days, F.floor(F.col("n") / 5)).otherwise(F.lit(test_days))
    return numbered.agg(F.coalesce(F.max(F.when(F.col("i") == wanted, F.col("date"))), F.lit(DEFAULT_CUTOFF)).alias("cutoff"))


def history_lengths(bars: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Bars per ticker up to the cutoff; the cutoff is a scalar subquery, evaluated once."""
    day = cutoff.select("cutoff").scalar()
    return bars.filter(F.col("date") <= day).groupBy("ticker").agg(F.count("*").alias("train_days"))


def eligible_tickers(bars: DataFrame, universe: DataFrame, cutoff: DataFrame, min_train_days: int = MIN_TRAIN_DAYS) -> DataFrame:
    """The universe with history length and whether it is long enough."""
    counts = history_lengths(bars, cutoff)
    df = universe.select("ticker").join(counts, "ticker", "left").fillna(0, ["train_days"])
    return df.withColumn("is_eligible", F.col("train_days") >= min_train_days)


def split_record(
    eligible: DataFrame, cutoff: DataFrame, test_days: int = TEST_DAYS, min_train_days: int = MIN_TRAIN_DAYS
) -> DataFrame:
    """One row that documents a split; the excluded tickers are a list over the dimension table."""
    return eligible.agg(
        F.count_if("is_eligible").alias("valid_tickers_count"),
        F.sort_array(F.collect_list(F.when(~F.col("is_eligible"), F.col("ticker")))).alias("excluded_tickers"),
    ).select(
        cutoff.select("cutoff").scalar().alias("global_cutoff_date"),
        F.lit(test_days).alias("test_trading_days_requested"),
        F.lit(min_train_days).alias("min_train_trading_days_requested"),
        "valid_tickers_count",
        "excluded_tickers",
    )


def split_by_cutoff(panel: DataFrame, cutoff: DataFrame) -> DataFrame:
    day = cutoff.select("cutoff").scalar()
    return panel.withColumn("split", F.when(F.col("date") <= day, "train").otherwise("test"))


def pooled_training_set(panel: DataFrame, bars: DataFrame, universe: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of all eligible tickers with target and split: cutoff, history check, target, split."""
    cutoff = global_cutoff(dates)
    good = eligible_tickers(bars, universe, cutoff).filter("is_eligible").select("ticker")
    return split_by_cutoff(with_target(panel.join(good, "ticker", "left_semi")), cutoff)


# ------------------------------------------------------- walk-forward windows


def walk_forward_windows(
    dates: DataFrame, start=None, end=None, train: int = 750, test: int = 60, step: int = 60, mode: str = "rolling"
) -> DataFrame:
    """Windows over trading dates: ``train`` dates before each test start, one start every ``step``.

    The training range ends on the calendar day before the test. The last test may be short. Fewer
    than three windows give none: a shorter test would not change their number, because the step
    stays. The table is bounded by the calendar.
    """
    if mode not in ("rolling", "expanding"):
        raise ValueError("mode must be 'rolling' or 'expanding'")
    if start is not None:
        dates = dates.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        dates = dates.filter(F.col("date") <= F.lit(end).cast("date"))
    w = Window.partitionBy().orderBy("date")
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("date").over(everything) if start is None else F.lit(start).cast("date")
    df = dates.select(
        "date",
        (F.row_number().over(w) - 1).alias("i"),
        (F.lag("date", train).over(w) if mode == "rolling" else first).alias("train_start"),
        F.coalesce(F.lead("date", test - 1).over(w), F.last("date").over(everything)).alias("test_end"),
    )
    df = df.filter((F.col("i") >= train) & ((F.col("i") - train) % step == 0)).select(
        ((F.col("i") - train) / step).cast("int").alias("window_idx"),
        "train_start",
        F.date_sub("date", 1).alias("train_end"),
        F.col("date").alias("test_start"),
        "test_end",
    )
    total = F.count("*").over(Window.partitionBy())
    return df.withColumn("_n", total).filter("_n >= 3").drop("_n")


def rows_in_windows(panel: DataFrame, windows: DataFrame, role: str) -> DataFrame:
    """Rows of the panel once per window they train or test in.

    The windows are spelled out as (day, window) rows, so the range condition becomes an equi join on
    the date against that table. It is broadcast only if the days of the given windows, counted first,
    stay below the limit; training windows of a long calendar may not.
    """
    length = F.datediff(f"{role}_end", f"{role}_start") + 1
    rows = windows.agg(F.sum(length)).first()[0] or 0
    days = windows.select("*", F.explode(F.sequence(f"{role}_start", f"{role}_end")).alias("date"))
    return panel.join(broadcast_within(days, rows, _WINDOW_ROW_BYTES), "date")


# -------------------------------------------------------------------- metrics


def metric_exprs(actual: str, predicted: str, close: str, prefix: str = "") -> list[Column]:
    """Errors in price space and directional accuracy, all built-in aggregates."""
    y, p = F.col(actual), F.col(predicted)
    price, guess = F.col(close) * (1 + y), F.col(close) * (1 + p)
    error = price - guess
    return [
        F.avg(F.abs(error)).alias(f"{prefix}mae"),
        F.sqrt(F.avg(error * error)).alias(f"{prefix}rmse"),
        (F.avg(F.abs(error) / F.greatest(F.abs(price), F.lit(EPSILON))) * 100).alias(f"{prefix}mape"),
        (F.avg((F.signum(y) == F.signum(p)).cast("double")) * 100).alias(f"{prefix}directional_accuracy"),
    ]


def naive_persistence(panel: DataFrame, name: str = "prediction") -> DataFrame:
    return panel.withColumn(name, F.lit(0.0))


def metrics(scored: DataFrame, *keys: str, prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(*keys).agg(*metric_exprs("target_return_t1", prediction, "close"))


def window_metrics(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Model and naive errors of each (window, ticker) in one aggregation."""
    keys = ["ticker", "window_idx", "train_start", "train_end", "test_start", "test_end"]
    df = scored.withColumn("_naive", F.lit(0.0))
    return df.groupBy(*keys).agg(
        *metric_exprs("target_return_t1", prediction, "close"), *metric_exprs("target_return_t1", "_naive", "close", "naive_")
    )


def ablation_metrics(scored: DataFrame) -> DataFrame:
    """Errors per config over all tickers and per ticker, from one pass with grouping sets.

    ``ticker`` is null in the rows over all tickers.
    """
    return (
        scored.groupingSets([["config"], ["config", "ticker"]], "config", "ticker")
        .agg(*metric_exprs("target_return_t1", "prediction", "close"), F.grouping("ticker").alias("_all"))
        .drop("_all")
    )


# ------------------------------------------------------------------ sequences


def sequences(panel: DataFrame, features: list[str], lookback: int = 30, mode: str = "training", keys=("ticker",)) -> DataFrame:
    """Sliding sequences per ticker (and split).

    ``training``: rows i..i+lookback-1 with the label of the last row, one sequence fewer than would
    fit. ``serving``: the rows before row i, attached to row i.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    row = F.array(*[F.col(c).cast("double") for c in features])
    if mode == "serving":
        df = panel.withColumn("sequence", F.collect_list(row).over(w.rowsBetween(-lookback, -1)))
        return df.filter(F.size("sequence") == lookback)
    if mode != "training":
        raise ValueError("mode must be 'training' or 'serving'")
    df = panel.withColumns(
        {
            "sequence": F.collect_list(row).over(w.rowsBetween(-(lookback - 1), Window.currentRow)),
            "_more": F.lead("date").over(w).isNotNull(),
            "sequence_start": F.lag("date", lookback - 1).over(w),
        }
    )
    return df.filter((F.size("sequence") == lookback) & F.col("_more")).drop("_more")


def min_max_bounds(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the training range of every column."""
    return train.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def min_max_scale(df: DataFrame, bounds: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    """Scale by ranges that were fitted on training rows only; a constant column becomes 0.

    The ranges are a scalar subquery of one struct.
    """
    known = bounds.select(F.struct(*bounds.columns).alias("b")).scalar()
    df = df.withColumn("_bounds", known)
    scaled = {}
    for c in columns:
        low, high = F.col("_bounds")[f"{c}_min"], F.col("_bounds")[f"{c}_max"]
        span = F.when(high == low, 1.0).otherwise(high - low)
        scaled[c] = F.col(c) * span + low if inverse else (F.col(c) - low) / span
    return df.withColumns(scaled).drop("_bounds")


def category_ids(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Ids of a dimension by position in the sorted list of its values; unknown ones are 0."""
    from barloom.functions.ranking import global_position

    ids = global_position(rows.select(column).filter(F.col(column).isNotNull()).distinct(), [F.col(column)], name)
    return ids.withColumn(name, (F.col(name) - 1).cast("int"))


def sequence_dataset(panel: DataFrame, meta: DataFrame, features: list[str], lookback: int = 30, seed: int = 42) -> DataFrame:
    """Scaled sequences with category ids and an 80/20 validation split of the training part.

    The split hashes (ticker, date, seed), so it is the same on every run and in every partitioning.
    """
    columns = [*features, "target_return_t1"]
    bounds = min_max_bounds(panel.filter("split = 'train'"), columns)
    df = sequences(min_max_scale(panel, bounds, columns), features, lookback, keys=("ticker", "split"))
    tickers = category_ids(panel, "ticker", "ticker_id")
    sectors = category_ids(meta, "sector", "sector_id")
    df = df.drop("sector").join(meta.select("ticker", "sector"), "ticker", "left")
    df = df.join(tickers, "ticker").join(sectors, "sector", "left").fillna(0, ["sector_id"])
    fold = F.pmod(F.xxhash64("ticker", "date", F.lit(seed)), F.lit(10))
    part = F.when(F.col("split") == "test", "test").when(fold < 8, "train").otherwise("validation")
    return df.select(
        "ticker", "date", "sequence_start", "ticker_id", "sector_id", "sequence",
        F.col("target_return_t1").alias("label"), part.alias("part"),
    )
