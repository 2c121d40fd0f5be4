"""Technical window features of a bar panel, all tickers in one pass.

Every feature is a set of column expressions on a *level*: level 1 reads the bars, level 2 reads
level 1 and so on. ``technical_features`` runs all features level by level, so that they share one
exchange and one sort; the single operators take the same expressions.

Input: cleaned bars, one row per (ticker, date), ``close`` not null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ewm import Smoothing, ewm_levels, row_exprs, twice_smoothed
from barloom.functions.frames import by_ticker, change, levels, merged, ratio, so_far
from barloom.functions.rolling import Rolling

SMA_WINDOWS = (7, 21, 50)
RETURN_LAGS = (1, 2, 3, 5, 10)
VOLATILITY_WINDOWS = (10, 20)


def lagged(col: str, k: int = 1) -> Column:
    return F.lag(col, k).over(by_ticker())


# Series with rolling windows.
CLOSE, VOLUME, TURNOVER = Rolling("close"), Rolling("_volume"), Rolling("_turnover")
RETURN, RANGE, BALANCE = Rolling("daily_return"), Rolling("_true_range"), Rolling("_obv")

TECHNICAL_HELPERS = [
    "_volume", "_turnover", "_signed_volume", "_obv", "_true_range", "_obv_mean", "_obv_std",
    *[h for r in (CLOSE, VOLUME, TURNOVER, RETURN, RANGE, BALANCE) for h in r.helpers()],
]

Levels = list[dict[str, Column]]

# --------------------------------------------------------------------- levels


def sma_levels(windows=SMA_WINDOWS) -> Levels:
    backs = {k: v for n in windows for k, v in CLOSE.total_backs(n).items()}
    return [CLOSE.total_blocks(), backs | {f"sma_{n}_dist": change(F.col("close"), CLOSE.mean(n)) for n in windows}]


def return_exprs() -> dict[str, Column]:
    return CLOSE.backs(1) | {"daily_return": change(F.col("close"), CLOSE.back(1))}


def lag_exprs(lags=RETURN_LAGS) -> dict[str, Column]:
    return {f"return_lag_{k}": lagged("daily_return", k) for k in lags}


def return_levels(lags=RETURN_LAGS) -> Levels:
    return [return_exprs(), lag_exprs(lags)]


def bollinger_levels(n: int = 20) -> Levels:
    mid, std, close = CLOSE.mean(n), CLOSE.std(n), F.col("close")
    bands = {
        "bb_middle_dist": change(close, mid),
        "bb_upper_dist": change(close, mid + std * 2),
        "bb_lower_dist": change(close, mid - std * 2),
    }
    return [CLOSE.total_blocks() | CLOSE.spread_blocks(), CLOSE.total_backs(n) | CLOSE.std_backs(n) | bands]


def volume_exprs() -> dict[str, Column]:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return {"_volume": F.col("volume").cast("double"), "_turnover": typical * F.col("volume")}


def vwap_levels(n: int = 14) -> Levels:
    price = ratio(TURNOVER.total(n), VOLUME.total(n))
    blocks = TURNOVER.total_blocks() | VOLUME.total_blocks()
    backs = TURNOVER.total_backs(n) | VOLUME.total_backs(n)
    return [volume_exprs(), blocks, backs | {f"vwap_{n}_dist": change(F.col("close"), price)}]


def relative_volume_levels(n: int = 20) -> Levels:
    mean = VOLUME.mean(n)
    share = F.col("volume") / F.when(mean == 0, 1.0).otherwise(mean)
    return [volume_exprs(), VOLUME.total_blocks(), VOLUME.total_backs(n) | {"relative_volume": share}]


def signed_volume_exprs() -> dict[str, Column]:
    signed = F.signum(F.col("close") - CLOSE.back(1)) * F.col("volume")
    return CLOSE.backs(1) | {"_signed_volume": F.coalesce(signed, F.lit(0.0))}


def raw_obv_levels(name: str = "_obv") -> Levels:
    return [signed_volume_exprs(), {name: F.sum("_signed_volume").over(so_far())}]


def obv_levels(n: int = 50) -> Levels:
    blocks = BALANCE.total_blocks() | BALANCE.spread_blocks()
    std = F.col("_obv_std")
    score = (F.col("_obv") - F.col("_obv_mean")) / F.when(std == 0, 1.0).otherwise(std)
    backs = BALANCE.total_backs(n) | BALANCE.std_backs(n)
    return [*raw_obv_levels(), blocks, backs | {"_obv_mean": BALANCE.mean(n), "_obv_std": BALANCE.std(n)}, {"obv": score}]


def volatility_levels(windows=VOLATILITY_WINDOWS) -> Levels:
    backs = {k: v for n in windows for k, v in RETURN.std_backs(n).items()}
    return [return_exprs(), RETURN.spread_blocks(), backs | {f"return_vol_{n}": RETURN.std(n) for n in windows}]


def true_range_exprs() -> dict[str, Column]:
    prev = CLOSE.back(1)
    high, low = F.col("high"), F.col("low")
    return CLOSE.backs(1) | {"_true_range": F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))}


def atr_levels(n: int = 14) -> Levels:
    return [true_range_exprs(), RANGE.total_blocks(), RANGE.total_backs(n) | {"atr": RANGE.mean(n)}]


def weekday_cycle_exprs() -> dict[str, Column]:
    angle = F.weekday("date") * (2 * math.pi) / 5
    return {"dow_sin": F.sin(angle), "dow_cos": F.cos(angle)}


def spread_exprs() -> dict[str, Column]:
    span = F.col("high") - F.col("low")
    return {
        "daily_spread": ratio(span, F.col("close")),
        "close_pos": F.when(span == 0, 0.5).otherwise(ratio(F.col("close") - F.col("low"), span)),
    }


# ------------------------------------------------------------------ operators


def run(bars: DataFrame, *features: Levels) -> DataFrame:
    """Apply the levels of some features together, without their helper columns."""
    return levels(bars, *merged(*features)).drop(*TECHNICAL_HELPERS)


def sma_distance(bars: DataFrame, windows=SMA_WINDOWS) -> DataFrame:
    return run(bars, sma_levels(windows))


def daily_returns(bars: DataFrame, lags=RETURN_LAGS) -> DataFrame:
    return run(bars, return_levels(lags))


def bollinger(bars: DataFrame, n: int = 20) -> DataFrame:
    return run(bars, bollinger_levels(n))


def vwap(bars: DataFrame, n: int = 14) -> DataFrame:
    return run(bars, vwap_levels(n))


def raw_obv(bars: DataFrame) -> DataFrame:
    return run(bars, raw_obv_levels("obv"))


def obv(bars: DataFrame, n: int = 50) -> DataFrame:
    return run(bars, obv_levels(n))


def relative_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    return run(bars, relative_volume_levels(n))


def realized_volatility(bars: DataFrame, windows=VOLATILITY_WINDOWS) -> DataFrame:
    return run(bars, volatility_levels(windows))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return run(bars, atr_levels(n))


def weekday_cycle(bars: DataFrame) -> DataFrame:
    return run(bars, [weekday_cycle_exprs()])


def spread(bars: DataFrame) -> DataFrame:
    return run(bars, [spread_exprs()])


def move_exprs() -> dict[str, Column]:
    delta = F.col("close") - CLOSE.back(1)
    return CLOSE.backs(1) | {
        "_gain": F.when(delta > 0, delta).otherwise(0.0),
        "_loss": F.when(delta < 0, -delta).otherwise(0.0),
    }


SMOOTHING_HELPERS = ["_row", "_gain", "_loss", "_up", "_down", "_fast", "_slow", "_short"]


def rsi_levels(window: int = 14) -> list[dict[str, Column]]:
    wilder = 1.0 / window
    averages = {"_up": Smoothing("_gain", wilder, window), "_down": Smoothing("_loss", wilder, window)}
    return [move_exprs() | row_exprs(), *ewm_levels(averages), {f"rsi_{window}": _rsi()}]


def macd_levels(fast: int = 12, slow: int = 26, signal: int = 9) -> list[dict[str, Column]]:
    """The signal smooths the difference of two smoothed series; it follows from three single ones."""
    averages = {"_fast": Smoothing.span("close", fast), "_slow": Smoothing.span("close", slow), "_short": Smoothing.span("close", signal)}
    quick, long, short = (s.decay for s in averages.values())
    line = F.col("_fast") - F.col("_slow")
    smooth = twice_smoothed(F.col("_fast"), F.col("_short"), quick, short) - twice_smoothed(
        F.col("_slow"), F.col("_short"), long, short
    )
    last = {"macd": line, "macd_signal": smooth, "macd_hist": line - smooth}
    return [row_exprs(), *ewm_levels(averages), last]


def _rsi() -> Column:
    """No losses but gains: the limit value 100. Neither: undefined, null."""
    up, down = F.col("_up"), F.col("_down")
    return F.when((down == 0) & (up > 0), 100.0).otherwise(100 - 100 / (1 + ratio(up, down)))


def rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    return levels(bars, *rsi_levels(window)).drop(*SMOOTHING_HELPERS)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return levels(bars, *macd_levels(fast, slow, signal)).drop(*SMOOTHING_HELPERS)


#: Features of :func:`smoothing_levels`.
SMOOTHED = ["rsi_14", "macd", "macd_signal", "macd_hist"]


def smoothing_levels() -> Levels:
    """Levels of the recursively smoothed features; they read the close alone and are many."""
    return merged(rsi_levels(), macd_levels())


def technical_levels(smoothed: bool = True) -> Levels:
    """All technical features, as few levels deep as the deepest of them; without the smoothed ones on demand."""
    return merged(
        sma_levels(),
        return_levels(),
        bollinger_levels(),
        vwap_levels(),
        obv_levels(),
        relative_volume_levels(),
        volatility_levels(),
        atr_levels(),
        [weekday_cycle_exprs() | spread_exprs()],
        *([smoothing_levels()] if smoothed else []),
    )


def technical_features(bars: DataFrame) -> DataFrame:
    """All technical features with one exchange by ticker."""
    return levels(bars, *technical_levels()).drop(*TECHNICAL_HELPERS, *SMOOTHING_HELPERS)


# ------------------------------------------------------- latest rows and ranges


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of every ticker; for small ``n`` Spark limits each group before the shuffle."""
    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return panel.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def latest_change(bars: DataFrame) -> DataFrame:
    """Change of the newest bar against the one before, one row per ticker with at least two bars.

    Keeps the two newest bars per ticker by a bounded aggregate instead of ranking the history.
    """
    two = last_rows(bars.select("ticker", "date", "close"), 2).groupBy("ticker").agg(
        F.max_by("close", "date").alias("close"),
        F.min_by("close", "date").alias("_prev"),
        F.max("date").alias("date"),
        F.count("*").alias("_n"),
    )
    move = F.col("close") - F.col("_prev")
    return two.filter("_n = 2").select(
        "ticker", "date", "close", move.alias("daily_change"), (ratio(move, F.col("_prev")) * 100).alias("daily_change_percent")
    )


def calendar_range(panel: DataFrame, span: str) -> DataFrame:
    """Rows of the last 7 days, 1 or 3 months, 1 or 5 years before the ticker's own last date.

    Month steps keep the day number and roll over a short month, so 31 March minus one month is
    3 March and not 28 February.
    """
    last = F.max("date").over(Window.partitionBy("ticker"))
    if span == "7D":
        start = F.date_sub(last, 7)
    else:
        months = {"30D": 1, "90D": 3, "1Y": 12, "5Y": 60}[span]
        start = F.date_add(F.add_months(F.trunc(last, "month"), -months), F.dayofmonth(last) - 1)
    return panel.withColumn("_start", start).filter(F.col("date") >= F.col("_start")).drop("_start")
