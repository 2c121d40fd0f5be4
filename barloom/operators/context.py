"""Market and sector context: returns of the mean close of all *other* tickers.

The mean of the others is the total of a date minus the own bar, so one aggregate per date replaces
a scan of all other tickers for every ticker. The return runs along the dates on which at least one
other ticker traded, which is the common calendar minus the dates on which only the ticker itself
traded. The calendar table therefore knows, for every date, where to step back to: the date before,
or, for the one ticker that traded alone there, the date before that ticker's run of lone dates.
No ticker-by-date grid is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import before_now, by_ticker, change, levels, ratio
from barloom.functions.rolling import Rolling
from barloom.session import broadcast_within, calendar_days

STRENGTH_ROWS = 20
MARKET_EXCESS, SECTOR_EXCESS = Rolling("_excess_market"), Rolling("_excess_sector")

# Two nested look-backs of four scalars each, measured from the schema.
_CALENDAR_ROW_BYTES = 512


def day_totals(bars: DataFrame, *keys: str) -> DataFrame:
    """Sum and count of closes per date (and group), and one ticker of the date."""
    return bars.groupBy(*keys, "date").agg(
        F.sum("close").alias("_sum"), F.count("close").alias("_n"), F.min("ticker").alias("_any")
    )


def merged_totals(totals: DataFrame) -> DataFrame:
    """Totals per date from totals per (group, date); a calendar-sized aggregation."""
    return totals.groupBy("date").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.min("_any").alias("_any"))


def calendar_with_lookback(days: DataFrame, group: str | None = None) -> DataFrame:
    """One row per (group, date): sum and count of closes, and the two dates to step back to.

    ``_near`` is the date before, ``_far`` the date before the run of lone dates that ends there.
    The window runs over aggregated dates, so its partition is bounded by the calendar.
    """
    keys = [group] if group else []
    days = days.withColumn("_lone", F.when(F.col("_n") == 1, F.col("_any"))).drop("_any")
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("_lone").isNull() | ~F.col("_lone").eqNullSafe(F.lag("_lone").over(w))
    days = days.withColumn("_starts", starts)

    def step_back(df: DataFrame, node: Column, near: str, far: str) -> DataFrame:
        df = df.withColumn("_node", node).withColumn(near, F.lag("_node").over(w))
        run = F.last(F.when(F.col("_starts"), F.struct(F.col(near).alias("before"))), ignorenulls=True).over(upto)
        df = df.withColumn("_run", run)
        return df.withColumn(far, F.lag("_run").over(w)["before"]).drop("_run", "_node")

    point = F.struct("date", "_sum", "_n", "_lone")
    days = step_back(days, point, "_near1", "_far1")
    deep = F.struct("date", "_sum", "_n", "_lone", F.col("_near1").alias("near"), F.col("_far1").alias("far"))
    days = step_back(days, deep, "_near", "_far")
    return days.select(*keys, "date", "_sum", "_n", "_near", "_far")


def attach_calendar(panel: DataFrame, totals: DataFrame, prefix: str, max_rows: int, group: str | None = None) -> DataFrame:
    """Join the calendar table to a panel; broadcast when ``max_rows`` proves it small."""
    calendar = calendar_with_lookback(totals, group)
    calendar = calendar.withColumn(prefix, F.struct("_sum", "_n", "_near", "_far")).drop("_sum", "_n", "_near", "_far")
    keys = ([group] if group else []) + ["date"]
    return panel.join(broadcast_within(calendar, max_rows, _CALENDAR_ROW_BYTES), keys, "left")


def others_return_levels(prefix: str, ret: str, ret_lag: str | None) -> list[dict[str, Column]]:
    """Window levels that turn the attached calendar into returns of the others."""
    cal = F.col(prefix)
    shared = cal["_n"] >= 2
    own1, own2, q1, q2 = f"{prefix}_own1", f"{prefix}_own2", f"{prefix}_q1", f"{prefix}_q2"
    prior = before_now(by_ticker())

    def step(node: Column, near: str, far: str) -> Column:
        return F.when(node[near]["_lone"] == F.col("ticker"), node[far]).otherwise(node[near])

    def mean_at(node: Column, *own: str) -> Column:
        value = ratio(node["_sum"], node["_n"])
        for name in reversed(own):
            hit = F.col(name)["date"] == node["date"]
            value = F.when(hit, ratio(node["_sum"] - F.col(name)["close"], node["_n"] - 1)).otherwise(value)
        return value

    bar = F.struct("date", "close")
    first = {
        own1: F.last(F.when(shared, bar), ignorenulls=True).over(prior),
        q1: step(cal, "_near", "_far"),
    }
    second = {
        own2: F.last(F.when(shared, F.struct(F.col(own1).alias("bar"))), ignorenulls=True).over(prior)["bar"],
        q2: step(F.col(q1), "near", "far"),
    }
    now = F.when(shared, ratio(cal["_sum"] - F.col("close"), cal["_n"] - 1))
    third = {ret: change(now, mean_at(F.col(q1), own1))}
    if ret_lag:
        third[ret_lag] = F.when(shared, change(mean_at(F.col(q1), own1), mean_at(F.col(q2), own1, own2)))
    return [first, second, third]


def _helpers(prefix: str) -> list[str]:
    return [prefix, *[f"{prefix}_{x}" for x in ("own1", "own2", "q1", "q2")]]


def others_return(bars: DataFrame, group: str | None = None, ret: str = "others_return", ret_lag: str | None = None) -> DataFrame:
    """Return of the mean close of all other tickers (of the group), null where it is not defined."""
    groups = bars.select(group).distinct().count() if group else 1
    source = bars.filter(F.col(group).isNotNull()) if group else bars
    totals = day_totals(source, *([group] if group else []))
    df = attach_calendar(bars, totals, "_cal", calendar_days(bars) * groups, group)
    return levels(df, *others_return_levels("_cal", ret, ret_lag)).drop(*_helpers("_cal"))


def attach_context(panel: DataFrame, bars: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach sector, market calendar and sector calendar; the joins come before any window.

    ``bars`` needs ticker, date and close only. It is aggregated once, per sector and date; the
    market totals are sums of the sector totals.
    """
    sectors = meta.select("ticker", "sector")
    slim = bars.select("ticker", "date", "close")
    days = calendar_days(slim)
    n_sectors = sectors.select("sector").distinct().count()
    df = panel if "sector" in panel.columns else panel.join(sectors, "ticker", "left")
    totals = day_totals(slim.join(sectors, "ticker", "left"), "sector")
    df = attach_calendar(df, merged_totals(totals), "_mkt", days)
    return attach_calendar(df, totals.filter("sector is not null"), "_sec", days * n_sectors, "sector")


def context_levels() -> list[dict[str, Column]]:
    """Levels of the market and sector features; ``daily_return`` must exist before the fifth.

    Relative strength is the sum of the returns in excess, 0 while its window is not full.
    """
    market = others_return_levels("_mkt", "market_return", "market_return_lag_1")
    sector = others_return_levels("_sec", "sector_return", None)
    merged = [a | b for a, b in zip(market, sector)]
    fill = {
        "market_return": F.coalesce("market_return", F.lit(0.0)),
        "market_return_lag_1": F.coalesce("market_return_lag_1", F.lit(0.0)),
        "sector_return": F.coalesce("sector_return", "market_return", F.lit(0.0)),
    }
    excess = {f"_excess_{x}": F.col("daily_return") - F.col(f"{x}_return") for x in ("market", "sector")}
    blocks = MARKET_EXCESS.total_blocks() | SECTOR_EXCESS.total_blocks()
    backs = MARKET_EXCESS.total_backs(STRENGTH_ROWS) | SECTOR_EXCESS.total_backs(STRENGTH_ROWS)
    strength = backs | {
        "relative_strength_20": F.coalesce(MARKET_EXCESS.total(STRENGTH_ROWS), F.lit(0.0)),
        "sector_relative_strength_20": F.coalesce(SECTOR_EXCESS.total(STRENGTH_ROWS), F.lit(0.0)),
    }
    return [*merged, fill, excess, blocks, strength]


def market_levels() -> list[dict[str, Column]]:
    """The context levels with the own return they are compared with."""
    from barloom.operators.technical import return_exprs

    first, *rest = context_levels()
    return [first | return_exprs(), *rest]


CONTEXT_HELPERS = [
    *_helpers("_mkt"), *_helpers("_sec"), "_excess_market", "_excess_sector", *MARKET_EXCESS.helpers(), *SECTOR_EXCESS.helpers(),
]


def market_context(bars: DataFrame, meta: DataFrame) -> DataFrame:
    """Market and sector features of a bar panel."""
    return levels(attach_context(bars, bars, meta), *market_levels()).drop(*CONTEXT_HELPERS)


def leave_one_out_close(bars: DataFrame, group: str | None = None) -> DataFrame:
    """Mean close of the other tickers of the date (and group) for every bar."""
    keys = ([group] if group else []) + ["date"]
    totals = bars.groupBy(*keys).agg(F.sum("close").alias("_sum"), F.count("close").alias("_n"))
    mean = F.when(F.col("_n") > 1, (F.col("_sum") - F.col("close")) / (F.col("_n") - 1))
    return bars.join(totals, keys).withColumn("others_close", mean).drop("_sum", "_n")


def market_index(bars: DataFrame, index_name: str = "KSE100") -> DataFrame:
    """Proxy index: plain means of the prices and the total volume of every date."""
    return (
        bars.groupBy("date")
        .agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))
        .withColumn("index_name", F.lit(index_name))
        .withColumn("is_synthetic_index", F.lit(True))
    )
