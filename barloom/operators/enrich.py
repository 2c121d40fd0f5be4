"""Event enrichment of a bar panel: sentiment, dividends, fundamentals, macro series.

Each source has an ``attach_*`` step (joins) and ``*_levels`` (window expressions), so the feature
build can do all joins first and then all windows in one partitioning. Events are joined on the
exact date and carried forward from there; an event on a day without a bar is not seen. The
``asof`` mode of :func:`carry_forward` keeps such events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import by_ticker, change, ffill, ffill_bfill, levels, ratio
from barloom.operators.technical import lagged
from barloom.session import broadcast_within, calendar_days

DIVIDEND_CAP_DAYS = 365
NO_DIVIDEND_DAYS = 9999
GROWTH_GAP_DAYS = (340, 390)
ENERGY_KEYWORDS = ("oil & gas", "refinery", "power generation")
FUNDAMENTALS = ["eps_trailing", "roe", "debt_to_equity", "book_value_per_share", "eps_growth_yoy"]


# ------------------------------------------------------------------ sentiment


def attach_sentiment(panel: DataFrame, daily: DataFrame) -> DataFrame:
    return panel.join(daily.select("ticker", "date", F.col("sentiment_score").alias("_score")), ["ticker", "date"], "left")


def sentiment_levels() -> list[dict[str, Column]]:
    """Own score, else half, a quarter, an eighth of the raw scores one, two, three rows before."""
    decayed = [lagged("_score", k) * 0.5**k for k in (1, 2, 3)]
    return [{"sentiment_score": F.coalesce(F.col("_score"), *decayed, F.lit(0.0))}]


def sentiment_decay(bars: DataFrame, daily: DataFrame) -> DataFrame:
    return levels(attach_sentiment(bars, daily), *sentiment_levels()).drop("_score")


# ------------------------------------------------------------------ dividends


def attach_dividends(panel: DataFrame, dividends: DataFrame, fan_out: bool = False) -> DataFrame:
    """Amount paid on the date, and whether the ticker pays at all.

    Several events on one date are added up; ``fan_out`` keeps one panel row per event instead.
    """
    events = dividends.select("ticker", F.col("ex_dividend_date").alias("date"), F.col("dividend_amount").alias("_amount"))
    payers = events.select("ticker").distinct().withColumn("_pays", F.lit(True))
    if not fan_out:
        events = events.groupBy("ticker", "date").agg(F.sum("_amount").alias("_amount"))
    return panel.join(events, ["ticker", "date"], "left").join(payers, "ticker", "left")


def dividend_levels(cap: int | None = DIVIDEND_CAP_DAYS) -> list[dict[str, Column]]:
    """``cap=None`` leaves the day count open and uses 9999 before the first dividend."""
    paid = F.col("_amount") > 0
    known = {
        "_paid_on": ffill(F.when(paid, F.col("date"))),
        "_paid": ffill(F.when(F.col("_amount") != 0, F.col("_amount"))),
    }
    days = F.datediff("date", "_paid_on")
    days = F.coalesce(days, F.lit(NO_DIVIDEND_DAYS)) if cap is None else F.least(F.coalesce(days, F.lit(cap)), F.lit(cap))
    return [
        known,
        {
            "days_since_dividend": F.when(F.col("_pays"), days).otherwise(NO_DIVIDEND_DAYS),
            "dividend_yield": ratio(F.coalesce("_paid", F.lit(0.0)), F.col("close")),
        },
    ]


DIVIDEND_HELPERS = ["_amount", "_pays", "_paid_on", "_paid"]


def dividend_features(bars: DataFrame, dividends: DataFrame, fan_out: bool = False) -> DataFrame:
    return levels(attach_dividends(bars, dividends, fan_out), *dividend_levels()).drop(*DIVIDEND_HELPERS)


def ex_dividend_week(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """1 when the next dividend on the ticker's calendar is 0 to 7 days ahead. Looks ahead by design."""
    df = attach_dividends(bars, dividends)
    backwards = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    upcoming = ffill(F.when(F.col("_amount") > 0, F.col("date")), backwards)
    ahead = F.datediff(F.col("_next"), F.col("date"))
    df = df.withColumn("_next", upcoming)
    return df.withColumn("is_ex_dividend_week", F.coalesce(ahead.between(0, 7), F.lit(False)).cast("int")).drop(
        "_amount", "_pays", "_next"
    )


# --------------------------------------------------------------- fundamentals


def earnings_growth(fundamentals: DataFrame) -> DataFrame:
    """Growth of earnings over four reports, null unless the reports lie about a year apart."""
    w = Window.partitionBy("ticker").orderBy("report_date")
    gap = F.datediff("report_date", F.lag("report_date", 4).over(w))
    known = F.last("eps", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = fundamentals.withColumn("_eps", known)
    growth = change(F.col("_eps"), F.lag("_eps", 4).over(w))
    return df.withColumn("eps_growth_yoy", F.when(gap.between(*GROWTH_GAP_DAYS), growth)).drop("_eps")


def attach_fundamentals(panel: DataFrame, fundamentals: DataFrame) -> DataFrame:
    reports = earnings_growth(fundamentals).select(
        "ticker",
        F.col("report_date").alias("date"),
        F.col("eps").alias("_eps_trailing"),
        *[F.col(c).alias(f"_{c}") for c in FUNDAMENTALS[1:]],
    )
    return panel.join(reports, ["ticker", "date"], "left")


def fundamentals_levels() -> list[dict[str, Column]]:
    return [
        {c: F.coalesce(ffill(f"_{c}"), F.lit(0.0)) for c in FUNDAMENTALS},
        {"pe_ratio": ratio(F.col("close"), F.col("eps_trailing"))},
    ]


FUNDAMENTALS_HELPERS = [f"_{c}" for c in FUNDAMENTALS]


def fundamentals_features(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    return levels(attach_fundamentals(bars, fundamentals), *fundamentals_levels()).drop(*FUNDAMENTALS_HELPERS)


def carry_forward(bars: DataFrame, events: DataFrame, columns: list[str], mode: str = "exact", event_date: str = "date") -> DataFrame:
    """Last known event values at every bar.

    ``exact`` sees only events on bar dates. ``asof`` merges both timelines by a union, so that
    events between bars count from the next bar on; both need one exchange by ticker.
    """
    named = events.select("ticker", F.col(event_date).alias("date"), *columns)
    if mode == "exact":
        df = bars.join(named, ["ticker", "date"], "left")
        return levels(df, {c: ffill(c) for c in columns})
    if mode != "asof":
        raise ValueError("mode must be 'exact' or 'asof'")
    timeline = named.withColumn("_kind", F.lit(0)).unionByName(bars.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = timeline.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return filled.filter("_kind = 1").select(*bars.columns, *columns)


# ---------------------------------------------------------------------- macro

MACRO_CHANGES = {
    "pkr_usd_change_pct": "pkr_usd_rate",
    "oil_return_pct": "brent_oil_price",
    "sp500_return_pct": "sp500_close",
    "nasdaq_return_pct": "nasdaq_close",
    "dxy_change_pct": "dxy_close",
}


def macro_changes(macro: DataFrame) -> DataFrame:
    """Changes along the macro calendar; a missing value counts as unchanged.

    One row per calendar date, so the unpartitioned window is bounded by the calendar.
    """
    w = Window.partitionBy().orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = macro.withColumns({f"_{v}": F.last(v, ignorenulls=True).over(upto) for v in MACRO_CHANGES.values()})
    changes = {k: change(F.col(f"_{v}"), F.lag(f"_{v}").over(w)) for k, v in MACRO_CHANGES.items()}
    return df.withColumns(changes).select("date", "sbp_policy_rate", *MACRO_CHANGES, "us10y_yield")


def attach_macro(panel: DataFrame, macro: DataFrame, max_days: int | None = None) -> DataFrame:
    table = macro_changes(macro)
    table = table.select("date", *[F.col(c).alias(f"_{c}") for c in table.columns[1:]])
    days = calendar_days(macro) if max_days is None else max_days
    return panel.join(broadcast_within(table, days, 80), "date", "left")


def is_energy(sector: Column) -> Column:
    hit = F.lit(False)
    for word in ENERGY_KEYWORDS:
        hit = hit | F.lower(sector).contains(word)
    return F.coalesce(hit, F.lit(False))


def macro_levels() -> list[dict[str, Column]]:
    zero = F.lit(0.0)
    filled = {
        "sbp_policy_rate": F.coalesce(ffill_bfill("_sbp_policy_rate"), zero),
        "us10y_yield": F.coalesce(ffill_bfill("_us10y_yield"), zero),
        **{c: F.coalesce(F.col(f"_{c}"), zero) for c in MACRO_CHANGES if c != "oil_return_pct"},
        "oil_return_pct": F.when(is_energy(F.col("sector")), F.coalesce("_oil_return_pct", zero)).otherwise(0.0),
    }
    moved = ~F.col("sbp_policy_rate").eqNullSafe(lagged("sbp_policy_rate"))
    changed = {"_rate_moved": F.when(moved, F.col("date"))}
    since = {"days_since_rate_change": F.coalesce(F.datediff("date", ffill("_rate_moved")), F.lit(0))}
    return [filled, changed, since]


MACRO_HELPERS = ["_rate_moved", *[f"_{c}" for c in ("sbp_policy_rate", *MACRO_CHANGES, "us10y_yield")]]


def macro_features(bars: DataFrame, macro: DataFrame, meta: DataFrame) -> DataFrame:
    df = bars if "sector" in bars.columns else bars.join(meta.select("ticker", "sector"), "ticker", "left")
    return levels(attach_macro(df, macro), *macro_levels()).drop(*MACRO_HELPERS)


def energy_gate_coverage(meta: DataFrame) -> DataFrame:
    """How many distinct sectors of active tickers pass the energy gate; 0 means the feature is dead."""
    sectors = meta.filter("is_active").select("sector").distinct()
    return sectors.agg(
        F.count("*").alias("sectors"),
        F.count_if(is_energy(F.col("sector"))).alias("energy_sectors"),
    ).withColumn("gate_is_live", F.col("energy_sectors") > 0)
