"""Statistics, correlations, collinearity and histograms of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import diagnose as dg
from barloom.operators import technical as t
from barloom.plans import features as fb
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.panel import FULL_BUILD, FULL_VIEWS, feature_sql, tables
from barloom.suite.sql_views import full, with_views

# A few features of different scale, with nulls at the start of each ticker.
COLUMNS = ["daily_return", "return_vol_20", "relative_volume", "bb_middle_dist", "dow_sin"]
_PANEL = f"""
, feat AS (SELECT ticker, date, daily_return, {full('stddev_samp', 'daily_return', 20)} AS return_vol_20,
           volume / ({full('avg', 'volume', 20)}) AS relative_volume, close / ({full('avg', 'close', 20)}) - 1 AS bb_middle_dist,
           sin(2 * pi() * (isodow(date) - 1) / 5) AS dow_sin FROM returns)"""


def panel(v: Views):
    features = t.relative_volume_levels(), t.bollinger_levels(), [t.weekday_cycle_exprs()], t.volatility_levels((20,))
    df = t.run(v.bars, *features)
    return df.select("ticker", "date", *COLUMNS)


def _describe(c: str) -> str:
    qs = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS q{round(q * 100)}" for q in (0.25, 0.5, 0.75))
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
               round(min({c}), 6) AS min, round(max({c}), 6) AS max, {qs} FROM feat"""


@case("a14_describe", with_views(_PANEL + " UNION ALL ".join(map(_describe, COLUMNS)), "returns"))
def a14(v: Views):
    df = dg.describe(panel(v), COLUMNS)
    return df.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")])


_AS_DOUBLE = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in fb.FEATURES)
# Features have up to six decimals, so quartiles between two of them have up to eight.
_STATS = ["count(value) AS count", "round(avg(value), 4) AS mean", "round(stddev_samp(value), 4) AS std"]
_STATS += ["round(min(value), 8) AS min", "round(max(value), 8) AS max"]
_STATS += [f"round(quantile_cont(value, {q}), 8) AS q{round(q * 100)}" for q in (0.25, 0.5, 0.75)]


@case(
    "a14_describe_features",
    with_views(
        FULL_BUILD
        + f""", shown AS (SELECT {_AS_DOUBLE} FROM (SELECT {', '.join(map(feature_sql, fb.FEATURES))} FROM panel))
              SELECT "column", {', '.join(_STATS)} FROM (UNPIVOT shown ON COLUMNS(*) INTO NAME "column" VALUE value) GROUP BY 1""",
        *FULL_VIEWS,
        recursive=True,
    ),
)
def a14_features(v: Views):
    """All features of the full panel, incomplete rows included."""
    df = fb.feature_panel(*tables(v)).select(*[F.expr(feature_sql(c)) for c in fb.FEATURES])
    df = dg.describe(df, fb.FEATURES)
    sums = [F.round(c, 4).alias(c) for c in ("mean", "std")]
    return df.select("column", "count", *sums, *[F.round(c, 8).alias(c) for c in ("min", "max", "q25", "q50", "q75")])


_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM feat" for a in COLUMNS for b in COLUMNS)


@case("a15_correlations", with_views(_PANEL + f"SELECT a, b, round(corr, 6) AS corr FROM ({_CORR})", "returns"))
def a15(v: Views):
    return dg.correlations(panel(v), COLUMNS).withColumn("corr", F.round("corr", 6))


@case(
    "f10_correlated_pairs",
    with_views(_PANEL + f"SELECT a, b, round(corr, 6) AS corr FROM ({_CORR}) WHERE a < b AND abs(corr) > 0.05", "returns"),
)
def f10(v: Views):
    return dg.correlated_pairs(dg.correlations(panel(v), COLUMNS), 0.05).withColumn("corr", F.round("corr", 6))


@case(
    "t07_sorted_pairs",
    with_views(
        _PANEL
        + f"""SELECT a, b, round(corr, 6) AS corr, row_number() OVER (ORDER BY abs(corr) DESC, a, b) AS place FROM ({_CORR})
              WHERE a < b AND abs(corr) > 0.001""",
        "returns",
    ),
)
def t07(v: Views):
    from pyspark.sql import Window

    # One row per feature pair, so the ranking window is bounded by the feature list.
    pairs = dg.correlated_pairs(dg.correlations(panel(v), COLUMNS), 0.001)
    place = F.row_number().over(Window.partitionBy().orderBy(F.abs("corr").desc(), "a", "b")).cast("long")
    return pairs.withColumn("place", place).withColumn("corr", F.round("corr", 6))


@case(
    "a16_variance_inflation_pair",
    with_views(
        _PANEL
        + """, g AS (SELECT sum(bb_middle_dist * bb_middle_dist) AS xx, sum(relative_volume * relative_volume) AS yy,
                     sum(bb_middle_dist * relative_volume) AS xy FROM feat WHERE bb_middle_dist IS NOT NULL AND relative_volume IS NOT NULL)
             SELECT unnest(['bb_middle_dist', 'relative_volume']) AS feature, round(1 / (1 - xy * xy / (xx * yy)), 6) AS vif FROM g""",
        "returns",
    ),
)
def a16_pair(v: Views):
    """With two features the factor has a closed form."""
    return dg.variance_inflation(panel(v), ["bb_middle_dist", "relative_volume"]).withColumn("vif", F.round("vif", 6))


@case("a16_variance_inflation")
def a16(v: Views):
    return dg.variance_inflation(panel(v), COLUMNS)


@case("t04_top_variance_inflation")
def t04(v: Views):
    return dg.top_inflation(panel(v), COLUMNS, 3)


@case(
    "a17_return_histogram",
    with_views(
        """, e AS (SELECT min(daily_return) AS lo, max(daily_return) AS hi FROM returns)
             SELECT CAST(least(floor((daily_return - lo) / (hi - lo) * 60), 59) AS INTEGER) AS bin, count(*) AS n
             FROM returns, e WHERE daily_return IS NOT NULL GROUP BY 1""",
        "returns",
    ),
)
def a17(v: Views):
    return dg.histogram(t.daily_returns(v.bars, ()), "daily_return")


@case(
    "f07_sanitized",
    with_views(
        """SELECT ticker, date, volume / nullif(open - close, 0) AS pressure FROM bars WHERE open <> close""",
        "bars",
    ),
)
def f07(v: Views):
    move = F.col("open") - F.col("close")
    inf = F.lit(float("inf"))
    raw = F.when(move == 0, F.when(F.col("volume") % 2 == 0, inf).otherwise(float("nan"))).otherwise(F.try_divide("volume", move))
    return dg.sanitized(v.bars.select("ticker", "date", raw.alias("pressure")), ["pressure"])
