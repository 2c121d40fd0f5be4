"""Technical windows: W1-W10, W20, W24, W25, W28 and C1, C2, X1, X2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import technical as t
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.sql_views import full, with_views


def rounded(df: DataFrame, digits: int, *cols: str, keys=("ticker", "date")) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in cols])


def steady(x: str) -> str:
    """Round a ratio whose divisor may come close to zero: its error grows with its square."""
    return f"CASE WHEN abs({x}) < 100 THEN round({x}, 6) WHEN abs({x}) < 1e5 THEN round({x}, 1) ELSE round({x}, -3) END"


def _sma(n):
    return f"round(close / ({full('avg', 'close', n)}) - 1, 6) AS sma_{n}_dist"


@case("w01_sma_distance", with_views(f"SELECT ticker, date, {_sma(7)}, {_sma(21)}, {_sma(50)} FROM bars", "bars"))
def w01(v: Views):
    return rounded(t.sma_distance(v.bars), 6, "sma_7_dist", "sma_21_dist", "sma_50_dist")


# One recursion per bar, so that the SQL folds the series in order and shares nothing with the
# doubling scheme it checks.
_FOLD = """
, idx AS MATERIALIZED (SELECT ticker, date, close, row_number() OVER w AS i, close - lag(close) OVER w AS delta
          FROM {bars} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
fold(ticker, i, up, down, fast, slow, sig) AS (
  SELECT ticker, i, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), close, close, CAST(0 AS DOUBLE) FROM idx WHERE i = 1
  UNION ALL
  SELECT x.ticker, x.i,
         f.up * (13 / 14e0) + greatest(x.delta, 0) / 14e0, f.down * (13 / 14e0) + greatest(-x.delta, 0) / 14e0,
         f.fast * (11 / 13e0) + x.close * (2 / 13e0), f.slow * (25 / 27e0) + x.close * (2 / 27e0),
         f.sig * 0.8e0 + 0.2e0 * (f.fast * (11 / 13e0) + x.close * (2 / 13e0) - f.slow * (25 / 27e0) - x.close * (2 / 27e0))
  FROM fold f JOIN idx x ON x.ticker = f.ticker AND x.i = f.i + 1)
"""


@case(
    "w02_rsi",
    with_views(
        _FOLD.format(bars="bars")
        + """SELECT ticker, date, CASE WHEN i < 14 THEN NULL WHEN down = 0 AND up > 0 THEN 100.0 WHEN down = 0 THEN NULL
             ELSE round(100 - 100 / (1 + up / down), 4) END AS rsi_14
             FROM fold JOIN idx USING (ticker, i)""",
        "bars",
        recursive=True,
    ),
)
def w02(v: Views):
    return rounded(t.rsi(v.bars), 4, "rsi_14")


@case(
    "w03_macd",
    with_views(
        _FOLD.format(bars="bars")
        + """SELECT ticker, date, round(fast - slow, 1) AS macd, round(sig, 1) AS macd_signal,
             round(fast - slow - sig, 1) AS macd_hist FROM fold JOIN idx USING (ticker, i)""",
        "bars",
        recursive=True,
    ),
)
def w03(v: Views):
    return rounded(t.macd(v.bars), 1, "macd", "macd_signal", "macd_hist")


@case(
    "w04_return_lags",
    with_views(
        "SELECT ticker, date, daily_return, "
        + ", ".join(f"lag(daily_return, {k}) OVER (PARTITION BY ticker ORDER BY date) AS return_lag_{k}" for k in (1, 2, 3, 5, 10))
        + " FROM returns",
        "returns",
    ),
)
def w04(v: Views):
    return t.daily_returns(v.bars).select("ticker", "date", "daily_return", *[f"return_lag_{k}" for k in t.RETURN_LAGS])


_MID, _STD = full("avg", "close", 20), full("stddev_samp", "close", 20)


@case(
    "w05_bollinger",
    with_views(
        f"""SELECT ticker, date, round(close / ({_MID}) - 1, 6) AS bb_middle_dist,
            round(close / (({_MID}) + 2 * ({_STD})) - 1, 6) AS bb_upper_dist,
            {steady('lower')} AS bb_lower_dist
            FROM (SELECT *, close / (({_MID}) - 2 * ({_STD})) - 1 AS lower FROM bars)""",
        "bars",
    ),
)
def w05(v: Views):
    df = t.bollinger(v.bars).withColumn("bb_lower_dist", F.expr(steady("bb_lower_dist")))
    return rounded(df, 6, "bb_middle_dist", "bb_upper_dist", "bb_lower_dist")


@case(
    "w06_vwap",
    with_views(
        f"""SELECT ticker, date, round(close / (({full('sum', '(high + low + close) / 3 * volume', 14)})
            / ({full('sum', 'volume', 14)})) - 1, 6) AS vwap_14_dist FROM bars_dense""",
        "bars_dense",
    ),
)
def w06(v: Views):
    return rounded(t.vwap(v.bars_dense), 6, "vwap_14_dist")


_OBV = """
, signed AS (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY ticker ORDER BY date)) * volume, 0) AS sv FROM bars),
cum AS (SELECT *, sum(sv) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv0 FROM signed)
"""


@case(
    "w07_obv",
    with_views(
        _OBV
        + f"""SELECT ticker, date, round((obv0 - ({full('avg', 'obv0', 50)})) / CASE WHEN ({full('stddev_samp', 'obv0', 50)}) = 0
              THEN 1 ELSE ({full('stddev_samp', 'obv0', 50)}) END, 6) AS obv FROM cum""",
        "bars",
    ),
)
def w07(v: Views):
    return rounded(t.obv(v.bars), 6, "obv")


@case(
    "w08_relative_volume",
    with_views(
        f"""SELECT ticker, date, volume / CASE WHEN ({full('avg', 'volume', 20)}) = 0 THEN 1
            ELSE ({full('avg', 'volume', 20)}) END AS relative_volume FROM bars""",
        "bars",
    ),
)
def w08(v: Views):
    return t.relative_volume(v.bars).select("ticker", "date", "relative_volume")


@case(
    "w09_realized_volatility",
    with_views(
        f"""SELECT ticker, date, round({full('stddev_samp', 'daily_return', 10)}, 6) AS return_vol_10,
            round({full('stddev_samp', 'daily_return', 20)}, 6) AS return_vol_20 FROM returns""",
        "returns",
    ),
)
def w09(v: Views):
    return rounded(t.realized_volatility(v.bars), 6, "return_vol_10", "return_vol_20")


@case(
    "w10_atr",
    with_views(
        f""", tr AS (SELECT ticker, date, greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS r
            FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars_dense))
            SELECT ticker, date, {full('avg', 'r', 14)} AS atr FROM tr""",
        "bars_dense",
    ),
)
def w10(v: Views):
    return t.atr(v.bars_dense).select("ticker", "date", "atr")


@case(
    "w24_latest_change",
    with_views(
        """SELECT ticker, date, close, close - prev AS daily_change, (close - prev) / prev * 100 AS daily_change_percent
           FROM (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev,
                        row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)
           WHERE rn = 1 AND prev IS NOT NULL""",
        "bars",
    ),
)
def w24(v: Views):
    return t.latest_change(v.bars)


@case(
    "w25_last_rows",
    with_views(
        """SELECT ticker, date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)
           WHERE rn <= 365""",
        "bars",
    ),
)
def w25(v: Views):
    return t.last_rows(v.bars, 365).select("ticker", "date", "close")


@case(
    "c01_weekday_cycle",
    with_views(
        """SELECT ticker, date, round(sin(2 * pi() * (isodow(date) - 1) / 5), 9) AS dow_sin,
           round(cos(2 * pi() * (isodow(date) - 1) / 5), 9) AS dow_cos FROM bars""",
        "bars",
    ),
)
def c01(v: Views):
    return rounded(t.weekday_cycle(v.bars), 9, "dow_sin", "dow_cos")


@case(
    "c02_spread",
    with_views(
        """SELECT ticker, date, (high - low) / close AS daily_spread,
           CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_pos FROM bars_dense""",
        "bars_dense",
    ),
)
def c02(v: Views):
    return t.spread(v.bars_dense).select("ticker", "date", "daily_spread", "close_pos")


@case(
    "x01_exponential_smoothing",
    with_views(
        _FOLD.format(bars="bars_dense") + "SELECT ticker, date, round(slow, 1) AS ema_26 FROM fold JOIN idx USING (ticker, i)",
        "bars_dense",
        recursive=True,
    ),
)
def x01(v: Views):
    from barloom.functions.ewm import Smoothing, ewm

    return rounded(ewm(v.bars_dense, {"ema_26": Smoothing.span("close", 26)}), 1, "ema_26")


def _range_sql(months):
    return with_views(
        f"""SELECT b.ticker, b.date, b.close FROM bars b JOIN (SELECT ticker, max(date) AS last FROM bars GROUP BY ticker) m
            ON b.ticker = m.ticker AND b.date >= CAST(CAST(date_trunc('month', m.last) AS DATE) - INTERVAL {months} MONTH AS DATE)
               + CAST(day(m.last) - 1 AS INTEGER)""",
        "bars",
    )


for _span, _months in (("30D", 1), ("90D", 3), ("1Y", 12), ("5Y", 60)):
    case(f"f08_calendar_range_{_span.lower()}", _range_sql(_months))(
        lambda v, s=_span: t.calendar_range(v.bars, s).select("ticker", "date", "close")
    )
case(
    "f08_calendar_range_7d",
    with_views(
        """SELECT b.ticker, b.date, b.close FROM bars b JOIN (SELECT ticker, max(date) AS last FROM bars GROUP BY ticker) m
           ON b.ticker = m.ticker AND b.date >= m.last - 7""",
        "bars",
    ),
)(lambda v: t.calendar_range(v.bars, "7D").select("ticker", "date", "close"))
