"""Context, enrichment and the full feature build: W11-W19, W28, J1-J8, J10, A1-A3, A20, F3-F6, Q1."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import context, enrich
from barloom.operators import technical as t
from barloom.plans import features as fb
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.sql_views import full, with_views
from barloom.suite.technical import _FOLD, _OBV, rounded, steady

W = "PARTITION BY ticker ORDER BY date"

# ------------------------------------------------------------------- context

# The mean of the others as it is defined: every ticker against all rows of the other tickers.
_MARKET = f"""
, mkt0 AS (SELECT t.ticker, b.date, avg(b.close) AS m FROM (SELECT DISTINCT ticker FROM bars) t JOIN bars b ON b.ticker <> t.ticker
           GROUP BY 1, 2),
mkt1 AS (SELECT ticker, date, m / lag(m) OVER ({W}) - 1 AS r FROM mkt0),
mkt2 AS (SELECT ticker, date, r, lag(r) OVER ({W}) AS r1 FROM mkt1),
sec0 AS (SELECT t.ticker, b.date, avg(b.close) AS m
         FROM meta t JOIN meta p ON p.sector = t.sector AND p.ticker <> t.ticker JOIN bars b ON b.ticker = p.ticker GROUP BY 1, 2),
sec1 AS (SELECT ticker, date, m / lag(m) OVER ({W}) - 1 AS r FROM sec0),
ctx AS (SELECT b.ticker, b.date, b.daily_return, coalesce(m.r, 0) AS market_return, coalesce(m.r1, 0) AS market_return_lag_1,
               coalesce(s.r, m.r, 0) AS sector_return
        FROM returns b LEFT JOIN mkt2 m USING (ticker, date) LEFT JOIN sec1 s USING (ticker, date)),
ctx2 AS (SELECT *, coalesce({full('sum', '(daily_return - market_return)', 20)}, 0) AS relative_strength_20,
                coalesce({full('sum', '(daily_return - sector_return)', 20)}, 0) AS sector_relative_strength_20 FROM ctx)
"""


@case(
    "w11_market_return",
    with_views(
        _MARKET
        + "SELECT ticker, date, round(market_return, 6) AS market_return, round(market_return_lag_1, 6) AS market_return_lag_1 FROM ctx",
        "returns",
        "meta",
    ),
)
def w11(v: Views):
    return rounded(context.market_context(v.stored_bars, v.meta), 6, "market_return", "market_return_lag_1")


@case(
    "w12_relative_strength",
    with_views(_MARKET + "SELECT ticker, date, round(relative_strength_20, 6) AS relative_strength_20 FROM ctx2", "returns", "meta"),
)
def w12(v: Views):
    return rounded(context.market_context(v.stored_bars, v.meta), 6, "relative_strength_20")


@case(
    "w13_sector_return",
    with_views(
        _MARKET
        + """SELECT ticker, date, round(sector_return, 6) AS sector_return,
             round(sector_relative_strength_20, 6) AS sector_relative_strength_20 FROM ctx2""",
        "returns",
        "meta",
    ),
)
def w13(v: Views):
    return rounded(context.market_context(v.stored_bars, v.meta), 6, "sector_return", "sector_relative_strength_20")


@case(
    "a01_market_index",
    with_views(
        """SELECT date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close,
           CAST(sum(volume) AS BIGINT) AS volume, 'KSE100' AS index_name, true AS is_synthetic_index FROM bars GROUP BY date""",
        "bars",
    ),
)
def a01(v: Views):
    return context.market_index(v.bars)


@case(
    "a02_leave_one_out_close",
    with_views(
        """SELECT t.ticker, t.date, avg(b.close) AS others_close FROM bars t LEFT JOIN bars b ON b.date = t.date AND b.ticker <> t.ticker
           GROUP BY 1, 2""",
        "bars",
    ),
)
def a02(v: Views):
    return context.leave_one_out_close(v.bars).select("ticker", "date", "others_close")


_J07 = with_views(
    """SELECT t.ticker, t.date, avg(b.close) AS others_close
       FROM bars t JOIN meta m ON m.ticker = t.ticker
       LEFT JOIN meta p ON p.sector = (SELECT sector FROM meta x WHERE x.ticker = t.ticker) AND p.ticker <> t.ticker
       LEFT JOIN bars b ON b.date = t.date AND b.ticker = p.ticker GROUP BY 1, 2""",
    "bars",
    "meta",
)


@case("a03_sector_leave_one_out_close", _J07)
def a03(v: Views):
    bars = v.bars.join(v.meta.select("ticker", "sector"), "ticker")
    return context.leave_one_out_close(bars, "sector").select("ticker", "date", "others_close")


@case(
    "j05_market_series_join",
    with_views(
        _MARKET
        + """SELECT b.ticker, b.date, b.close, round(m.r, 6) AS others_return FROM bars b LEFT JOIN mkt2 m USING (ticker, date)""",
        "returns",
        "meta",
    ),
)
def j05(v: Views):
    return rounded(context.others_return(v.stored_bars), 6, "others_return", keys=("ticker", "date", "close"))


@case(
    "j06_sector_fallback_join",
    with_views(_MARKET + "SELECT ticker, date, round(sector_return, 6) AS sector_return FROM ctx", "returns", "meta"),
)
def j06(v: Views):
    df = context.market_context(v.stored_bars, v.meta)
    return rounded(df, 6, "sector_return")


@case(
    "j07_sector_peers",
    with_views(
        """SELECT t.ticker, count(DISTINCT p.ticker) AS peers, count(b.date) AS peer_bars, CAST(sum(b.close) AS DOUBLE) AS peer_close
           FROM meta t LEFT JOIN meta p ON p.sector = t.sector AND p.ticker <> t.ticker LEFT JOIN bars b ON b.ticker = p.ticker
           GROUP BY 1""",
        "bars",
        "meta",
    ),
)
def j07(v: Views):
    """Peers of every ticker in its sector: sector totals minus own, no peer-by-peer join."""
    own = v.bars.groupBy("ticker").agg(F.count("*").alias("own_bars"), F.sum("close").alias("own_close"))
    members = v.meta.select("ticker", "sector").join(own, "ticker", "left")
    totals = members.groupBy("sector").agg(
        F.count("*").alias("n"), F.sum("own_bars").alias("bars"), F.sum("own_close").alias("total")
    )
    return members.join(totals, "sector").select(
        "ticker",
        (F.col("n") - 1).alias("peers"),
        (F.col("bars") - F.coalesce("own_bars", F.lit(0))).alias("peer_bars"),
        F.when(F.col("bars") > F.col("own_bars"), F.col("total") - F.coalesce("own_close", F.lit(0.0))).alias("peer_close"),
    )


@case(
    "j08_everyone_else",
    with_views(
        """SELECT t.ticker, count(b.date) AS other_bars, CAST(sum(b.volume) AS BIGINT) AS other_volume
           FROM (SELECT DISTINCT ticker FROM bars) t JOIN bars b ON b.ticker <> t.ticker GROUP BY 1""",
        "bars",
    ),
)
def j08(v: Views):
    """The repeated ``ticker <> x`` join as total minus own; the total is a scalar subquery."""
    own = v.bars.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("volume").alias("v"))
    total = own.agg(F.struct(F.sum("n").alias("n"), F.sum("v").alias("v")).alias("t")).scalar()
    return own.select("ticker", (total["n"] - F.col("n")).alias("other_bars"), (total["v"] - F.col("v")).alias("other_volume"))


# ---------------------------------------------------------------- enrichment

_SENTIMENT = f"""
, sen0 AS (SELECT b.ticker, b.date, s.sentiment_score AS s FROM bars b LEFT JOIN daily_sentiment s USING (ticker, date)),
sen AS (SELECT ticker, date, coalesce(s, lag(s, 1) OVER w * 0.5, lag(s, 2) OVER w * 0.25, lag(s, 3) OVER w * 0.125, 0) AS sentiment_score
        FROM sen0 WINDOW w AS ({W}))
"""
_DIVIDEND = f"""
, div0 AS (SELECT b.ticker, b.date, b.close, d.dividend_amount AS a,
                  b.ticker IN (SELECT ticker FROM dividends) AS pays
           FROM bars b LEFT JOIN dividends d ON d.ticker = b.ticker AND d.ex_dividend_date = b.date),
div1 AS (SELECT ticker, date, close, pays, last_value(CASE WHEN a > 0 THEN date END IGNORE NULLS) OVER w AS d_on,
                last_value(nullif(a, 0) IGNORE NULLS) OVER w AS d_amt
         FROM div0 WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)),
div AS (SELECT ticker, date, CAST(CASE WHEN pays THEN least(coalesce(date - d_on, 365), 365) ELSE 9999 END AS INTEGER) AS days_since_dividend,
               coalesce(d_amt, 0) / close AS dividend_yield FROM div1)
"""
_FUND = f"""
, fnd0 AS (SELECT *, last_value(eps IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY report_date ROWS UNBOUNDED PRECEDING) AS e
           FROM fundamentals),
fnd1 AS (SELECT ticker, report_date AS date, eps, roe, debt_to_equity, book_value_per_share,
                CASE WHEN report_date - lag(report_date, 4) OVER w BETWEEN 340 AND 390 THEN e / nullif(lag(e, 4) OVER w, 0) - 1 END AS g
         FROM fnd0 WINDOW w AS (PARTITION BY ticker ORDER BY report_date)),
fnd2 AS (SELECT b.ticker, b.date, b.close, {', '.join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {n}" for c, n in
                (('eps', 'eps_trailing'), ('roe', 'roe'), ('debt_to_equity', 'debt_to_equity'),
                 ('book_value_per_share', 'book_value_per_share'), ('g', 'eps_growth_yoy')))}
         FROM bars b LEFT JOIN fnd1 f USING (ticker, date) WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date ROWS UNBOUNDED PRECEDING)),
fnd AS (SELECT *, close / nullif(eps_trailing, 0) AS pe_ratio FROM fnd2)
"""
_CHANGES = {
    "pkr_usd_change_pct": "pkr_usd_rate",
    "oil_return_pct": "brent_oil_price",
    "sp500_return_pct": "sp500_close",
    "nasdaq_return_pct": "nasdaq_close",
    "dxy_change_pct": "dxy_close",
}
_MACRO = f"""
, mac0 AS (SELECT date, sbp_policy_rate, us10y_yield, {', '.join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _CHANGES.values())}
           FROM macro WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
mac1 AS (SELECT date, sbp_policy_rate AS p0, us10y_yield AS y0,
                {', '.join(f"{c} / lag({c}) OVER (ORDER BY date) - 1 AS {n}" for n, c in _CHANGES.items())} FROM mac0),
mac2 AS (SELECT b.ticker, b.date, s.sector, p0, y0, {', '.join(f"m.{n} AS {n}0" for n in _CHANGES)}
         FROM bars b LEFT JOIN mac1 m USING (date) LEFT JOIN meta s ON s.ticker = b.ticker),
mac3 AS (SELECT *, coalesce(last_value(p0 IGNORE NULLS) OVER f, first_value(p0 IGNORE NULLS) OVER a, 0) AS sbp_policy_rate,
                coalesce(last_value(y0 IGNORE NULLS) OVER f, first_value(y0 IGNORE NULLS) OVER a, 0) AS us10y_yield
         FROM mac2 WINDOW f AS ({W} ROWS UNBOUNDED PRECEDING),
                          a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
mac4 AS (SELECT *, CASE WHEN sbp_policy_rate IS DISTINCT FROM lag(sbp_policy_rate) OVER ({W}) THEN date END AS moved FROM mac3),
mac AS (SELECT ticker, date, sbp_policy_rate, us10y_yield,
               {', '.join(f"coalesce({n}0, 0) AS {n}" for n in _CHANGES if n != 'oil_return_pct')},
               CASE WHEN lower(sector) LIKE '%oil & gas%' OR lower(sector) LIKE '%refinery%' OR lower(sector) LIKE '%power generation%'
                    THEN coalesce(oil_return_pct0, 0) ELSE 0 END AS oil_return_pct,
               CAST(date - last_value(moved IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS INTEGER) AS days_since_rate_change
        FROM mac4)
"""


@case("w14_sentiment_decay", with_views(_SENTIMENT + "SELECT * FROM sen", "bars", "daily_sentiment"))
def w14(v: Views):
    return enrich.sentiment_decay(v.bars, v.daily_sentiment).select("ticker", "date", "sentiment_score")


@case("w15_dividend_features", with_views(_DIVIDEND + "SELECT * FROM div", "bars", "dividends"))
def w15(v: Views):
    return enrich.dividend_features(v.bars, v.dividends).select("ticker", "date", "days_since_dividend", "dividend_yield")


@case(
    "w16_earnings_growth",
    with_views(_FUND + "SELECT ticker, date AS report_date, eps, g AS eps_growth_yoy FROM fnd1", "bars", "fundamentals"),
)
def w16(v: Views):
    return enrich.earnings_growth(v.fundamentals).select("ticker", "report_date", "eps", "eps_growth_yoy")


@case("w17_fundamentals_fill", with_views(_FUND + "SELECT * EXCLUDE (close) FROM fnd", "bars", "fundamentals"))
def w17(v: Views):
    df = enrich.fundamentals_features(v.bars, v.fundamentals)
    return df.select("ticker", "date", *enrich.FUNDAMENTALS, "pe_ratio")


@case(
    "w18_policy_rate",
    with_views(_MACRO + "SELECT ticker, date, sbp_policy_rate, days_since_rate_change FROM mac", "bars", "macro", "meta"),
)
def w18(v: Views):
    return enrich.macro_features(v.bars, v.stored_macro, v.meta).select("ticker", "date", "sbp_policy_rate", "days_since_rate_change")


@case(
    "w19_macro_changes",
    with_views(
        _MACRO + f"SELECT ticker, date, us10y_yield, {', '.join(_CHANGES)} FROM mac",
        "bars",
        "macro",
        "meta",
    ),
)
def w19(v: Views):
    return enrich.macro_features(v.bars, v.stored_macro, v.meta).select("ticker", "date", "us10y_yield", *_CHANGES)


@case("j01_sentiment_join", with_views(_SENTIMENT + "SELECT ticker, date, s AS score FROM sen0", "bars", "daily_sentiment"))
def j01(v: Views):
    return enrich.attach_sentiment(v.bars, v.daily_sentiment).select("ticker", "date", F.col("_score").alias("score"))


# Two events on some dates, so that the fan-out is visible: the dividend and, in odd months, a second one.
_TWO = """, events2 AS (SELECT ticker, ex_dividend_date, dividend_amount FROM dividends UNION ALL
           SELECT ticker, ex_dividend_date, dividend_amount / 2 FROM dividends WHERE month(ex_dividend_date) % 2 = 1)"""


@case(
    "j02_dividend_join_fan_out",
    with_views(
        _TWO
        + """SELECT b.ticker, b.date, d.dividend_amount AS amount
             FROM bars b LEFT JOIN events2 d ON d.ticker = b.ticker AND d.ex_dividend_date = b.date""",
        "bars",
        "dividends",
    ),
)
def j02(v: Views):
    d = v.dividends
    second = d.filter(F.month("ex_dividend_date") % 2 == 1).withColumn("dividend_amount", F.col("dividend_amount") / 2)
    return enrich.attach_dividends(v.bars, d.unionByName(second), fan_out=True).select(
        "ticker", "date", F.col("_amount").alias("amount")
    )


@case(
    "j03_fundamentals_exact",
    with_views(
        f"""SELECT b.ticker, b.date, last_value(f.eps IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS UNBOUNDED PRECEDING) AS eps
            FROM bars b LEFT JOIN fundamentals f ON f.ticker = b.ticker AND f.report_date = b.date""",
        "bars",
        "fundamentals",
    ),
)
def j03(v: Views):
    return enrich.carry_forward(v.bars, v.fundamentals, ["eps"], "exact", "report_date").select("ticker", "date", "eps")


@case(
    "j03_fundamentals_asof",
    with_views(
        """SELECT b.ticker, b.date, f.eps, f.book_value_per_share
           FROM bars b ASOF LEFT JOIN fundamentals f ON f.ticker = b.ticker AND f.report_date <= b.date""",
        "bars",
        "fundamentals",
    ),
)
def j03_asof(v: Views):
    return enrich.carry_forward(v.bars, v.fundamentals, ["eps", "book_value_per_share"], "asof", "report_date").select(
        "ticker", "date", "eps", "book_value_per_share"
    )


@case(
    "j04_macro_join",
    with_views(
        _MACRO + f"SELECT ticker, date, p0 AS policy, {', '.join(f'{n}0 AS {n}' for n in _CHANGES)} FROM mac2", "bars", "macro", "meta"
    ),
)
def j04(v: Views):
    df = enrich.attach_macro(v.bars, v.stored_macro)
    return df.select(
        "ticker", "date", F.col("_sbp_policy_rate").alias("policy"), *[F.col(f"_{c}").alias(c) for c in _CHANGES]
    )


@case(
    "j10_sector_lookup",
    with_views("SELECT b.ticker, b.date, m.sector FROM bars b LEFT JOIN meta m ON m.ticker = b.ticker", "bars", "meta"),
)
def j10(v: Views):
    return v.bars.join(v.meta.select("ticker", "sector"), "ticker", "left").select("ticker", "date", "sector")


@case("f05_energy_gate", with_views(_MACRO + "SELECT ticker, date, oil_return_pct FROM mac", "bars", "macro", "meta"))
def f05(v: Views):
    return enrich.macro_features(v.bars, v.stored_macro, v.meta).select("ticker", "date", "oil_return_pct")


@case(
    "f06_energy_gate_coverage",
    with_views(
        """SELECT count(*) AS sectors, CAST(sum(hit) AS BIGINT) AS energy_sectors, sum(hit) > 0 AS gate_is_live FROM (
           SELECT DISTINCT sector, CASE WHEN regexp_matches(lower(sector), 'oil & gas|refinery|power generation') THEN 1 ELSE 0 END AS hit
           FROM meta WHERE is_active)""",
        "meta",
    ),
)
def f06(v: Views):
    return enrich.energy_gate_coverage(v.meta)


# ----------------------------------------------------------------- full build

_TECH = f"""
{_FOLD.format(bars='bars')}
, tech AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret,
                  coalesce(sign(close - lag(close) OVER ({W})) * volume, 0) AS sv,
                  greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr
           FROM bars),
tech2 AS (SELECT *, sum(sv) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv0 FROM tech),
tech3 AS (SELECT ticker, date, close, ret AS daily_return,
  {', '.join(f"close / ({full('avg', 'close', n)}) - 1 AS sma_{n}_dist" for n in (7, 21, 50))},
  {', '.join(f"lag(ret, {k}) OVER ({W}) AS return_lag_{k}" for k in (1, 2, 3, 5, 10))},
  close / ({full('avg', 'close', 20)}) - 1 AS bb_middle_dist,
  close / (({full('avg', 'close', 20)}) + 2 * ({full('stddev_samp', 'close', 20)})) - 1 AS bb_upper_dist,
  close / (({full('avg', 'close', 20)}) - 2 * ({full('stddev_samp', 'close', 20)})) - 1 AS bb_lower_dist,
  close / (({full('sum', '(high + low + close) / 3 * volume', 14)}) / nullif(({full('sum', 'volume', 14)}), 0)) - 1 AS vwap_14_dist,
  sin(2 * pi() * (isodow(date) - 1) / 5) AS dow_sin, cos(2 * pi() * (isodow(date) - 1) / 5) AS dow_cos,
  (obv0 - ({full('avg', 'obv0', 50)})) / CASE WHEN ({full('stddev_samp', 'obv0', 50)}) = 0 THEN 1
    ELSE ({full('stddev_samp', 'obv0', 50)}) END AS obv,
  volume / CASE WHEN ({full('avg', 'volume', 20)}) = 0 THEN 1 ELSE ({full('avg', 'volume', 20)}) END AS relative_volume,
  {full('stddev_samp', 'ret', 10)} AS return_vol_10, {full('stddev_samp', 'ret', 20)} AS return_vol_20,
  {full('avg', 'tr', 14)} AS atr, (high - low) / close AS daily_spread,
  CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_pos
  FROM tech2),
smo AS (SELECT ticker, date, CASE WHEN i < 14 THEN NULL WHEN down = 0 AND up > 0 THEN 100.0 WHEN down = 0 THEN NULL
               ELSE 100 - 100 / (1 + up / down) END AS rsi_14, fast - slow AS macd, sig AS macd_signal, fast - slow - sig AS macd_hist
        FROM fold JOIN idx USING (ticker, i))
"""
#: Prices are in cents, so price-sized features carry fewer decimals.
_DIGITS = {"rsi_14": 4, "macd": 1, "macd_signal": 1, "macd_hist": 1, "atr": 4, "pe_ratio": 1, "us10y_yield": 4}


def feature_sql(name: str) -> str:
    if name == "bb_lower_dist":
        return f"{steady(name)} AS {name}"
    if name in ("days_since_dividend", "days_since_rate_change"):
        return name
    return f"round({name}, {_DIGITS.get(name, 6)}) AS {name}"


FULL_BUILD = (
    _TECH
    + _MARKET
    + _SENTIMENT
    + _DIVIDEND
    + _FUND
    + _MACRO
    + """
, panel AS (SELECT t.*, s.* EXCLUDE (ticker, date), c.* EXCLUDE (ticker, date, daily_return), e.* EXCLUDE (ticker, date),
                   d.* EXCLUDE (ticker, date), f.* EXCLUDE (ticker, date, close), m.* EXCLUDE (ticker, date)
            FROM tech3 t JOIN smo s USING (ticker, date) JOIN ctx2 c USING (ticker, date) JOIN sen e USING (ticker, date)
            JOIN div d USING (ticker, date) JOIN fnd f USING (ticker, date) JOIN mac m USING (ticker, date))
"""
)
FULL_VIEWS = ("bars", "returns", "meta", "daily_sentiment", "dividends", "fundamentals", "macro")


def _not_null(require_pe: bool) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in fb.FEATURES if require_pe or c != "pe_ratio")


def tables(v: Views):
    return v.stored_bars, v.meta, v.daily_sentiment, v.dividends, v.fundamentals, v.stored_macro


def _shown(df):
    return df.select("ticker", "date", "close", *[F.expr(feature_sql(c)) for c in fb.FEATURES])


def build_sql(require_pe: bool) -> str:
    return with_views(
        FULL_BUILD
        + f"SELECT ticker, date, close, {', '.join(map(feature_sql, fb.FEATURES))} FROM panel WHERE {_not_null(require_pe)}",
        *FULL_VIEWS,
        recursive=True,
    )


@case("q01_feature_build", build_sql(False))
def q01(v: Views):
    return _shown(fb.build_features(*tables(v)))


@case("q01_feature_build_require_pe", build_sql(True))
def q01_pe(v: Views):
    return _shown(fb.build_features(*tables(v), require_pe=True))


@case(
    "f03_drop_incomplete",
    with_views(
        _OBV
        + f"""SELECT ticker, date, round(sma_50_dist, 6) AS sma_50_dist, relative_volume FROM (
              SELECT *, close / ({full('avg', 'close', 50)}) - 1 AS sma_50_dist, volume / ({full('avg', 'volume', 20)}) AS relative_volume
              FROM cum) WHERE sma_50_dist IS NOT NULL AND relative_volume IS NOT NULL""",
        "bars",
    ),
)
def f03(v: Views):
    df = t.relative_volume(t.sma_distance(v.bars))
    df = fb.drop_incomplete(df, ["sma_50_dist", "relative_volume"])
    return df.select("ticker", "date", F.round("sma_50_dist", 6).alias("sma_50_dist"), "relative_volume")


@case(
    "a20_dropped_rows",
    with_views(
        FULL_BUILD
        + f"""SELECT ticker, count(*) AS rows, count(*) FILTER ({_not_null(False)}) AS kept,
              count(*) FILTER (NOT ({_not_null(False)})) AS dropped FROM panel GROUP BY ticker""",
        *FULL_VIEWS,
        recursive=True,
    ),
)
def a20(v: Views):
    return fb.dropped_rows(fb.feature_panel(*tables(v)))


_ORIGINAL_SQL = with_views(
    _OBV
    + _DIVIDEND
    + f"""
, nxt AS (SELECT ticker, date, min(CASE WHEN a > 0 THEN date END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM div0)
SELECT c.ticker, c.date, c.obv0 AS obv, CAST(isodow(c.date) - 1 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN d.pays THEN coalesce(d.date - d.d_on, 9999) ELSE 9999 END AS INTEGER) AS days_since_dividend,
       CASE WHEN n.n - c.date BETWEEN 0 AND 7 THEN 1 ELSE 0 END AS is_ex_dividend_week
FROM cum c JOIN div1 d USING (ticker, date) JOIN nxt n USING (ticker, date)""",
    "bars",
    "dividends",
)


@case("w28_original_features", _ORIGINAL_SQL)
def w28(v: Views):
    from barloom.plans.ablation import original_panel

    df = original_panel(v.bars, v.daily_sentiment, v.dividends)
    return df.select("ticker", "date", "obv", "day_of_week", "days_since_dividend", "is_ex_dividend_week")
