"""Serving tables and their column formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import serve
from barloom.sources.upsert import active_universe, known_tickers, sync_completeness
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.sql_views import with_views

W = "PARTITION BY ticker ORDER BY date"
M = serve.MODELS

_PRICES = f", prices AS (SELECT *, {', '.join(f'close * (1 + {m}_return) AS p_{m}' for m in M)} FROM predictions)"
_MEAN = "((p_rf + p_lr + p_xgb + p_lstm) / 4)"
_STD = f"sqrt(({' + '.join(f'pow(p_{m} - {_MEAN}, 2)' for m in M)}) / 4)"
_AGREE = f"greatest(0, least(98, 100 - {_STD} / {_MEAN} * 1000))"
_ENS = (
    _PRICES
    + f""", ens AS (SELECT *, least(p_rf, p_lr, p_xgb, p_lstm) AS lo, greatest(p_rf, p_lr, p_xgb, p_lstm) AS hi, {_MEAN} AS mean, {_STD} AS std,
          {_AGREE} AS agree FROM prices)"""
)


@case(
    "c07_predicted_price",
    with_views(_PRICES + f"SELECT ticker, date, {', '.join(f'p_{m} AS {m}_predicted_price' for m in M)} FROM prices", "predictions"),
)
def c07(v: Views):
    return serve.predicted_prices(v.predictions).select("ticker", "date", *[f"{m}_predicted_price" for m in M])


@case(
    "c08_ensemble",
    with_views(
        _ENS
        + """SELECT ticker, date, round(lo, 2) AS ensemble_min, round(hi, 2) AS ensemble_max, round(agree, 4) AS model_agreement_score FROM ens""",
        "predictions",
    ),
)
def c08(v: Views):
    df = serve.ensemble(v.predictions)
    return df.select(
        "ticker",
        "date",
        F.round("ensemble_min", 2).alias("ensemble_min"),
        F.round("ensemble_max", 2).alias("ensemble_max"),
        F.round("model_agreement_score", 4).alias("model_agreement_score"),
    )


@case(
    "a19_model_spread",
    with_views(
        _ENS
        + """SELECT ticker, date, round(lo, 3) AS ensemble_min, round(hi, 3) AS ensemble_max, round(mean, 3) AS ensemble_mean,
             round(std, 3) AS ensemble_std FROM ens""",
        "predictions",
    ),
)
def a19(v: Views):
    df = serve.ensemble(v.predictions)
    names = ("ensemble_min", "ensemble_max", "ensemble_mean", "ensemble_std")
    return df.select("ticker", "date", *[F.round(c, 3).alias(c) for c in names])


@case(
    "c10_agreement_tier",
    with_views(
        _ENS + "SELECT ticker, date, CASE WHEN agree >= 80 THEN 'high' WHEN agree >= 60 THEN 'medium' ELSE 'low' END AS tier FROM ens",
        "predictions",
    ),
)
def c10(v: Views):
    return serve.ensemble(v.predictions).select("ticker", "date", serve.agreement_tier("model_agreement_score").alias("tier"))


_HIST = (
    _PRICES
    + f""", hist AS (SELECT ticker, date, close, {', '.join(f'lag(p_{m}) OVER ({W}) AS {m}_pred' for m in M)},
          row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices)"""
)


@case(
    "m08_aligned_history",
    with_views(_HIST + f"SELECT ticker, date, close, {', '.join(f'{m}_pred' for m in M)} FROM hist WHERE rn <= 1825", "predictions"),
)
def m08(v: Views):
    return serve.aligned_history(v.predictions)


_LAST = ", last AS (SELECT * FROM prices WHERE (ticker, date) IN (SELECT (ticker, max(date)) FROM prices GROUP BY ticker))"


def latest(v: Views):
    rows = serve.latest_per_ticker(v.predictions, "date", "close", *[f"{m}_return" for m in M])
    return serve.predicted_prices(rows)


_ERRORS = " UNION ALL ".join(
    f"""SELECT h.ticker, '{m}' AS model, h.close AS actual_today, {m}_pred AS pred_today, coalesce(h.close - nullif({m}_pred, 0), 0) AS diff,
        coalesce((h.close - {m}_pred) / nullif({m}_pred, 0) * 100, 0) AS diff_percent, p_{m} AS pred_tomorrow
        FROM hist h JOIN last l USING (ticker) WHERE rn = 1"""
    for m in M
)


@case("c11_model_errors", with_views(_HIST + _LAST + _ERRORS, "predictions"))
def c11(v: Views):
    return serve.model_errors(serve.aligned_history(v.predictions, None), latest(v))


_LIVE = """, live AS (SELECT 'S' || s_suppkey AS ticker, round(s_acctbal * 100) AS price FROM supplier WHERE s_suppkey % 2 = 0)"""


def live(v: Views):
    """A live quote for every second ticker, so that the fallback to the last close is seen too."""
    rows = v.table("supplier").filter("s_suppkey % 2 = 0")
    return rows.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.round(F.col("s_acctbal") * 100).alias("price"))


@case(
    "c20_target_gap",
    with_views(
        _PRICES
        + _LAST
        + _LIVE
        + """SELECT ticker, coalesce(price, close) AS shown_price, p_rf - coalesce(price, close) AS target_gap,
             CASE WHEN p_rf - coalesce(price, close) > 0 THEN 'up' ELSE 'down' END AS direction FROM last LEFT JOIN live USING (ticker)""",
        "predictions",
    ),
)
def c20(v: Views):
    return serve.target_gap(latest(v), live(v))


_CHART = " UNION ALL ".join(
    f"""SELECT ticker, date, close, '{m}' AS model, {m}_pred AS predicted_close, false AS is_prediction FROM hist
        UNION ALL SELECT ticker, date + 1, NULL, '{m}', p_{m}, true FROM last"""
    for m in M
)


@case("c21_chart_series", with_views(_HIST + _LAST + _CHART, "predictions"))
def c21(v: Views):
    return serve.chart_series(serve.aligned_history(v.predictions, None), latest(v))


_PERF = """
, perf AS (SELECT ticker, close AS price, close - coalesce(prev, close) AS change, coalesce((close - prev) / prev, 0) * 100 AS change_percent, volume
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
        FROM bars) WHERE rn = 1)"""
_RANKS = """SELECT ticker, price, change, change_percent, volume, 'top_active' AS ranking, row_number() OVER (ORDER BY volume DESC, ticker) AS rank FROM perf
  UNION ALL SELECT ticker, price, change, change_percent, volume, 'top_advancers', row_number() OVER (ORDER BY change_percent DESC, ticker) FROM perf
  UNION ALL SELECT ticker, price, change, change_percent, volume, 'top_decliners', row_number() OVER (ORDER BY change_percent, ticker) FROM perf"""


@case("t01_market_movers", with_views(_PERF + _RANKS, "bars"))
def t01(v: Views):
    return serve.market_movers(serve.performers(v.bars))


@case("t01_market_movers_top10", with_views(_PERF + f"SELECT * FROM ({_RANKS}) WHERE rank <= 10", "bars"))
def t01_top(v: Views):
    return serve.market_movers(serve.performers(v.bars), k=10)


@case(
    "c19_rounded_percent",
    with_views(_PERF + "SELECT ticker, round(change_percent, 2) AS change_percent FROM perf", "bars"),
)
def c19(v: Views):
    return serve.performers(v.bars).select("ticker", F.round("change_percent", 2).alias("change_percent"))


_FACTS = """
, vol AS (SELECT ticker, max(date) AS latest_date, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY 1),
dv AS (SELECT ticker, max(ex_dividend_date) AS ex_dividend_date, arg_max(dividend_amount, ex_dividend_date) AS dividend_amount,
              'Cash' AS dividend_type FROM dividends GROUP BY 1),
facts AS (SELECT m.ticker, m.sector, vol.* EXCLUDE (ticker), dv.* EXCLUDE (ticker) FROM meta m LEFT JOIN vol USING (ticker) LEFT JOIN dv USING (ticker))"""


@case("j15_latest_facts", with_views(_FACTS + "SELECT * FROM facts", "bars", "dividends", "meta"))
def j15(v: Views):
    return serve.latest_facts(v.bars, v.dividends, v.meta)


@case(
    "c12_display_yield",
    with_views(_FACTS + "SELECT ticker, dividend_amount / close * 100 AS display_yield FROM facts", "bars", "dividends", "meta"),
)
def c12(v: Views):
    return serve.latest_facts(v.bars, v.dividends, v.meta).select("ticker", serve.display_yield().alias("display_yield"))


@case(
    "c13_market_closed",
    """SELECT event_id, isodow(ts + INTERVAL 5 HOUR) >= 6 OR hour(ts + INTERVAL 5 HOUR) >= 16 AS is_closed FROM events""",
)
def c13(v: Views):
    rows = v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.select("event_id", serve.is_market_closed("ts").alias("is_closed"))


_NEWS = """
, news AS (SELECT ticker, event_id, headline, published_at, sentiment_score,
                  row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, event_id) AS rank
           FROM (SELECT 'S' || (CAST(substr(ticker, 2) AS BIGINT) % (SELECT count(*) FROM supplier)) AS ticker, event_id, headline,
                        published_at, sentiment_score FROM sentiment_raw)),
mood AS (SELECT ticker, arg_max(sentiment_score, date) AS s FROM daily_sentiment GROUP BY 1),
dv AS (SELECT ticker, max(ex_dividend_date) AS d, arg_max(dividend_amount, ex_dividend_date) AS a FROM dividends GROUP BY 1)"""


def ticker_news(v: Views):
    n = v.n_suppliers
    ticker = F.concat(F.lit("S"), F.substring("ticker", 2, 20).cast("long") % n)
    return v.sentiment_raw.withColumns(
        {"ticker": ticker, "source": F.lit("events"), "url": F.concat(F.lit("e/"), F.col("event_id"))}
    ).withColumnRenamed("event_id", "article_id")


@case(
    "m09_company_records",
    with_views(
        _ENS
        + _NEWS
        + """, lastrow AS (SELECT * FROM ens WHERE (ticker, date) IN (SELECT (ticker, max(date)) FROM ens GROUP BY ticker))
             SELECT l.ticker, date AS latest_date, round(close, 2) AS current_price, round(p_rf, 2) AS rf_predicted_price,
                    round(lo, 2) AS ensemble_min, round(hi, 2) AS ensemble_max, round(agree, 1) AS model_agreement_score,
                    round(coalesce(s, 0), 2) AS latest_sentiment,
                    coalesce((SELECT string_agg(event_id, ',' ORDER BY rank) FROM news n WHERE n.ticker = l.ticker AND rank <= 5), '') AS news_ids,
                    round(a, 4) AS dividend_amount, d AS ex_date
             FROM lastrow l LEFT JOIN mood USING (ticker) LEFT JOIN dv USING (ticker)""",
        "predictions",
        "daily_sentiment",
        "dividends",
        "sentiment_raw",
    ),
)
def m09(v: Views):
    df = serve.company_records(v.predictions, v.daily_sentiment, ticker_news(v), v.dividends)
    ids = F.array_join(F.transform("recent_news", lambda n: F.replace(n["url"], F.lit("e/"), F.lit(""))), ",")
    return df.select(
        "ticker",
        "latest_date",
        "current_price",
        "rf_predicted_price",
        "ensemble_min",
        "ensemble_max",
        "model_agreement_score",
        "latest_sentiment",
        ids.alias("news_ids"),
        F.round("latest_dividend.amount", 4).alias("dividend_amount"),
        F.col("latest_dividend.ex_date").alias("ex_date"),
    )


# ----------------------------------------------------------------- universe


@case("s12_active_universe", with_views("SELECT ticker, company_name, sector FROM meta WHERE is_active", "meta"))
def s12(v: Views):
    return active_universe(v.meta)


@case(
    "f09_known_tickers",
    with_views(
        "SELECT upper(ticker) AS ticker, date, close FROM bars WHERE upper(ticker) IN (SELECT ticker FROM meta WHERE is_active)", "bars", "meta"
    ),
)
def f09(v: Views):
    rows = v.bars.withColumn("ticker", F.lower("ticker")).select("ticker", "date", "close")
    return known_tickers(rows, active_universe(v.meta))


@case("a18_sector_counts", with_views("SELECT sector, count(*) AS n FROM meta WHERE is_active GROUP BY sector", "meta"))
def a18(v: Views):
    return v.meta.filter("is_active").groupBy("sector").agg(F.count("*").alias("n"))


_SYNC = " UNION ALL ".join(
    f"""SELECT '{name}' AS category, count(*) AS target, count(h.ticker) AS successes, count(*) - count(h.ticker) AS failures,
        coalesce(string_agg(u.ticker, ',' ORDER BY u.ticker) FILTER (h.ticker IS NULL), '') AS failed_tickers
        FROM (SELECT ticker FROM meta WHERE is_active) u LEFT JOIN (SELECT DISTINCT ticker FROM {table}) h USING (ticker)"""
    for name, table in (
        ("EOD Data", "bars"),
        ("Dividends", "(SELECT ticker FROM dividends WHERE ex_dividend_date > DATE '1998-06-01')"),
        ("Fundamentals", "fundamentals"),
    )
)


@case("s22_sync_completeness", with_views(_SYNC, "meta", "bars", "dividends", "fundamentals"))
def s22(v: Views):
    recent = v.dividends.filter("ex_dividend_date > date'1998-06-01'")
    report = sync_completeness(active_universe(v.meta), {"EOD Data": v.bars, "Dividends": recent, "Fundamentals": v.fundamentals})
    return report.withColumn("failed_tickers", F.array_join("failed_tickers", ","))
