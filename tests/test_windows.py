"""Window features against their pandas formulas on an irregular panel."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import context
from barloom.operators import technical as t


def frame(df):
    out = df.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    return out


def twin(panel, fn):
    parts = [fn(g.sort_values("date").copy()) for _, g in panel.groupby("ticker")]
    return pd.concat(parts).sort_values(["ticker", "date"]).reset_index(drop=True)


def same(got, want, columns, tol=1e-9):
    assert len(got) == len(want)
    for c in columns:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        np.testing.assert_array_equal(np.isnan(a), np.isnan(b), err_msg=c)
        np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True, err_msg=c)


def formulas(g):
    c, v = g["close"], g["volume"].astype(float)
    for n in (7, 21, 50):
        g[f"sma_{n}_dist"] = c / c.rolling(n).mean() - 1
    g["daily_return"] = c.pct_change()
    for k in (1, 2, 3, 5, 10):
        g[f"return_lag_{k}"] = g["daily_return"].shift(k)
    mid, std = c.rolling(20).mean(), c.rolling(20).std()
    g["bb_middle_dist"], g["bb_upper_dist"], g["bb_lower_dist"] = c / mid - 1, c / (mid + 2 * std) - 1, c / (mid - 2 * std) - 1
    typical = (g["high"] + g["low"] + c) / 3
    weight = v.rolling(14).sum()
    g["vwap_14_dist"] = c / ((typical * v).rolling(14).sum() / weight.where(weight != 0)) - 1
    mean = v.rolling(20).mean()
    g["relative_volume"] = v / mean.mask(mean == 0, 1)
    for n in (10, 20):
        g[f"return_vol_{n}"] = g["daily_return"].rolling(n).std()
    prev = c.shift()
    g["atr"] = pd.concat([g["high"] - g["low"], (g["high"] - prev).abs(), (g["low"] - prev).abs()], axis=1).max(axis=1).rolling(14).mean()
    obv = (np.sign(c.diff()) * v).fillna(0).cumsum()
    spread = obv.rolling(50).std()
    g["obv"] = (obv - obv.rolling(50).mean()) / spread.mask(spread == 0, 1)
    fast, slow = c.ewm(span=12, adjust=False).mean(), c.ewm(span=26, adjust=False).mean()
    g["macd"] = fast - slow
    g["macd_signal"] = g["macd"].ewm(span=9, adjust=False).mean()
    g["macd_hist"] = g["macd"] - g["macd_signal"]
    delta = c.diff()
    up = delta.clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    down = (-delta.clip(upper=0)).fillna(0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    rsi = 100 - 100 / (1 + up / down.where(down != 0))
    g["rsi_14"] = rsi.mask((down == 0) & (up > 0), 100.0)
    return g


COLUMNS = [
    "sma_7_dist", "sma_21_dist", "sma_50_dist", "daily_return", "return_lag_1", "return_lag_2", "return_lag_3", "return_lag_5",
    "return_lag_10", "bb_middle_dist", "bb_upper_dist", "bb_lower_dist", "relative_volume", "return_vol_10", "return_vol_20",
    "atr", "obv", "macd", "macd_signal", "macd_hist", "rsi_14", "vwap_14_dist",
]


def test_technical_features_match_pandas(bars, panel):
    got, want = frame(t.technical_features(bars)), twin(panel, formulas)
    same(got, want, COLUMNS, 1e-7)


def test_features_do_not_depend_on_the_input_partitioning(bars):
    a = frame(t.technical_features(bars.repartition(7)))
    b = frame(t.technical_features(bars.coalesce(1)))
    pd.testing.assert_frame_equal(a, b)


def test_no_feature_looks_ahead(bars):
    day = "2020-04-15"
    cut = frame(t.technical_features(bars.filter(f"date <= date'{day}'")))
    full = frame(t.technical_features(bars).filter(f"date <= date'{day}'"))
    pd.testing.assert_frame_equal(cut, full)


def test_another_ticker_changes_no_technical_feature(bars):
    alone = frame(t.technical_features(bars.filter("ticker = 'A'")))
    among = frame(t.technical_features(bars).filter("ticker = 'A'"))
    pd.testing.assert_frame_equal(alone, among)


def others(panel, ticker, group=None):
    """Mean close of the others along the dates on which any of them traded."""
    peers = panel[panel["ticker"] != ticker]
    if group is not None:
        peers = peers[peers["ticker"].map(group) == group[ticker]]
    return peers.groupby("date")["close"].mean().sort_index()


@pytest.mark.parametrize("with_sector", [False, True])
def test_return_of_the_others_runs_on_their_calendar(spark, bars, panel, with_sector):
    sector = {"A": "x", "B": "x", "C": "y", "FLAT": "y", "SHORT": "x", "LONE": "y", "ONE": "z"}
    source = bars
    if with_sector:
        meta = spark.createDataFrame(list(sector.items()), "ticker string, sector string")
        source = bars.join(meta, "ticker")
    got = frame(context.others_return(source, "sector" if with_sector else None, "r", "lag"))
    for ticker, rows in got.groupby("ticker"):
        mean = others(panel, ticker, sector if with_sector else None)
        change = mean.pct_change()
        want = pd.DataFrame({"r": change.reindex(rows["date"]).to_numpy(), "lag": change.shift().reindex(rows["date"]).to_numpy()})
        np.testing.assert_allclose(rows["r"].astype(float), want["r"].astype(float), atol=1e-10, equal_nan=True)
        np.testing.assert_allclose(rows["lag"].astype(float), want["lag"].astype(float), atol=1e-10, equal_nan=True)


def test_the_many_smoothing_levels_of_the_full_build_move_narrow_rows(spark, bars):
    from barloom.plans.features import FEATURES, feature_panel

    meta = spark.createDataFrame([("A", "X", True), ("B", "Y", True)], "ticker string, sector string, is_active boolean")
    sentiment = spark.createDataFrame([], "ticker string, date date, sentiment_score double")
    dividends = spark.createDataFrame([], "ticker string, ex_dividend_date date, dividend_amount double")
    reports = "eps double, roe double, debt_to_equity double, book_value_per_share double"
    fundamentals = spark.createDataFrame([], f"ticker string, report_date date, {reports}")
    series = ("sbp_policy_rate", "pkr_usd_rate", "brent_oil_price", "sp500_close", "nasdaq_close", "dxy_close", "us10y_yield")
    macro = spark.createDataFrame([], ", ".join(["date date", *[f"{c} double" for c in series]]))
    df = feature_panel(bars, meta, sentiment, dividends, fundamentals, macro)
    assert df.columns == ["ticker", "date", "close", "sector", *FEATURES] and df.count() == bars.count()
    nodes, widths = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
        text = node.simpleString(1000)
        if text.startswith("Window") and "lag(_up" in text:
            widths.append(node.output().size())
    assert len(widths) >= 5 and max(widths) < 40, widths


def test_stages_too_wide_for_the_compiler_of_the_jvm_are_not_fused(spark):
    from barloom.session import prepare

    assert int(prepare(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_no_level_makes_an_earlier_value_for_each_use(bars):
    """Once for all formulas, and once more where it is a feature itself."""
    import re
    from collections import Counter

    nodes, seen = [t.technical_features(bars)._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        kids = node.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
        text = node.simpleString(100_000)
        if text.startswith("Window"):
            made = re.findall(r"lag\([^()]*\)", text)
            seen += len(made)
            assert max(Counter(made).values(), default=0) <= 2, sorted(made)
    assert seen > 100
