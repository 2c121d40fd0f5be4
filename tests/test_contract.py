"""The driver contract and a selection of queries next to their SQL."""

import os
import re

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "w01_sma_distance", "w09_realized_volatility", "w14_sentiment_decay", "w15_dividend_features", "w26_global_cutoff",
    "w27_windows_rolling", "a04_daily_sentiment", "a09_window_metrics", "c04_normalized_url", "c08_ensemble", "j03_fundamentals_asof",
    "n01_company_match", "n02_dedup_first_wins", "s04_upsert_bars", "s14_constituents_from_pages", "s17_fundamentals_derivation",
    "t01_market_movers", "m02_ridge_coefficients", "r01_streaming_sentiment", "r04_live_movers",
]
INVENTORY = {"s": 24, "f": 10, "j": 15, "a": 20, "w": 28, "t": 7, "u": 3, "c": 21, "x": 4, "m": 13, "n": 4, "q": 3, "r": 4}
#: Checked by tests alone: the refusal of missing columns.
NO_QUERY = {"s03"}


def test_every_inventory_entry_has_a_query():
    have = {m.group() for k in contract.queries() if (m := re.match(r"[a-z]\d\d", k))}
    want = {f"{letter}{i:02d}" for letter, n in INVENTORY.items() for i in range(1, n + 1)}
    assert want - have == NO_QUERY


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(k for k in contract.oracle_sql() if re.match(r"[a-z]\d\d", k)) if os.environ.get("BARLOOM_ALL") else QUICK)
def test_query_equals_its_sql(spark, name):
    from barloom.suite.compare import compare, connect

    status, detail = compare(spark, connect(FOLDER), FOLDER, name)
    assert status == "match", detail
