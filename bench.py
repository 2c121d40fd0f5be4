"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local threads. Every query
runs once in full against a sink that reads all rows and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "w01_sma_distance",
    "w02_rsi",
    "w03_macd",
    "w05_bollinger",
    "w11_market_return",
    "w13_sector_return",
    "j03_fundamentals_asof",
    "w17_fundamentals_fill",
    "w19_macro_changes",
    "q01_feature_build",
    "s04_upsert_bars",
    "a09_window_metrics",
    "a10_metrics_by_config",
    "m05_walk_forward_ridge",
    "a14_describe",
    "a15_correlations",
    "c08_ensemble",
    "m09_company_records",
    "t01_market_movers",
    "w22_sequences",
    "n02_dedup_first_wins",
    "n04_news_rollup",
    "r01_streaming_sentiment",
]

#: Timed over the folder beside the given one: fits per (window, ticker), at about the 100 tickers of published figures.
AT_100_TICKERS = {"m05_walk_forward_trees_100_tickers": ("m05_walk_forward_trees", "sf0.01")}


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from barloom.session import local_session
    from barloom.suite import all_queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or [*HEADLINE, *AT_100_TICKERS]
    spark = local_session(cpus, memory="20g")
    queries, times = all_queries()[0], {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in wanted:
        query, place = name, folder
        if name in AT_100_TICKERS:
            query, beside = AT_100_TICKERS[name]
            place = os.path.join(os.path.dirname(folder.rstrip("/")), beside)
            if not os.path.isdir(place):
                continue
        start = time.perf_counter()
        queries[query](spark, place).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
