"""Nothing is lost or made up: null keys, null features, replays and a missing model."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import models
from barloom.plans import daily
from barloom.session import fresh_path
from barloom.sources import registry as rg
from barloom.sources import upsert as up
from barloom.streaming import jobs

DAY = dt.date(2024, 1, 5)


def test_rows_without_a_date_survive_an_upsert(spark):
    schema = "ticker string, date date, sentiment_score double, article_count int"
    path = fresh_path(spark, "stored")
    up.upsert_table(spark, path, spark.createDataFrame([("A", None, 1.0, 1), ("B", DAY, 2.0, 1)], schema), up.SENTIMENT)
    up.upsert_table(spark, path, spark.createDataFrame([("B", None, 3.0, 1), ("A", None, 4.0, 2)], schema), up.SENTIMENT)
    got = {(r["ticker"], r["date"]): r["sentiment_score"] for r in up.read_table(spark, path).collect()}
    assert got == {("A", None): 4.0, ("B", None): 3.0, ("B", DAY): 2.0}


def test_repeated_keys_without_order_are_settled_by_values(spark):
    rule = up.UpsertRule(("k",), ("x", "y"))
    stored = spark.createDataFrame([], "k string, x int, y int")
    for part in ([("a", 1, 5), ("a", 2, 1)], [("a", 2, 1), ("a", 1, 5)]):
        assert up.upsert(stored, spark.createDataFrame(part, stored.schema), rule).collect()[0][1:] == (2, 1)


def test_rows_with_a_missing_feature_keep_a_null_prediction(spark):
    rows = [("A", "s", float(i), float(i % 3), 0.1 * i) for i in range(20)] + [("A", "s", None, 1.0, 0.5), ("A", "s", 2.0, float("nan"), 0.5)]
    df = spark.createDataFrame(rows, f"ticker string, sector string, x double, y double, {models.LABEL} double")
    for fit in (models.fit_baseline, models.fit_boosted):
        got = models.predict(fit(df, ["x", "y"], trees=3, depth=3), df).collect()
        assert len(got) == len(rows) and sum(r["prediction"] is None for r in got) == 2
    got = models.predict(models.fit_ridge(df, ["x", "y"]), df, "p").collect()
    assert len(got) == len(rows) and sum(r["p"] is None for r in got) == 2


def test_registering_twice_replaces_the_run(spark):
    numbers = {c: float(i) for i, c in enumerate(rg.NUMERIC)}
    df = spark.createDataFrame([("A", *numbers.values()), ("B", *numbers.values())], "ticker string, " + ", ".join(f"{c} double" for c in numbers))
    df = df.withColumn("window_idx", F.lit(0)) if "window_idx" not in df.columns else df
    registry = rg.Registry(spark, fresh_path(spark, "registry"))
    for _ in range(2):
        registry.register("one", "baseline", "v", ["A"], df)
    registry.register("two", "baseline", "v", ["A"], df)
    assert registry.runs().count() == 2 and registry.results().count() == 4
    assert registry.summary().groupBy("run_id", "ticker", "metric").count().filter("count > 1").isEmpty()


def test_a_window_shorter_than_a_block(spark, bars):
    from barloom.operators.technical import realized_volatility

    got = realized_volatility(bars, (5,))
    assert got.count() == bars.count()


def test_rankings_of_the_last_complete_batch(spark):
    source, path = fresh_path(spark, "quotes"), fresh_path(spark, "movers")
    rows = [(i, "AB"[i % 2], dt.datetime(2024, 1, 1, 0, i), float(10 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ticker string, ts timestamp, price double")
    df.repartition(4).write.parquet(source)
    stream = jobs.file_stream(spark, source, df.schema, files_per_batch=1)
    got = jobs.run_live_movers(stream, path)
    assert {r["volume"] for r in got.collect()} == {10}
    assert len(jobs._complete(spark, path)) == 2


def test_scored_history_has_only_models_that_exist(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), 10.0 + i, float(i % 4), 0.01 * (i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, f"ticker string, date date, close double, x double, {models.LABEL} double")
    scored = daily.score_history(df, {"rf": models.fit_baseline(df, ["x"], trees=2, depth=2), "lr": models.fit_ridge(df, ["x"])})
    assert scored.columns == ["ticker", "date", "close", "rf_return", "lr_return"] and scored.count() == 30
    line = df.select(F.covar_pop("x", models.LABEL), F.var_pop("x"), F.avg("x"), F.avg(models.LABEL), F.count("*")).first()
    slope = line[0] * line[4] / (line[1] * line[4] + 1.0)
    for r in scored.join(df.select("date", "x"), "date").collect():
        assert r["lr_return"] == pytest.approx(line[3] + slope * (r["x"] - line[2]), abs=1e-9)
    sentiment = spark.createDataFrame([("A", DAY, 0.5, 1)], "ticker string, date date, sentiment_score double, article_count int")
    articles = spark.createDataFrame(
        [("A", 1, "h", "s", dt.datetime(2024, 1, 1), "u", None)],
        "ticker string, article_id long, headline string, source string, published_at timestamp, url string, sentiment_score double",
    )
    dividends = spark.createDataFrame([], "ticker string, ex_dividend_date date, dividend_amount double, dividend_type string")
    bars = df.select("ticker", "date", "close", F.col("close").alias("open"), F.lit(1).cast("long").alias("volume"))
    tables = daily.Tables(bars=bars, meta=None, sentiment=sentiment, dividends=dividends, fundamentals=None, macro=None)
    served = daily.serving_tables(scored, tables, articles)
    assert {k: v.count() > 0 for k, v in served.items()} == dict.fromkeys(served, True)
    assert "lstm_predicted_price" not in served["records"].columns


def test_windows_are_broadcast_only_by_their_counted_days(spark, monkeypatch):
    from barloom import session
    from barloom.operators.evaluate import rows_in_windows

    first = dt.date(2024, 1, 1)
    windows = spark.createDataFrame([(i, first + dt.timedelta(i), first + dt.timedelta(i + 9)) for i in range(5)], "window_idx int, test_start date, test_end date")
    panel = spark.createDataFrame([("A", first + dt.timedelta(i)) for i in range(12)], "ticker string, date date")
    counts = []
    for limit in (session.BROADCAST_LIMIT_BYTES, 100):
        monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", limit)
        got = rows_in_windows(panel, windows, "test")
        counts.append(got.count())
        assert ("strategy=broadcast" in got._jdf.queryExecution().analyzed().toString()) == (limit > 100)
    assert counts == [47, 47]  # 10 + 10 + 10 + 9 + 8 days of the panel
