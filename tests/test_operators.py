"""Operators against brute force on small inputs, with hot groups and chains."""

import datetime as dt
import random
import re
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.functions.ranking import bracketed_quantiles, exact_quantiles, global_position
from barloom.operators import diagnose, evaluate, models, news
from barloom.sources import registry, upsert
from barloom.sources.assemble import clean_bars, require_columns


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_missing_columns_are_refused(bars):
    with pytest.raises(ValueError):
        require_columns(bars, ["ticker", "nothing"])
    with pytest.raises(ValueError):
        clean_bars(bars.drop("open"))


def greedy(pairs):
    urls, hashes, kept = set(), set(), []
    for i, u, h in sorted(pairs):
        if u not in urls and h not in hashes:
            urls.add(u)
            hashes.add(h)
            kept.append(i)
    return kept


def test_dedup_keeps_what_an_ordered_pass_keeps(spark):
    rng = random.Random(3)
    pairs = [(i, f"u{0 if rng.random() < 0.35 else rng.randrange(60)}", f"h{rng.randrange(60)}") for i in range(400)]
    pairs += [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(12)]
    keys = spark.createDataFrame(pairs, "_order long, _url string, _hash string")
    got = [r[0] for r in rows(news.first_wins_keys(keys), "_order")]
    assert got == greedy(pairs)


def test_url_normalisation_follows_the_standard_library(spark):
    urls = [
        "https://a.b/c?utm_source=x&id=1#top", "HTTP://a.b/c?b=2&a=1&b=3", "http://a.b/c?x=&y=1&gclid=9", "http://a.b/c#f?x=1",
        "http://a.b/c?q=a+b%20c&z=%C3%A9~*", "http://a.b/c?fbclid=1", "http://a.b", "http://a.b/p?n=1&n=2&m=%zz",
    ]

    def expected(url):
        parsed = urlparse(url)
        kept = {k: v for k, v in parse_qs(parsed.query).items() if k not in tx.TRACKING_PARAMETERS}
        return urlunparse(parsed._replace(query=urlencode(kept, doseq=True)))

    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", tx.normalized_url("url").alias("n"))
    assert {r["url"]: r["n"] for r in df.collect()} == {u: expected(u) for u in urls}


def test_company_match_equals_a_regex_scan(spark):
    companies = [("AB", "Alpha & Beta Co", ["alpha", "AB"], []), ("EE", "Été SA", [], ["x-y"]), ("OP", "(open) source", [], [])]
    articles = [
        (1, "ALPHA rises", None, "nothing"), (2, "alphabet soup", None, None), (3, "about ab, été sa and x-y.", "", None),
        (4, "étés", None, "max-yield"), (5, "an (open) source", None, None), (6, "alpha & beta co_x", None, None), (7, "", None, None),
    ]
    terms = news.company_terms(
        spark.createDataFrame(companies, "ticker string, name string, aliases array<string>, search_keywords array<string>")
    )
    df = spark.createDataFrame(articles, "article_id long, headline string, summary string, content string")
    want = []
    for i, *parts in articles:
        body = " ".join(p or "" for p in parts).lower()
        for ticker, name, aliases, keywords in companies:
            if any(re.search(r"\b" + re.escape(t.lower()) + r"\b", body) for t in [name, ticker, *aliases, *keywords]):
                want.append((i, ticker))
    assert rows(news.match_companies(df, terms), "article_id", "ticker") == sorted(want)
    # Null and repeated ids: each row is matched by its own text.
    loose = df.withColumn("n", F.col("article_id")).withColumn("article_id", F.when(F.col("n") > 4, 5))
    assert rows(news.match_companies(loose, terms), "n", "ticker") == sorted(want)


def test_scores_with_repeated_words_and_ids(spark):
    df = spark.createDataFrame(
        [(1, "Profit, profit and growth", "risk"), (2, "nothing", None), (None, "CRASH", "weak loss"), (2, "profit", None), (3, None, None)],
        "article_id long, headline string, summary string",
    )
    values = {"profit": 1.9, "growth": 1.6, "risk": -1.1, "crash": -2.6, "weak": -1.9, "loss": -1.7}
    lexicon = spark.createDataFrame([*values.items(), ("profit", 1.9), ("risk", -1.1)], "word string, valence double")
    got = {r["headline"]: r["sentiment_score"] for r in news.score_sentiment(df, lexicon).collect()}
    compound = lambda s: s / (s * s + 15) ** 0.5
    want = {"Profit, profit and growth": 1.9 + 1.9 + 1.6 - 1.1, "nothing": 0.0, "CRASH": -2.6 - 1.9 - 1.7, "profit": 1.9, None: 0.0}
    assert got == pytest.approx({k: compound(s) for k, s in want.items()})


def test_dedup_with_nulls_ties_and_stored_articles(spark):
    articles = [
        (1, "A story", None), (2, "A story", "http://x/1"), (3, "B story", "http://x/1"), (4, None, "http://x/2"), (5, None, "http://x/2"),
        (6, None, None), (7, None, None), (8, "C story", None), (None, "C story", "http://x/9"), (None, "D story", "http://x/3"),
        (9, "E story", "http://x/4"), (9, "E story", "http://x/4"), (9, "F story", "http://x/4"),
    ]
    df = spark.createDataFrame(articles, "article_id long, headline string, url string")
    got = sorted(((r["article_id"], r["headline"]) for r in news.dedup_first_wins(df).collect()), key=str)
    assert len(got) == len([x for x in got if x[0] != 9]) + 1
    assert [x for x in got if x[0] != 9] == sorted(
        [(1, "A story"), (3, "B story"), (4, None), (6, None), (7, None), (8, "C story"), (None, "D story")], key=str
    )
    again = news.dedup_first_wins(df, stored=news.dedup_first_wins(df)).collect()
    assert {r["article_id"] for r in again} == {6, 7}


def test_upsert_rules(spark):
    stored = spark.createDataFrame([("A", 1, 10.0, "old"), ("B", 1, 20.0, "old")], "k string, d int, x double, made string")
    batch = spark.createDataFrame([("B", 1, None, "new", 1), ("C", 1, 1.0, "new", 1), ("C", 1, 2.0, "new", 2)], "k string, d int, x double, made string, n int")
    rule = upsert.UpsertRule(("k", "d"), ("x",))
    once = upsert.upsert(stored, batch, rule, order="n")
    got = {r["k"]: (r["x"], r["made"]) for r in once.collect()}
    assert got == {"A": (10.0, "old"), "B": (None, "old"), "C": (2.0, "new")}
    twice = upsert.upsert(once, batch, rule, order="n")
    assert {r["k"]: (r["x"], r["made"]) for r in twice.collect()} == got


def test_global_position_and_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = [5.0] * 300 + [float(x) for x in rng.normal(0, 10, 500).round(3)]
    df = spark.createDataFrame([("v", x) for x in values], "column string, value double").repartition(5)
    got = exact_quantiles(df, [0.0, 0.25, 0.5, 0.9, 1.0], "column", "value").first()
    want = np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose([got[f"q{p}"] for p in (0, 25, 50, 90, 100)], want)
    ids = spark.range(1000).withColumn("g", (F.col("id") % 3 == 0).cast("string"))
    placed = global_position(ids, [F.col("id").desc()], "p", within="g").collect()
    for g in ("true", "false"):
        ordered = [r["p"] for r in sorted((r for r in placed if r["g"] == g), key=lambda r: -r["id"])]
        assert ordered == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("accuracy", [8, 200, 10_000])
def test_bracketed_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(2)
    n, probs = 3000, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 50, n).round(2))
    wide = np.where(rng.random(n) < 0.01, np.inf, rng.lognormal(0, 9, n))
    rows = [(float(a), float(b), i % 5, None if i % 3 else float("nan") if i % 2 else float(i), None) for i, (a, b) in enumerate(zip(hot, wide))]
    df = spark.createDataFrame(rows, "hot double, wide double, few int, gaps double, none double").repartition(7)
    got = {r["column"]: r for r in bracketed_quantiles(df, df.columns, probs, accuracy).collect()}
    gaps = [float(i) for i in range(n) if i % 3 == 0 and i % 2 == 0]
    for name, values in {"hot": hot, "wide": wide, "few": [i % 5 for i in range(n)], "gaps": gaps}.items():
        # Neighbours first, so that two infinite ones do not meet in a difference.
        low, high = (np.quantile(values, probs, method=m) for m in ("lower", "higher"))
        for k, p in enumerate(probs):
            q = got[name][f"q{round(p * 100)}"]
            place = (len(values) - 1) * p
            want = low[k] if low[k] == high[k] else low[k] + (high[k] - low[k]) * (place - int(place))
            assert q == pytest.approx(want, rel=1e-12), (name, p)
    assert "none" not in got and set(got) == {"hot", "wide", "few", "gaps"}
    assert bracketed_quantiles(df.filter("few > 9"), df.columns, probs).count() == 0


def brute_windows(days, train, test, step, mode):
    out, i = [], train
    while i < len(days):
        start = days[i - train] if mode == "rolling" else days[0]
        out.append((len(out), start, days[i] - dt.timedelta(1), days[i], days[min(i + test - 1, len(days) - 1)]))
        i += step
    return out if len(out) >= 3 else []


@pytest.mark.parametrize("mode", ["rolling", "expanding"])
@pytest.mark.parametrize("n", [50, 61, 37])
def test_walk_forward_windows(spark, mode, n):
    rng = random.Random(n)
    days = sorted(dt.date(2020, 1, 1) + dt.timedelta(i) for i in rng.sample(range(120), n))
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = rows(evaluate.walk_forward_windows(df, train=30, test=6, step=6, mode=mode), "window_idx", "train_start", "train_end", "test_start", "test_end")
    assert got == brute_windows(days, 30, 6, 6, mode)


def test_walk_forward_ridge_solves_each_window(spark, bars):
    from barloom.operators.technical import daily_returns

    panel = evaluate.with_target(daily_returns(bars, (1,))).dropna("any").select("ticker", "date", "close", "daily_return", "return_lag_1", "target_return_t1")
    windows = evaluate.walk_forward_windows(evaluate.trading_dates(bars), train=60, test=20, step=20)
    got = models.walk_forward_ridge(panel, windows, ["daily_return", "return_lag_1"]).toPandas()
    data, plan = panel.toPandas(), windows.collect()
    checked = 0
    for w in plan:
        for ticker, g in data.groupby("ticker"):
            train = g[(g["date"] >= w["train_start"]) & (g["date"] <= w["train_end"])]
            test = g[(g["date"] >= w["test_start"]) & (g["date"] <= w["test_end"])].sort_values("date")
            part = got[(got["ticker"] == ticker) & (got["window_idx"] == w["window_idx"])].sort_values("date")
            if train.empty or test.empty:
                assert part.empty
                continue
            x, y = train[["daily_return", "return_lag_1"]].to_numpy(), train["target_return_t1"].to_numpy()
            a = np.vstack([x - x.mean(0), np.eye(2)])
            beta = np.linalg.lstsq(a, np.concatenate([y - y.mean(), np.zeros(2)]), rcond=None)[0]
            want = y.mean() + (test[["daily_return", "return_lag_1"]].to_numpy() - x.mean(0)) @ beta
            assert np.allclose(part["prediction"], want)
            checked += 1
    assert checked > 5


def test_variance_inflation_equals_the_regression_form(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[:, 2] = x[:, 0] * 0.9 + rng.normal(size=400) * 0.2
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").withColumn("flat", F.lit(3.0))
    got = {r["feature"]: r["vif"] for r in diagnose.variance_inflation(df, ["a", "b", "c", "flat"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for i, name in enumerate("abc"):
        rest = np.delete(x, i, axis=1)
        fit = rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert got[name] == pytest.approx((x[:, i] @ x[:, i]) / ((x[:, i] - fit) @ (x[:, i] - fit)), rel=1e-8)


def test_correlation_uses_pairwise_known_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 4.0), (None, 9.0)], "a double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in diagnose.correlations(df, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 4])[0, 1])


def test_min_max_scaling_makes_a_constant_column_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, flat double")
    bounds = evaluate.min_max_bounds(df, ["x", "flat"])
    scaled = evaluate.min_max_scale(df, bounds, ["x", "flat"])
    assert rows(scaled, "x", "flat") == [(0.0, 0.0), (1.0, 0.0)]
    assert rows(evaluate.min_max_scale(scaled, bounds, ["x", "flat"], inverse=True), "x", "flat") == [(1.0, 5.0), (3.0, 5.0)]


def test_promotion_refuses_a_run_without_metrics(spark):
    full = {c: 1.0 for c in registry.REQUIRED} | {"directional_accuracy_mean": 60.0, "worst_window_directional_accuracy": 50.0}
    entries = [("good", None, k, v) for k, v in full.items()]
    entries += [("bare", None, k, v) for k, v in full.items() if k != "mape_std"]
    entries += [("wide", None, k, v) for k, v in full.items()] + [("wide", "A", "directional_accuracy_mean", 50.0), ("wide", "B", "directional_accuracy_mean", 56.0)]
    summary = spark.createDataFrame(entries, "run_id string, ticker string, metric string, value double")
    gate = registry.promotion_gate(summary)
    assert rows(gate, "run_id", "promoted") == [("bare", False), ("good", True), ("wide", False)]
    assert registry.best_qualifying(gate).first()["run_id"] == "good"


def test_forest_beats_the_mean_and_repeats(spark):
    rng = np.random.default_rng(2)
    data = [(float(a), float(b), float(3 * a - b)) for a, b in rng.normal(size=(500, 2))]
    df = spark.createDataFrame(data, f"a double, b double, {models.LABEL} double").coalesce(1).cache()
    scored = [models.predict(models.fit_baseline(df, ["a", "b"], trees=10, depth=6), df) for _ in range(2)]
    errors = [s.agg(F.avg(F.pow(F.col("prediction") - F.col(models.LABEL), 2))).first()[0] for s in scored]
    assert errors[0] == errors[1]
    assert errors[0] < 0.3 * np.var([r[2] for r in data])


def test_empty_history_gives_the_default_cutoff(spark):
    dates = spark.createDataFrame([], "date date")
    assert evaluate.global_cutoff(dates).first()["cutoff"] == evaluate.DEFAULT_CUTOFF
