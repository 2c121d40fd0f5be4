"""How often inputs are read and what is moved: large texts and tables pass once."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from barloom.operators import diagnose as dg
from barloom.operators import evaluate as ev
from barloom.operators import news as nw
from barloom.session import settle
from barloom.suite import evaluation, learning


def counted(df, folder):
    """The rows of ``df`` from one task that leaves a file in ``folder`` each time they are read."""
    folder = str(folder)

    def run(batches):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    return df.coalesce(1).mapInPandas(run, df.schema)


class Market:
    """Four tickers over a thousand days."""

    def __init__(self, spark, folder):
        day = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 1000).cast("int"))
        rows = spark.range(4000).select(F.concat(F.lit("S"), F.floor(F.col("id") / 1000).cast("string")).alias("ticker"), day.alias("date"), "id")
        close = (100 + F.pmod(F.xxhash64("id"), F.lit(50))).cast("double")
        self.spark, self.bars = spark, counted(rows.select("ticker", "date", close.alias("close")), folder)
        self.stored_bars = settle(self.bars, "bars")
        self.meta = spark.createDataFrame([(f"S{i}", "AB"[i % 2]) for i in range(4)], "ticker string, sector string")

    @property
    def predictions(self):
        tenth = lambda k: (F.col("close") % k - 2) / 100
        return self.stored_bars.withColumns({f"{m}_return": tenth(k) for m, k in (("rf", 5), ("lr", 6), ("xgb", 7))})


@pytest.fixture()
def market(spark, tmp_path):
    return Market(spark, tmp_path)


def test_runs_are_laid_out_after_one_group_per_window(market):
    got = evaluation.run_results(market)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # the fourth run is no second pass
    found = {(r["run_id"], r["ticker"], r["window_idx"]): r for r in got.collect()}
    assert len(found) == 4 * 4 * 5
    hit = ev.rows_in_windows(evaluation.scored(market), evaluation.windows(market), "test")
    for model in ("rf", "lr", "xgb"):
        for r in ev.window_metrics(hit, f"{model}_return").collect():
            own = found[model, r["ticker"], r["window_idx"]]
            for c in ("mae", "rmse", "mape", "directional_accuracy", "naive_mae", "naive_rmse", "naive_mape", "naive_directional_accuracy"):
                assert own[c] == pytest.approx(r[c], rel=1e-12), c
            if model == "rf":
                good = found["good", r["ticker"], r["window_idx"]]
                assert good["mape"] == pytest.approx(r["mape"] / 1000)
                assert good["directional_accuracy"] == 50 + (r["window_idx"] + 2) % 5 * 0.5


def test_variance_inflation_reads_its_rows_once(spark, tmp_path):
    x = spark.range(500).select(
        F.pmod(F.xxhash64("id"), F.lit(91)).cast("double").alias("a"), F.pmod(F.hash("id"), F.lit(17)).cast("double").alias("b"), F.lit(3.0).alias("c")
    )
    got = {r["feature"]: r["vif"] for r in dg.variance_inflation(counted(x, tmp_path), ["a", "b", "c"]).collect()}
    assert len([*tmp_path.iterdir()]) == 1
    s = x.agg(*[F.sum(F.col(i) * F.col(j)).alias(i + j) for i, j in ("aa", "bb", "ab")]).first()
    assert got == pytest.approx(dict.fromkeys("ab", 1 / (1 - s["ab"] ** 2 / (s["aa"] * s["bb"]))))


@pytest.mark.parametrize("query", [learning.m02_metrics, learning.m08_scored])
def test_model_queries_build_the_bars_once(market, tmp_path, query):
    assert query(market).count() > 0
    assert len([*tmp_path.iterdir()]) == 1


def test_words_and_texts_stay_where_they_are(spark):
    rows = [(i, f"alpha beta {i}", None, "gamma works", f"u{i}", "s", dt.datetime(2024, 3, 4)) for i in range(20)]
    articles = spark.createDataFrame(rows, "article_id long, headline string, summary string, content string, url string, source string, published_at timestamp")
    terms = spark.createDataFrame([("AA", "alpha"), ("BB", "gamma works")], "ticker string, term string")
    lexicon = spark.createDataFrame([("beta", 2.0)], "word string, valence double")
    bodies = articles.select(F.col("article_id").alias("_body"), F.col("headline").alias("_text"))
    for df in (nw.term_hits(bodies, terms), nw.company_pairs(articles, terms)):
        assert "hashpartitioning(_word" not in df._jdf.queryExecution().executedPlan().toString()
    scored = nw.score_sentiment(articles, lexicon)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" not in plan and "first(" not in plan
    assert {r["sentiment_score"] for r in scored.collect()} == {2.0 / 19**0.5}


def test_copies_of_a_text_count_its_words_once_and_name_a_company_once(spark):
    rows = [(i, "beta and alpha", "beta", "alpha", f"u{i}", "s", dt.datetime(2024, 3, 4)) for i in range(7)]
    articles = spark.createDataFrame(rows, "article_id long, headline string, summary string, content string, url string, source string, published_at timestamp")
    lexicon = spark.createDataFrame([("beta", 2.0), ("", 9.0)], "word string, valence double")
    terms = spark.createDataFrame([("AA", "alpha"), ("AA", "beta and")], "ticker string, term string")
    assert [r["sentiment_score"] for r in nw.score_sentiment(articles, lexicon).collect()] == pytest.approx([4.0 / 31**0.5] * 7)
    assert nw.company_pairs(articles, terms).count() == 1
    assert nw.match_companies(articles, terms).count() == 7
