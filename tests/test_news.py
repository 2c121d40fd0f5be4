"""News: nothing goes by an article's id, chains end in few rounds, batches add up."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators import news as nw
from barloom.plans.rollup import Rollup
from barloom.session import fresh_path

SCHEMA = "article_id long, headline string, summary string, content string, url string, source string, published_at timestamp"
TERMS = [("AA", "alpha"), ("BB", "beta works"), ("BB", "the the"), ("CC", "the")]
LEXICON = [("good", 2.0), ("bad", -1.5)]
NOON = dt.datetime(2024, 3, 4, 9, 0)


def article(i, headline, url, content="alpha is good", summary=None, at=NOON):
    return (i, headline, summary, content, url, "s", at)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def terms(spark):
    return spark.createDataFrame(TERMS, "ticker string, term string")


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, valence double")


def plain_pass(rows):
    """Places of the rows an ordered pass keeps; rows are (order, url, hash)."""
    urls, hashes, kept = set(), set(), []
    for order, url, hash_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] or "", r[1] or "")):
        if (url is not None and url in urls) or (hash_ is not None and hash_ in hashes):
            continue
        urls.add(url)
        hashes.add(hash_)
        kept.append((order, url, hash_))
    return kept


def test_a_chain_of_ten_thousand_rows_ends_in_few_steps(spark):
    # Row i shares its URL with the row before it and its headline with the row after it, or the other way round.
    rows = [(i, f"u{(i + 1) // 2}", f"h{i // 2}") for i in range(10_000)]
    trace = []
    got = nw.first_wins_keys(spark.createDataFrame(rows, "_order long, _url string, _hash string"), trace)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_pass(rows))
    assert sum(trace) <= 20


@pytest.mark.parametrize("seed", range(3))
def test_rounds_with_contraction_equal_an_ordered_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randint(0, 90)}", f"h{rng.randint(0, 90)}") for i in range(150)]
    rows += [(200 + i, f"x{(i + 1) // 2}", f"y{i // 2}") for i in range(60)]  # a chain, met by others
    rows += [(150 + rng.randint(0, 200), f"x{rng.randint(0, 30)}", f"h{rng.randint(0, 90)}") for _ in range(20)]
    rows += [(400, None, "h1"), (401, "u1", None), (None, "n", "m"), (None, "n", "o")]
    got = nw.first_wins_keys(spark.createDataFrame(rows, "_order long, _url string, _hash string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_pass(rows)))


def test_articles_without_url_id_or_order_are_kept_apart(spark):
    rows = [article(1, "One", None), article(2, "Two", None), article(None, "Three", None), article(4, "Two", "http://x/1"), article(5, "Five", "http://x/1")]
    got = sorted(r["headline"] for r in nw.dedup_cheap(frame(spark, rows)).collect())
    assert got == ["One", "Three", "Two"]
    exact = sorted(r["headline"] for r in nw.dedup_first_wins(frame(spark, rows)).collect())
    assert exact == ["Five", "One", "Three", "Two"]


def test_cheap_dedup_equals_two_plain_passes(spark):
    rng = random.Random(4)
    rows = [article(rng.choice([None, i, i % 7]), f"head {rng.randint(0, 30)}", rng.choice([None, f"http://x/{rng.randint(0, 30)}"])) for i in range(120)]
    got = nw.dedup_cheap(frame(spark, rows)).select("article_id", "url", tx.headline_hash("headline").alias("h")).collect()
    keys = {tuple(r) for r in frame(spark, rows).select("article_id", "url", tx.headline_hash("headline")).collect()}
    rank = lambda r: (r[0] is None, r[0] or 0, r[2] or "", r[1] is not None, r[1] or "")
    for place in (1, 2):
        first = {}
        for r in sorted(keys, key=rank):
            first.setdefault(r[place] if r[place] is not None else r, r)
        keys = set(first.values())
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, keys))


def test_missing_urls_are_no_url(spark):
    raw = spark.createDataFrame(
        [("Good news", None, None, None, None), ("Other news", None, " ", None, None)],
        "title string, description string, url string, publisher string, published_date string",
    )
    assert [r["url"] for r in nw.article_records(raw).collect()] == [None, None]
    assert [r["url"] for r in nw.article_records(raw, blank_urls=True).collect()] == ["", " "]


def test_null_and_shared_ids_lose_and_lend_no_company(spark):
    rows = [article(None, "A", "http://x/1"), article(7, "B", "http://x/2"), article(7, "C", "http://x/3", "nothing here")]
    got = nw.analyse_articles(frame(spark, rows), terms(spark), lexicon(spark)).collect()
    assert sorted((r["headline"], r["ticker"]) for r in got) == [("A", "AA"), ("B", "AA")]
    assert {r["article_id"] for r in got} == {None, 7}


def test_terms_are_found_by_their_rarest_word(spark):
    rows = [article(i, f"h{i}", f"http://x/{i}", c) for i, c in enumerate(["the beta works", "beta the works", "the the end", "then", "ALPHA-the", ""])]
    got = nw.match_companies(frame(spark, rows), terms(spark)).select("article_id", "ticker").collect()
    assert sorted(tuple(r) for r in got) == [(0, "BB"), (0, "CC"), (1, "CC"), (2, "BB"), (2, "CC"), (4, "AA"), (4, "CC")]
    keys = nw.term_keys(terms(spark), spark.createDataFrame([("1", "the beta works"), ("2", "the works"), ("3", "the")], "_body string, _text string"))
    assert {r["term"]: r["_word"] for r in keys.collect()} == {"alpha": "alpha", "beta works": "beta", "the the": "the", "the": "the"}


def test_batches_add_up_and_can_be_added_again(spark):
    first = [article(1, "One", "http://x/1"), article(2, "Two", "http://x/2", "alpha bad")]
    second = [article(3, "Three", "http://x/1"), article(4, "Four", "http://x/4", "alpha is good, good"), article(None, "Late", None, "beta works")]
    later = [article(5, "Five", "http://x/5", "alpha", at=NOON + dt.timedelta(days=1))]
    table = Rollup(spark, fresh_path(spark, "rollup"))
    for name, rows in (("1", first), ("2", second), ("2", second)):
        table.add(name, frame(spark, rows), terms(spark), lexicon(spark))
    want = nw.news_rollup(frame(spark, first + second), terms(spark), lexicon(spark))

    def rows_of(df):
        return sorted((r["ticker"], r["date"], round(r["sentiment_score"], 9), r["article_count"]) for r in df.collect())

    assert rows_of(table.daily()) == rows_of(want) and table.articles().count() == 4
    table.add("3", frame(spark, later), terms(spark), lexicon(spark))
    table.add("3", frame(spark, []), terms(spark), lexicon(spark))
    gone = table.daily().filter(F.col("date") == (NOON + dt.timedelta(days=1)).date()).first()
    assert (gone["sentiment_score"], gone["article_count"]) == (None, 0)
    with pytest.raises(ValueError):
        table.add("a/b", frame(spark, later), terms(spark), lexicon(spark))
