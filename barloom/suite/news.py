"""News: match, deduplication, sentiment, roll-up, and the text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators import news as nw
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.sql_views import with_views

# Frequent words of the documents stand for company names (fixed values).
COMPANIES = [
    ("ALFA", "that is", ["which", "with the"], ["from the"]),
    ("BETA", "dans une", ["pour les", "avec"], ["une"]),
    ("GAMA", "und das", ["nicht", "mit der"], ["von der"]),
    ("DELT", "para los", ["como", "una & la"], ["por"]),
    ("EPSI", "Limited by", ["re-the"], ["of the. the"]),
    ("ZETA", "no such company name", [], ["zzqx"]),
]
LEXICON = [("and", 1.5), ("the", -0.7), ("of", 0.4), ("de", 1.1), ("le", -1.9), ("der", 0.9), ("und", -1.2), ("la", 2.3), ("is", -0.3)]


def terms(v: Views) -> DataFrame:
    schema = "ticker string, name string, aliases array<string>, search_keywords array<string>"
    return nw.company_terms(v.spark.createDataFrame(COMPANIES, schema))


def lexicon(v: Views) -> DataFrame:
    return v.spark.createDataFrame(LEXICON, "word string, valence double")


_TERM_ROWS = ", ".join(f"('{t}', '{x.lower()}')" for t, name, a, k in COMPANIES for x in dict.fromkeys([name, t, *a, *k]))
# Every word of text and term is put between marks, so a plain substring search respects word boundaries.
_MARK = "regexp_replace({0}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"
_MATCH = f"""
, terms AS (SELECT ticker, term, {_MARK.format('term')} AS marked FROM (VALUES {_TERM_ROWS}) t(ticker, term)),
txt AS MATERIALIZED (SELECT article_id, {_MARK.format("lower(concat_ws(' ', headline, summary, content))")} AS body FROM articles),
hits AS MATERIALIZED (SELECT DISTINCT article_id, t.ticker FROM txt JOIN terms t ON contains(body, marked))"""
_URL = """(SELECT CASE WHEN q = '' THEN base ELSE base || '?' || q END || CASE WHEN f = '' THEN '' ELSE '#' || f END FROM (
   SELECT regexp_extract(u, '^([^?#]*)', 1) AS base, regexp_extract(u, '^[^#]*#(.*)$', 1) AS f,
          array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'),
            lambda x: regexp_matches(x, '^[^=]*=.') AND NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid)=')), '&') AS q))"""
_KEYS = f"""
, keyed AS MATERIALIZED (SELECT *, {_URL.replace('(u,', '(url,')} AS norm_url,
           md5(regexp_replace(lower(headline), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS headline_hash FROM articles)"""


def _greedy(source: str, key: str = "article_id") -> str:
    """The ordered pass as it is defined: one article after the other against the sets of the kept ones."""
    return f"""
, seq AS MATERIALIZED (SELECT {key}, norm_url, headline_hash, row_number() OVER (ORDER BY {key}) AS i FROM {source}),
pass(i, urls, hashes) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT s.i, CASE WHEN dup THEN urls ELSE list_append(urls, norm_url) END, CASE WHEN dup THEN hashes ELSE list_append(hashes, headline_hash) END
  FROM (SELECT s.i, s.norm_url, s.headline_hash, p.urls, p.hashes,
               list_contains(p.urls, s.norm_url) OR list_contains(p.hashes, s.headline_hash) AS dup FROM pass p JOIN seq s ON s.i = p.i + 1) s),
fin AS (SELECT urls, hashes FROM pass ORDER BY i DESC LIMIT 1),
kept AS (SELECT min({key}) AS {key} FROM (
           SELECT s.{key}, s.i, s.norm_url FROM seq s JOIN pass p ON p.i = s.i JOIN pass q ON q.i = s.i - 1 WHERE len(p.urls) > len(q.urls))
         GROUP BY i)"""


@case("c04_normalized_url", with_views(_KEYS + "SELECT article_id, norm_url FROM keyed", "articles"))
def c04(v: Views):
    return v.articles.select("article_id", tx.normalized_url("url").alias("norm_url"))


@case("c05_headline_hash", with_views(_KEYS + "SELECT article_id, headline_hash FROM keyed", "articles"))
def c05(v: Views):
    return v.articles.select("article_id", tx.headline_hash("headline").alias("headline_hash"))


@case(
    "c06_term_match",
    with_views(
        _MATCH
        + "SELECT term, count(*) AS n FROM txt JOIN terms ON contains(body, marked) GROUP BY term",
        "articles",
    ),
)
def c06(v: Views):
    """How many articles name each term: words of the text meet the rarest words of terms, then the pattern decides."""
    text = tx.searched_text("headline", "summary", "content")
    bodies = v.articles.select(F.col("article_id").alias("_body"), text.alias("_text"))
    return nw.term_hits(bodies, terms(v).select("term").distinct()).groupBy("term").agg(F.count("*").alias("n"))


@case("n01_company_match", with_views(_MATCH + "SELECT article_id, ticker FROM hits", "articles"))
def n01(v: Views):
    return nw.match_companies(v.articles, terms(v)).select("article_id", "ticker")


@case("j14_company_match_joined", with_views(_MATCH + "SELECT article_id, ticker FROM hits", "articles"))
def j14(v: Views):
    """The match as a join: the same rows for a dictionary of any size."""
    return nw.match_companies(v.articles, terms(v)).select("article_id", "ticker")


@case(
    "n02_dedup_first_wins",
    with_views(
        _KEYS + _greedy("keyed") + "SELECT k.article_id, k.norm_url AS url FROM keyed k JOIN kept USING (article_id)", "articles", recursive=True
    ),
)
def n02(v: Views):
    return nw.dedup_first_wins(v.articles).select("article_id", "url")


@case(
    "n02_dedup_two_days",
    with_views(
        _KEYS
        + _greedy("(SELECT *, (CASE WHEN article_id % 2 = 0 THEN 0 ELSE 1000000000 END) + article_id AS nth FROM keyed)", "nth")
        + "SELECT k.article_id, k.norm_url AS url FROM keyed k JOIN kept ON kept.nth % 1000000000 = k.article_id",
        "articles",
        recursive=True,
    ),
)
def n02_two_days(v: Views):
    """Even ids arrive first and are stored, odd ids a day later: the same as one pass over both days."""
    one, two = v.articles.filter("article_id % 2 = 0"), v.articles.filter("article_id % 2 = 1")
    first = nw.dedup_first_wins(one)
    return first.unionByName(nw.dedup_first_wins(two, stored=first)).select("article_id", "url")


@case(
    "n02_dedup_cheap",
    with_views(
        _KEYS
        + """, one AS (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY article_id) AS a FROM keyed),
             two AS (SELECT *, row_number() OVER (PARTITION BY headline_hash ORDER BY article_id) AS b FROM one WHERE a = 1)
             SELECT article_id, norm_url AS url FROM two WHERE b = 1""",
        "articles",
    ),
)
def n02_cheap(v: Views):
    return nw.dedup_cheap(v.articles).select("article_id", "url")


_SCORE = f"""
, lex AS (SELECT * FROM (VALUES {', '.join(f"('{w}', CAST({x} AS DOUBLE))" for w, x in LEXICON)}) t(word, valence)),
tok AS (SELECT article_id, unnest(regexp_extract_all(lower(concat_ws(' ', headline, summary)), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM articles),
tot AS (SELECT article_id, sum(valence) AS s FROM tok JOIN lex USING (word) GROUP BY 1),
scores AS (SELECT article_id, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS sentiment_score FROM articles LEFT JOIN tot USING (article_id))"""


@case("n03_sentiment", with_views(_SCORE + "SELECT article_id, round(sentiment_score, 8) AS sentiment_score FROM scores", "articles"))
def n03(v: Views):
    return nw.score_sentiment(v.articles, lexicon(v)).select("article_id", F.round("sentiment_score", 8).alias("sentiment_score"))


@case(
    "n03_sentiment_joined", with_views(_SCORE + "SELECT article_id, round(sentiment_score, 8) AS sentiment_score FROM scores", "articles")
)
def n03_joined(v: Views):
    df = nw.score_sentiment(v.articles, lexicon(v).union(lexicon(v)))
    return df.select("article_id", F.round("sentiment_score", 8).alias("sentiment_score"))


_DAY = "CAST(published_at AS DATE) + CASE WHEN hour(published_at) >= 11 THEN 1 ELSE 0 END"


@case("c03_trading_date", with_views(f"SELECT event_id, {_DAY} AS trading_date FROM sentiment_raw", "sentiment_raw"))
def c03(v: Views):
    return v.sentiment_raw.select("event_id", tx.trading_date("published_at").alias("trading_date"))


@case(
    "x03_column_function",
    with_views(f"SELECT {_DAY} AS trading_date, count(*) AS n FROM sentiment_raw GROUP BY 1", "sentiment_raw"),
)
def x03(v: Views):
    """A function of one column, as a native expression inside an aggregation key."""
    return v.sentiment_raw.groupBy(tx.trading_date("published_at").alias("trading_date")).agg(F.count("*").alias("n"))


_AGG = f"SELECT ticker, {_DAY} AS date, round(avg(sentiment_score), 8) AS sentiment_score, CAST(count(headline) AS INTEGER) AS article_count"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("ticker", "date", F.round("sentiment_score", 8).alias("sentiment_score"), "article_count")


@case("a04_daily_sentiment", with_views(_AGG + " FROM sentiment_raw GROUP BY 1, 2", "sentiment_raw"))
def a04(v: Views):
    return _shown(nw.daily_sentiment(v.sentiment_raw))


def _rollup(dedup: str, tickers: str = "hits") -> str:
    return (
        _MATCH
        + _KEYS
        + ", named AS MATERIALIZED (SELECT * FROM keyed WHERE article_id IN (SELECT article_id FROM hits))"
        + dedup
        + _SCORE
        + f" {_AGG} FROM keyed JOIN kept USING (article_id) JOIN {tickers} USING (article_id) JOIN scores USING (article_id) GROUP BY 1, 2"
    )


@case("n04_news_rollup", with_views(_rollup(_greedy("named")), "articles", recursive=True))
def n04(v: Views):
    return _shown(nw.news_rollup(v.articles, terms(v), lexicon(v)))


@case(
    "n04_news_rollup_split_first",
    with_views(
        _rollup(_greedy("named"), "(SELECT article_id, min(ticker) AS ticker FROM hits GROUP BY 1)"), "articles", recursive=True
    ),
)
def n04_split(v: Views):
    return _shown(nw.news_rollup(v.articles, terms(v), lexicon(v), split_first=True))


_TWO_BATCHES = "(SELECT *, (CASE WHEN article_id % 2 = 0 THEN 0 ELSE 1000000000 END) + article_id AS nth FROM named)"


@case(
    "n04_news_rollup_two_batches",
    with_views(
        _MATCH
        + _KEYS
        + ", named AS MATERIALIZED (SELECT * FROM keyed WHERE article_id IN (SELECT article_id FROM hits))"
        + _greedy(_TWO_BATCHES, "nth")
        + _SCORE
        + f" {_AGG} FROM keyed JOIN kept ON kept.nth % 1000000000 = article_id JOIN hits USING (article_id) JOIN scores USING (article_id) GROUP BY 1, 2",
        "articles",
        recursive=True,
    ),
)
def n04_batches(v: Views):
    """Even ids arrive first, odd ids later and then once more: stored articles, and daily rows updated in place."""
    from barloom.plans.rollup import Rollup
    from barloom.session import fresh_path

    table = Rollup(v.spark, fresh_path(v.spark, "rollup"))
    for batch, rest in (("one", 0), ("two", 1), ("two", 1)):
        table.add(batch, v.articles.filter(F.col("article_id") % 2 == rest), terms(v), lexicon(v))
    return _shown(table.daily())


@case(
    "t02_newest_articles",
    with_views(
        """SELECT ticker, event_id AS article_id, rank FROM (SELECT ticker, event_id,
             row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, event_id) AS rank FROM sentiment_raw) WHERE rank <= 5""",
        "sentiment_raw",
    ),
)
def t02(v: Views):
    rows = v.sentiment_raw.withColumnRenamed("event_id", "article_id").withColumns({"source": F.lit("x"), "url": F.lit("y")})
    return nw.newest_articles(rows).select("ticker", "article_id", F.col("rank").cast("long").alias("rank"))


@case(
    "c09_sentiment_label",
    with_views(
        """SELECT event_id, CASE WHEN sentiment_score > 0.05 THEN 'Bullish' WHEN sentiment_score < -0.05 THEN 'Bearish' ELSE 'Neutral' END AS label
           FROM sentiment_raw""",
        "sentiment_raw",
    ),
)
def c09(v: Views):
    return v.sentiment_raw.select("event_id", tx.sentiment_label("sentiment_score").alias("label"))


# Every fourth record carries no readable date and falls back to the given moment.
_RECORDS = """
SELECT title AS headline, coalesce(description, '') AS summary, url, coalesce(publisher, 'Google News') AS source,
       coalesce(TRY_CAST(published_date AS TIMESTAMP), TIMESTAMP '2024-06-01 12:00:00') AS published_at
FROM (SELECT headline AS title, CASE WHEN article_id % 3 = 0 THEN NULL ELSE source END AS description, url,
             CASE WHEN article_id % 5 = 0 THEN NULL ELSE source END AS publisher,
             CASE WHEN article_id % 4 = 0 THEN 'yesterday' ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') END AS published_date FROM articles)
"""


@case("s19_article_records", with_views(_RECORDS, "articles"))
def s19(v: Views):
    i = F.col("article_id")
    raw = v.articles.select(
        F.col("headline").alias("title"),
        F.when(i % 3 != 0, F.col("source")).alias("description"),
        "url",
        F.when(i % 5 != 0, F.col("source")).alias("publisher"),
        F.when(i % 4 == 0, "yesterday").otherwise(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).alias("published_date"),
    )
    df = nw.article_records(raw, F.lit("2024-06-01 12:00:00").cast("timestamp"))
    return df.select("headline", "summary", "url", "source", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@case("s10_append_articles", with_views("SELECT article_id, url FROM articles UNION ALL SELECT article_id, url FROM articles", "articles"))
def s10(v: Views):
    """Two appends of the same articles: the raw table has no key and keeps both."""
    from barloom.session import fresh_path
    from barloom.sources.upsert import append_articles

    path = fresh_path(v.spark, "articles")
    rows = v.articles.select("article_id", "url")
    append_articles(rows, path)
    append_articles(rows, path)
    return v.spark.read.parquet(path)
