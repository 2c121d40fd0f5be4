"""News pipeline: company match, deduplication, sentiment, daily roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import text as tx
from barloom.session import settle


def article_records(
    raw: DataFrame, now: Column | None = None, default_source: str = "Google News", blank_urls: bool = False
) -> DataFrame:
    """Collector records to articles. A date without a zone is UTC, one that does not parse is now.

    A missing or blank URL is null, so that articles without one are no copies of each other;
    ``blank_urls`` makes it an empty text, which deduplication takes for one URL that they share.
    """
    stamp = F.try_to_timestamp(F.col("published_date"))
    return raw.select(
        F.lit(None).cast("string").alias("ticker"),
        F.coalesce("title", F.lit("")).alias("headline"),
        F.coalesce("description", F.lit("")).alias("summary"),
        F.lit(None).cast("string").alias("content"),
        (F.coalesce("url", F.lit("")) if blank_urls else F.when(F.trim("url") != "", F.col("url"))).alias("url"),
        F.coalesce("publisher", F.lit(default_source)).alias("source"),
        F.lit(None).cast("string").alias("author"),
        F.coalesce(stamp, F.current_timestamp() if now is None else now).alias("published_at"),
    )


# -------------------------------------------------------------- company match


def company_terms(companies: DataFrame) -> DataFrame:
    """One row per (ticker, term): name, ticker, aliases and search keywords."""
    every = F.concat(F.array("name", "ticker"), F.coalesce("aliases", F.array()), F.coalesce("search_keywords", F.array()))
    terms = companies.select("ticker", F.explode(every).alias("term")).filter(F.trim("term") != "")
    return terms.select("ticker", F.lower("term").alias("term")).distinct()


def _body_key(body: Column) -> Column:
    """What equal texts share. Articles need no key of their own for it, so null and repeated ids are harmless."""
    return F.md5(body.cast("binary"))


def _with_body(articles: DataFrame) -> DataFrame:
    """Articles with the key of their whole text, which stands for an article wherever only its text counts."""
    return articles.withColumn("_body", _body_key(tx.searched_text("headline", "summary", "content")))


def term_keys(terms: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(term, _word, _pattern)``: the word by which each term is looked up.

    A term can only match a text that holds all of its words, so any of them may be the key; the one that
    the fewest texts hold makes the fewest candidates, and a term that starts with a very common word makes
    no hot partition. Only the words of the terms are counted. Terms without a word match nothing. The words of
    the terms are written first: by their true size the optimizer sees that it need not move those of the texts.
    """
    parts = terms.select("term").distinct().select("term", F.explode(F.array_distinct(tx.words(F.col("term")))).alias("_word"))
    parts = settle(parts, "news-words")
    wanted = parts.select("_word").distinct()
    held = bodies.select(F.explode(F.array_distinct(tx.words(F.col("_text")))).alias("_word"))
    counts = held.join(wanted, "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_texts"))
    rank = F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "_word")
    rarest = parts.join(counts, "_word", "left").groupBy("term").agg(F.min_by("_word", rank).alias("_word"))
    return rarest.select("term", "_word", tx.whole_term(F.col("term")).alias("_pattern"))


def term_hits(bodies: DataFrame, terms: DataFrame, copies: bool = False) -> DataFrame:
    """``(_body, term)`` of every term that a text of ``bodies (_body, _text)`` holds.

    Distinct words of the texts meet the terms' rarest words without the texts; a text is joined back once
    for the list of candidates found, and the pattern decides. The optimizer broadcasts a small dictionary. ``copies``
    says that rows of one ``_body`` are copies of one text, which then has its candidates once.
    """
    keys = settle(term_keys(terms, bodies), "news-keys")
    words = bodies.select("_body", F.explode(F.array_distinct(tx.words(F.col("_text")))).alias("_word"))
    listed = (F.collect_set if copies else F.collect_list)(F.struct("term", "_pattern")).alias("_terms")
    candidates = words.join(keys, "_word").groupBy("_body").agg(listed)
    # The lists are built into hash tables and the texts only stream past them, so texts are never sorted.
    found = bodies.join(candidates.hint("shuffle_hash"), "_body")
    hits = F.filter("_terms", lambda x: F.regexp_like("_text", x["_pattern"]))
    return found.select("_body", F.explode(F.transform(hits, lambda x: x["term"])).alias("term"))


def company_pairs(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """``(_body, ticker)`` of every company that a distinct text names; articles need no key of their own."""
    text = tx.searched_text("headline", "summary", "content")
    bodies = articles.select(_body_key(text).alias("_body"), text.alias("_text"))
    return term_hits(bodies, terms, copies=True).distinct().join(terms, "term").select("_body", "ticker").distinct()


def match_companies(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """One copy of an article per company that its whole text names; every other column is kept."""
    return _with_body(articles.drop("ticker")).join(company_pairs(articles, terms), "_body").drop("_body")


# -------------------------------------------------------------- deduplication


def _keyed(articles: DataFrame, order: str) -> DataFrame:
    return articles.select(
        F.col(order).alias("_order"), tx.normalized_url("url").alias("_url"), tx.headline_hash("headline").alias("_hash")
    )


def _rank() -> Column:
    """Order of articles: null orders last, equal ones by hash and URL."""
    return F.struct(F.col("_order").isNull().alias("none"), F.col("_order").alias("order"), "_hash", "_url")


def _kept_articles(articles: DataFrame, kept: DataFrame, order: str) -> DataFrame:
    """The articles whose order, URL and headline are those of a kept key, in their own columns."""
    named = articles.withColumns({"_url": tx.normalized_url("url"), "_hash": tx.headline_hash("headline")})
    same = [named[a].eqNullSafe(kept[b]) for a, b in ((order, "_order"), ("_url", "_url"), ("_hash", "_hash"))]
    found = named.join(kept.distinct(), same, "left_semi")
    # Rows alike in order, URL and headline are copies of each other, unless they have neither.
    none = F.col("_url").isNull() & F.col("_hash").isNull()
    one = found.filter(~none).dropDuplicates([order, "_url", "_hash"]).unionByName(found.filter(none))
    return one.drop("_hash", "url").withColumnRenamed("_url", "url").select(*articles.columns)


def dedup_cheap(articles: DataFrame, order: str = "article_id") -> DataFrame:
    """First article of each URL, then first of each headline among those; a null matches nothing.

    Differs from :func:`dedup_first_wins` on chains: an article that falls to its headline has still
    taken its URL. Only keys are aggregated; the texts are joined back once.
    """
    keys = _keyed(articles, order)
    for key in ("_url", "_hash"):
        firsts = keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("*"), _rank()).alias("_row")).select("_row.*")
        keys = firsts.unionByName(keys.filter(F.col(key).isNull()))
    return _kept_articles(articles, keys, order)


def _chained(open_: DataFrame, url_first: DataFrame, hash_first: DataFrame) -> tuple[DataFrame, int]:
    """``rank`` of the rows that are kept at the end of chains of waiting rows, and the number of steps.

    A row that is the first on one key and the second on the other waits for one row alone: it is kept
    if and only if that row is not. Such rows form chains, which pointer doubling follows to their heads in
    the logarithm of their length; where a head is the first on both its keys, every second row behind it
    is kept. Chains behind other heads stay open.
    """
    marked = open_.join(url_first.withColumnRenamed("rank", "url_rank"), "u").join(hash_first.withColumnRenamed("rank", "hash_rank"), "h")
    marked = settle(marked.select("u", "h", "rank", "url_rank", "hash_rank"), "dedup-marked")
    seconds = {
        k: marked.filter(f"rank > {first}").groupBy(k).agg(F.min("rank").alias("rank"))
        for k, first in (("u", "url_rank"), ("h", "hash_rank"))
    }
    behind_hash = marked.filter("rank = url_rank").join(seconds["h"], ["h", "rank"], "left_semi").select("rank", F.col("hash_rank").alias("head"))
    behind_url = marked.filter("rank = hash_rank").join(seconds["u"], ["u", "rank"], "left_semi").select("rank", F.col("url_rank").alias("head"))
    links = settle(behind_hash.unionByName(behind_url).withColumn("odd", F.lit(True)), "dedup-chains")
    steps = 0
    while True:
        ahead = links.select(F.col("rank").alias("head"), F.col("head").alias("next"), F.col("odd").alias("more"))
        moved = links.join(ahead, "head", "left").select(
            "rank", F.coalesce("next", "head").alias("head"), F.coalesce(F.col("odd") != F.col("more"), "odd").alias("odd"), F.col("next").isNotNull().alias("far")
        )
        links = settle(moved, "dedup-chains")
        steps += 1
        if links.filter("far").isEmpty():
            break
        links = links.drop("far")
    heads = marked.filter("rank = url_rank and rank = hash_rank").select(F.col("rank").alias("head"))
    return links.filter("not odd").join(heads, "head", "left_semi").select("rank"), steps


def first_wins_keys(keys: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """The rows ``(_order, _url, _hash)`` that an ordered pass would keep, found in parallel rounds.

    A row is kept if no kept row before it shares its URL or its hash; a null shares nothing. That is a
    greedy matching between URLs and hashes in order. In each round every row that is the first of the
    open ones on both its URL and its hash is kept, and all rows on a taken URL or hash are closed. A round
    that closes less than half of the rows is followed by ones that also contract chains of waiting rows
    (see :func:`_chained`), so a chain costs the logarithm of its length. Rows that wait for several others
    at once can still make rounds as many as the longest such wait. Rows with equal URL and hash fall into
    one before the first round, and the firsts are partial aggregates. Every round is written to the shared
    folder; ``trace`` receives the steps of each round. Null orders come last, equal ones are ordered by hash
    and URL.
    """
    columns = ["_order", "_url", "_hash"]
    # A null URL stands in by the hash, which alone can close the row, and a null hash by the URL.
    url = F.coalesce(F.concat(F.lit("+"), "_url"), F.concat(F.lit("-"), "_hash"))
    hash_ = F.coalesce(F.concat(F.lit("+"), "_hash"), F.concat(F.lit("-"), "_url"))
    free = keys.filter("_url is null and _hash is null")
    rank = F.struct(F.col("_order").isNull().alias("none"), F.col("_order").alias("order"), "h", "u")
    bound = keys.filter("_url is not null or _hash is not null").select(*columns, url.alias("u"), hash_.alias("h"))
    row = F.min_by(F.struct(*columns), "rank").alias("row")
    open_ = settle(bound.withColumn("rank", rank).groupBy("u", "h").agg(F.min("rank").alias("rank"), row), "dedup-open")
    kept = free
    left, contract = open_.count(), False
    while left:
        url_first = open_.groupBy("u").agg(F.min("rank").alias("rank"))
        hash_first = open_.groupBy("h").agg(F.min("rank").alias("rank"))
        found = open_.join(url_first, ["u", "rank"], "left_semi").join(hash_first, ["h", "rank"], "left_semi")
        steps = 1
        if contract:
            late, more = _chained(open_, url_first, hash_first)
            found = found.unionByName(open_.join(late, "rank", "left_semi").select(*found.columns))
            steps += more
        taken = settle(found.select("u", "h", "row"), "dedup-kept")
        kept = kept.unionByName(taken.select("row.*"))
        rest = open_.join(taken.select("u"), "u", "left_anti").join(taken.select("h"), "h", "left_anti")
        open_, before = settle(rest, "dedup-open"), left
        left = open_.count()
        if trace is not None:
            trace.append(steps)
        if left >= before:
            raise RuntimeError("a round of deduplication closed nothing")
        contract = 2 * left > before
    return kept


def dedup_first_wins(articles: DataFrame, order: str = "article_id", stored: DataFrame | None = None) -> DataFrame:
    """Exact ordered deduplication by normalised URL or headline hash; a null matches nothing.

    ``stored`` holds articles accepted before (``url, headline``). They come before all others, so an
    article that shares a URL or a headline with one of them is not admitted.
    """
    keys = _keyed(articles, order)
    if stored is not None:
        known = stored.select(tx.normalized_url("url").alias("_url"), tx.headline_hash("headline").alias("_hash"))
        keys = keys.join(known.select("_url").distinct(), "_url", "left_anti").select("_order", "_url", "_hash")
        keys = keys.join(known.select("_hash").distinct(), "_hash", "left_anti").select("_order", "_url", "_hash")
    return _kept_articles(articles, first_wins_keys(keys), order)


# ------------------------------------------------------------------ sentiment


def score_sentiment(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Compound score of headline and summary from the valences of their words.

    The words of the texts are joined to the lexicon where the texts lie, counted per text before the exchange, and
    only the sums are joined back. A word that the lexicon repeats counts with its mean valence.
    """
    text = tx.searched_text("headline", "summary")
    keyed = articles.withColumn("_body", _body_key(text))
    valences = lexicon.filter("word <> ''").groupBy("word").agg(F.avg("valence").alias("valence"))
    # The empty word, which no text holds, stands once in front of each copy of a text and so counts the copies.
    mark = F.lit("")
    known = valences.unionByName(lexicon.sparkSession.range(1).select(mark.alias("word"), F.lit(0.0).alias("valence")))
    words = keyed.select("_body", F.explode(F.concat(F.array(mark), tx.words(text))).alias("word"))
    # Written first: by its true size the optimizer sees that a lexicon need not move the words of the texts.
    counts = words.join(settle(known, "lexicon"), "word").groupBy("_body", "word", "valence").agg(F.count("*").alias("_n"))
    copies = F.max(F.when(F.col("word") == mark, F.col("_n")))
    sums = counts.groupBy("_body").agg((F.sum(F.col("valence") * F.col("_n")) / copies).alias("_total"))
    scored = keyed.join(sums, "_body", "left")
    return scored.withColumn("sentiment_score", tx.compound(F.coalesce("_total", F.lit(0.0)))).drop("_total", "_body")


# ------------------------------------------------------------------- roll-up


def daily_sentiment(articles: DataFrame) -> DataFrame:
    """Mean score and number of headlines per ticker and trading day."""
    return (
        articles.groupBy("ticker", tx.trading_date("published_at").alias("date"))
        .agg(F.avg("sentiment_score").alias("sentiment_score"), F.count("headline").cast(T.IntegerType()).alias("article_count"))
    )


def analyse_whole(
    articles: DataFrame, terms: DataFrame, lexicon: DataFrame, exact: bool = True, split_first: bool = False, stored: DataFrame | None = None
) -> DataFrame:
    """Match, deduplicate and score: one row per accepted article, with ``tickers``. Others are dropped.

    By default copies are removed before an article is split by company, so an article that names
    two companies counts for both. ``split_first`` splits before, and then only the copy of the
    lowest ticker survives, because the copies share URL and headline. ``stored`` articles were accepted
    before; with ``exact``, what repeats one of them is not admitted again.
    """
    columns = [c for c in articles.columns if c not in ("ticker", "sentiment_score")]
    # Written once with a number for each row: all steps but the match move keys and numbers, never texts.
    numbered = _with_body(articles.select(*columns)).withColumn("_row", F.monotonically_increasing_id())
    rows = settle(numbered, "news-articles")
    # They go by the text, so articles may have no id or share one.
    pairs = company_pairs(rows, terms).groupBy("_body").agg(F.sort_array(F.collect_list("ticker")).alias("tickers"))
    pairs = settle(pairs, "news-pairs")
    if split_first:
        pairs = pairs.withColumn("tickers", F.slice("tickers", 1, 1))
    named = rows.select("article_id", "headline", "url", "_body", "_row").join(pairs.select("_body"), "_body", "left_semi")
    single = dedup_first_wins(named, stored=stored) if exact else dedup_cheap(named)
    scores = score_sentiment(rows.select("_row", "headline", "summary"), lexicon).select("_row", "sentiment_score")
    kept = single.select("_row", "_body", "url").join(pairs, "_body").join(scores, "_row").drop("_body")
    whole = rows.drop("_body", "url").join(kept.hint("shuffle_hash"), "_row")
    return whole.select(*columns, "sentiment_score", "tickers")


def per_company(whole: DataFrame) -> DataFrame:
    """One row per article and company that it names."""
    return whole.select(*[c for c in whole.columns if c != "tickers"], F.explode("tickers").alias("ticker"))


def analyse_articles(articles: DataFrame, terms: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """The accepted articles of :func:`analyse_whole`, one row per company that they name."""
    return per_company(analyse_whole(articles, terms, lexicon, **options))


def news_rollup(articles: DataFrame, terms: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    return daily_sentiment(analyse_articles(articles, terms, lexicon, **options))


def daily_state(articles: DataFrame) -> DataFrame:
    """What daily sentiment is made of, in parts that add up: sum and number of scores, number of headlines."""
    return articles.groupBy("ticker", tx.trading_date("published_at").alias("date")).agg(
        F.sum("sentiment_score").alias("score_sum"), F.count("sentiment_score").alias("scores"), F.count("headline").alias("headlines")
    )


def merged_state(states: DataFrame) -> DataFrame:
    """Daily sentiment from any number of partial states of each ticker and day."""
    sums = states.groupBy("ticker", "date").agg(*(F.sum(c).alias(c) for c in ("score_sum", "scores", "headlines")))
    mean = F.try_divide("score_sum", "scores").alias("sentiment_score")
    return sums.select("ticker", "date", mean, F.coalesce("headlines", F.lit(0)).cast("int").alias("article_count"))


def newest_articles(articles: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` articles of every ticker; Spark limits each group before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy(F.col("published_at").desc(), "article_id")
    slim = articles.select("ticker", "article_id", "headline", "source", "published_at", "url", "sentiment_score")
    return slim.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
