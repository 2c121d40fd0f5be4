"""Serving tables: ensemble, aligned history, market movers, company record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import by_ticker, ratio
from barloom.functions.ranking import global_position
from barloom.operators.news import newest_articles
from barloom.operators.technical import last_rows

MODELS = ("rf", "lr", "xgb", "lstm")
HISTORY_ROWS = 1825


def predicted_prices(scored: DataFrame, models=MODELS) -> DataFrame:
    return scored.withColumns({f"{m}_predicted_price": F.col("close") * (1 + F.col(f"{m}_return")) for m in models})


def ensemble_exprs(models=MODELS) -> dict[str, Column]:
    """Range, mean, population spread and agreement of the models of one row."""
    prices = [F.col(f"{m}_predicted_price") for m in models]
    mean = sum(prices[1:], prices[0]) / len(prices)
    squares = [(p - mean) * (p - mean) for p in prices]
    spread = F.sqrt(sum(squares[1:], squares[0]) / len(prices))
    variation = F.when(mean == 0, 0.0).otherwise(ratio(spread, mean))
    return {
        "ensemble_min": F.least(*prices),
        "ensemble_max": F.greatest(*prices),
        "ensemble_mean": mean,
        "ensemble_std": spread,
        "model_agreement_score": F.greatest(F.lit(0.0), F.least(F.lit(98.0), 100 - variation * 1000)),
    }


def ensemble(scored: DataFrame, models=MODELS) -> DataFrame:
    return predicted_prices(scored, models).withColumns(ensemble_exprs(models))


def agreement_tier(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 80, "high").when(s >= 60, "medium").otherwise("low")


def aligned_history(scored: DataFrame, rows: int | None = HISTORY_ROWS, models=MODELS) -> DataFrame:
    """The price each model had predicted for the row's date: yesterday's prediction, one row later."""
    w = by_ticker()
    aligned = {f"{m}_pred": F.lag(F.col("close") * (1 + F.col(f"{m}_return"))).over(w) for m in models}
    df = scored.withColumns(aligned).select("ticker", "date", "close", *aligned)
    return df if rows is None else last_rows(df, rows)


def latest_per_ticker(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """Newest row of each ticker as one partial aggregate, no sort."""
    return df.groupBy("ticker").agg(F.max_by(F.struct(order, *columns), order).alias("_row")).select("ticker", "_row.*")


def latest_facts(bars: DataFrame, dividends: DataFrame, meta: DataFrame) -> DataFrame:
    """Last volume, last dividend and sector of every ticker of the universe."""
    volume = latest_per_ticker(bars, "date", "close", "volume").withColumnRenamed("date", "latest_date")
    dividend = latest_per_ticker(dividends, "ex_dividend_date", "dividend_amount", "dividend_type")
    known = meta.select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    return known.join(volume, "ticker", "left").join(dividend, "ticker", "left")


def display_yield(amount: str = "dividend_amount", price: str = "close") -> Column:
    return ratio(F.col(amount), F.col(price)) * 100


def model_errors(history: DataFrame, latest: DataFrame, models=MODELS) -> DataFrame:
    """Per ticker and model: the miss of today's prediction and the prediction for tomorrow."""
    today = latest_per_ticker(history, "date", "close", *[f"{m}_pred" for m in models])
    df = today.join(latest.select("ticker", *[f"{m}_predicted_price" for m in models]), "ticker")
    arms = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.col(f"{m}_pred").alias("p"), F.col(f"{m}_predicted_price").alias("t"))
                for m in models
            ]
        )
    )
    df = df.select("ticker", F.col("close").alias("actual_today"), arms.alias("m"))
    miss = F.col("actual_today") - F.col("m.p")
    usable = F.col("m.p").isNotNull() & (F.col("m.p") != 0)
    return df.select(
        "ticker",
        F.col("m.model").alias("model"),
        "actual_today",
        F.col("m.p").alias("pred_today"),
        F.when(usable, miss).otherwise(0.0).alias("diff"),
        F.when(usable, ratio(miss, F.col("m.p")) * 100).otherwise(0.0).alias("diff_percent"),
        F.col("m.t").alias("pred_tomorrow"),
    )


def target_gap(latest: DataFrame, live: DataFrame, model: str = "rf") -> DataFrame:
    """Prediction minus shown price, which is the live quote or else the last close."""
    df = latest.join(live.select("ticker", F.col("price").alias("_live")), "ticker", "left")
    shown = F.coalesce("_live", "close")
    gap = F.col(f"{model}_predicted_price") - shown
    return df.select(
        "ticker", shown.alias("shown_price"), gap.alias("target_gap"), F.when(gap > 0, "up").otherwise("down").alias("direction")
    )


def chart_series(history: DataFrame, latest: DataFrame, models=MODELS) -> DataFrame:
    """History of every model as one ``predicted_close``, and one future row a calendar day later."""
    fields = [F.struct(F.lit(m).alias("model"), F.col(f"{m}_pred").alias("p")) for m in models]
    past = history.select("ticker", "date", "close", F.explode(F.array(*fields)).alias("m")).select(
        "ticker", "date", "close", "m.model", F.col("m.p").alias("predicted_close"), F.lit(False).alias("is_prediction")
    )
    nexts = [F.struct(F.lit(m).alias("model"), F.col(f"{m}_predicted_price").alias("p")) for m in models]
    future = latest.select("ticker", F.date_add("date", 1).alias("date"), F.explode(F.array(*nexts)).alias("m")).select(
        "ticker", "date", F.lit(None).cast("double").alias("close"), "m.model", F.col("m.p").alias("predicted_close"),
        F.lit(True).alias("is_prediction"),
    )
    return past.unionByName(future)


def is_market_closed(at: Column | str, zone: str = "Asia/Karachi") -> Column:
    """Closed on weekends and from 16:00 local time; the hours before the opening count as open."""
    local = F.from_utc_timestamp(F.col(at) if isinstance(at, str) else at, zone)
    return (F.weekday(local) >= 5) | (F.hour(local) >= 16)


def performers(bars: DataFrame) -> DataFrame:
    """Price, change, percent and volume of the newest bar of each ticker; no change for a single bar."""
    two = last_rows(bars.select("ticker", "date", "close", "volume"), 2).groupBy("ticker").agg(
        F.max_by(F.struct("close", "volume"), "date").alias("_now"),
        F.min_by("close", "date").alias("_then"),
    )
    move = F.col("_now.close") - F.col("_then")
    return two.select(
        "ticker",
        F.col("_now.close").alias("price"),
        move.alias("change"),
        (F.coalesce(ratio(move, F.col("_then")), F.lit(0.0)) * 100).alias("change_percent"),
        F.col("_now.volume").alias("volume"),
    )


def market_movers(quotes: DataFrame, k: int | None = None) -> DataFrame:
    """Three full rankings: most active, advancers, decliners; ties go to the lower ticker.

    One range layout numbers all three, so no task holds a whole ranking. With ``k`` only the first
    ``k`` of each are kept.
    """
    scores = F.array(
        F.struct(F.lit("top_active").alias("ranking"), (-F.col("volume")).cast("double").alias("score")),
        F.struct(F.lit("top_advancers").alias("ranking"), (-F.col("change_percent")).alias("score")),
        F.struct(F.lit("top_decliners").alias("ranking"), F.col("change_percent").alias("score")),
    )
    long = quotes.select("ticker", "price", "change", "change_percent", "volume", F.explode(scores).alias("s"))
    long = long.select("*", "s.ranking", "s.score").drop("s")
    if k is not None:
        w = Window.partitionBy("ranking").orderBy("score", "ticker")
        ranked = long.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    else:
        ranked = global_position(long, [F.col("score"), F.col("ticker")], "rank", within="ranking")
    return ranked.drop("score")


def company_records(
    scored: DataFrame, sentiment: DataFrame, articles: DataFrame, dividends: DataFrame, news_per_ticker: int = 5, models=MODELS
) -> DataFrame:
    """One nested record per ticker: latest predictions, ensemble, sentiment, news and dividend.

    Every source is first reduced to a bounded number of rows per ticker; the joins are on ticker.
    """
    last = latest_per_ticker(scored, "date", "close", *[f"{m}_return" for m in models])
    last = ensemble(last, models)
    news = newest_articles(articles, news_per_ticker).groupBy("ticker").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "rank", "headline", "source", "published_at", "url",
                    F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment_score"),
                )
            )
        ).alias("recent_news")
    )
    dividend = latest_per_ticker(dividends, "ex_dividend_date", "dividend_amount", "dividend_type").select(
        "ticker",
        F.struct(
            F.col("dividend_amount").alias("amount"), F.col("ex_dividend_date").alias("ex_date"), F.col("dividend_type").alias("type")
        ).alias("latest_dividend"),
    )
    mood = latest_per_ticker(sentiment, "date", "sentiment_score").select("ticker", "sentiment_score")
    df = last.join(mood, "ticker", "left").join(news, "ticker", "left").join(dividend, "ticker", "left")
    prices = [F.round(f"{m}_predicted_price", 2).alias(f"{m}_predicted_price") for m in models]
    no_news = F.array().cast(news.schema["recent_news"].dataType)
    return df.select(
        "ticker",
        F.col("date").alias("latest_date"),
        F.round("close", 2).alias("current_price"),
        *prices,
        F.round("ensemble_min", 2).alias("ensemble_min"),
        F.round("ensemble_max", 2).alias("ensemble_max"),
        F.round("model_agreement_score", 1).alias("model_agreement_score"),
        F.round(F.coalesce("sentiment_score", F.lit(0.0)), 2).alias("latest_sentiment"),
        F.coalesce("recent_news", no_news).alias("recent_news"),
        "latest_dividend",
    )
