"""Mixing by iterative proportional fitting, in DataFrame functions only.

Token counts are summed into cells of (source, language, topic). Raking scales the cells to each
marginal in turn until all hold at once; a document is then drawn with its cell's calibrated rate. A rate
above one gives whole repeats and a drawn fraction, so that the drawn tokens meet the marginals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.session import settle

CELL = ("source", "lang", "topic")
#: Shares of tokens by topic in the mix; a topic that is not named shares what is left by its own tokens.
TOPIC_SHARES = {"prose": 0.75, "contact": 0.1, "licence": 0.05, "table": 0.05, "symbols": 0.03, "capitals": 0.02}
#: Source and language shares follow tokens to this power, so that large ones do not crowd out small ones.
TEMPER = 0.5
ROUNDS = 10
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic from marks anywhere in the whole text, first rule that fits."""
    has = lambda part: F.contains(text, F.lit(part))
    return (
        F.when(has(" | "), "table")
        .when(has("%%%") | has("$$$") | has("###") | has("&&&"), "symbols")
        .when(has("@"), "contact")
        .when(has("icens"), "licence")
        .when(~text.rlike("[a-z]") & text.rlike("[A-Z]"), "capitals")
        .otherwise("prose")
    )


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``topic`` and ``tokens`` (words of the whole text)."""
    text = text_of(text_col)
    return docs.withColumns({"topic": topic_of(text), "tokens": F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")})


def _shares(cells: DataFrame, margin: str, shares: dict[str, float] | float) -> DataFrame:
    """Target share of each category of one margin that has tokens; they sum to one."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    if isinstance(shares, dict):
        named = F.coalesce(*[F.when(F.col(margin) == k, F.lit(float(v))) for k, v in shares.items()])
        rest = max(0.0, 1.0 - sum(shares.values()))
        open_ = sums.agg(F.sum(F.when(named.isNull(), F.col("t")))).first()[0] or 1
        raw = sums.withColumn("s", F.coalesce(named, F.lit(rest) * F.col("t") / F.lit(open_)))
    else:
        raw = sums.withColumn("s", F.pow(F.col("t").cast("double"), F.lit(float(shares))))
    total = raw.agg(F.sum("s")).first()[0] or 1.0
    return raw.select(F.col(margin).alias("_m"), (F.col("s") / F.lit(total)).alias("_share"))


def rake(cells: DataFrame, margins: dict[str, dict[str, float] | float], rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``fitted``: their token share after ``rounds`` of scaling to each margin in turn.

    The cells stay a table; sums of a margin are pre-aggregated and joined back, and each scaling is settled
    so the plan stays short: over a whole round it would hold seven sums for three margins. Cells without tokens are left out.
    """
    cells = settle(cells.filter("tokens > 0").withColumn("fitted", F.col("tokens").cast("double")), "cells")
    for m, target in margins.items():
        share = _shares(cells, m, target).withColumnRenamed("_share", f"_share_{m}")
        cells = cells.join(share, cells[m].eqNullSafe(share["_m"])).drop("_m")
    cells = settle(cells, "cells")
    for _ in range(rounds):
        for m in margins:
            # One row per category of the margin; the optimizer broadcasts it if it is small.
            scale = cells.groupBy(F.col(m).alias("_m")).agg((F.max(f"_share_{m}") / F.sum("fitted")).alias("_by"))
            scaled = cells.join(scale, cells[m].eqNullSafe(scale["_m"]))
            cells = settle(scaled.withColumn("fitted", F.col("fitted") * F.col("_by")).drop("_m", "_by"), "cells")
    return cells.drop(*[f"_share_{m}" for m in margins])


def rates(cells: DataFrame, margins: dict, fraction: float, rounds: int = ROUNDS) -> DataFrame:
    """``(source, lang, topic, weight, probability)``: weight is the fitted over the given token share."""
    fitted = rake(cells, margins, rounds)
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    found = fitted.withColumn("weight", F.col("fitted") * F.lit(total) / F.col("tokens"))
    return found.select(*CELL, "weight", F.least(F.lit(1.0), F.col("weight") * fraction).alias("probability"))


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) fixed by the id, in steps of 2 to the -28."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 7), 16, 10).cast("double") / float(1 << 28)


def mixed(
    docs: DataFrame,
    margins: dict | None = None,
    fraction: float = 0.7,
    rounds: int = ROUNDS,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``topic, tokens, weight, probability, kept, copies``.

    ``copies`` says how often the mix holds the document: the whole part of its rate (weight times
    ``fraction``), and one more with the rest as probability. ``probability`` and ``kept`` are of one copy at
    least. Null sources and languages are categories of their own. A document in a cell without tokens has
    weight one and is kept once, as it adds nothing. Equal ids are drawn alike; an empty table gives no rows; columns named like the new ones are replaced.
    """
    named = described(docs.drop("weight", "probability", "kept", "copies"), text_col)
    return mixed_described(named, margins, fraction, rounds, seed, id_col)


def mixed_described(
    named: DataFrame,
    margins: dict | None = None,
    fraction: float = 0.7,
    rounds: int = ROUNDS,
    seed: int = 9,
    id_col: str = "doc_id",
) -> DataFrame:
    """:func:`mixed` for rows that already have ``topic`` and ``tokens``; the text is then not needed."""
    margins = margins or {"source": TEMPER, "lang": TEMPER, "topic": TOPIC_SHARES}
    cells = named.groupBy(*CELL).agg(F.sum("tokens").alias("tokens"))
    rate = rates(cells, margins, fraction, rounds)
    rate = rate.select(F.struct(*CELL).alias("cell"), "weight", "probability")
    # The row travels as one column, so that no name of it can clash.
    rows = named.select(F.struct("*").alias("row"), F.struct(*CELL).alias("own"), draw(id_col, seed).alias("draw"))
    joined = rows.join(rate, F.col("own").eqNullSafe(F.col("cell")), "left")
    probability = F.coalesce("probability", F.lit(1.0))
    rate_of = F.coalesce(F.col("weight") * fraction, F.lit(1.0))
    whole = F.floor(rate_of)
    return joined.select(
        "row.*",
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
        probability.alias("probability"),
        (F.col("draw") < probability).alias("kept"),
        (whole + (F.col("draw") < rate_of - whole).cast("long")).cast("long").alias("copies"),
    )


def repeated(drawn: DataFrame) -> DataFrame:
    """Rows of :func:`mixed` as often as ``copies`` says."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return drawn.filter("copies > 0").select("*", times).drop("_copy")
