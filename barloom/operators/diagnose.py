"""Feature diagnostics: statistics, correlations, collinearity, histograms.

Pair statistics of p columns come from one pass: every task multiplies its own Arrow batches into
p x p sums, and only these are shuffled. The result is p squared rows, whatever the input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import ratio
from barloom.functions.ranking import bracketed_quantiles
from barloom.session import settle


def finite(name: str) -> Column:
    """The value as a double, null when it does not parse or is not finite."""
    x = F.col(name).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sanitized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns with non-finite values as null; rows with such a value are dropped."""
    return df.withColumns({c: finite(c) for c in columns}).dropna("any", subset=columns)


def describe(df: DataFrame, columns: list[str], stored: bool = False) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max of each column.

    All columns are read side by side, never as rows per column. The work takes several scans, so a derived ``df`` is
    written once first; ``stored=True`` says that it is a table whose scan is cheap.
    """
    slim = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    slim = slim if stored else settle(slim, "described")
    kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    sums = slim.agg(*[F.struct(F.lit(c).alias("column"), *[f(c).alias(k) for k, f in kinds.items()]).alias(f"_{i}") for i, c in enumerate(columns)])
    basics = sums.select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("_s")).select("_s.*")
    # One row per column of the table.
    return basics.join(F.broadcast(bracketed_quantiles(slim, columns, [0.25, 0.5, 0.75])), "column", "left")


# ------------------------------------------------------------ pair statistics

_PAIR_SCHEMA = "i int, j int, n double, si double, sj double, sii double, sjj double, sij double"


def _pair_sums(columns: list[str], centers: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(columns)
        total = np.zeros((6, p, p))
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float) - centers
            known = ~np.isnan(x)
            x0, m = np.where(known, x, 0.0), known.astype(float)
            n, s, s2, cross = m.T @ m, x0.T @ m, (x0 * x0).T @ m, x0.T @ x0
            total += np.stack([n, s, s.T, s2, s2.T, cross])
        i, j = np.meshgrid(range(p), range(p), indexing="ij")
        named = zip(("n", "si", "sj", "sii", "sjj", "sij"), total)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{k: v.ravel() for k, v in named}})

    return run


def pair_sums(df: DataFrame, columns: list[str], center: bool = True) -> DataFrame:
    """Sums of each column pair over the rows where both are known; p squared rows.

    Values are shifted by their means first, so that the sums keep their precision.
    """
    slim = df.select(*[finite(c).alias(c) for c in columns])
    centers = np.zeros(len(columns))
    if center:
        means = slim.agg(*[F.avg(c).alias(c) for c in columns]).first()
        centers = np.array([means[c] or 0.0 for c in columns])
    parts = slim.mapInPandas(_pair_sums(columns, centers), _PAIR_SCHEMA)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, over the rows where both are known."""
    names = F.array(*[F.lit(c) for c in columns])
    n = F.col("n")
    cov = F.col("sij") - F.col("si") * F.col("sj") / n
    spread = F.sqrt((F.col("sii") - F.col("si") * F.col("si") / n) * (F.col("sjj") - F.col("sj") * F.col("sj") / n))
    sums = pair_sums(df, columns).filter("n > 1")
    return sums.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), ratio(cov, spread).alias("corr"))


def correlated_pairs(corr: DataFrame, limit: float = 0.85) -> DataFrame:
    """Pairs above the limit without self and mirrored pairs, strongest first."""
    return corr.filter((F.col("a") < F.col("b")) & (F.abs("corr") > limit)).orderBy(F.abs("corr").desc(), "a", "b")


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """p x p matrix of column products over complete rows."""
    rows = pair_sums(df, columns, center=False).select("i", "j", "sij").collect()
    g = np.zeros((len(columns), len(columns)))
    for r in rows:
        g[r["i"], r["j"]] = r["sij"]
    return g


def gram_and_ranges(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The products of :func:`gram` with least and greatest value of each column, all of one pass over complete rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(columns)
        total, low, high = np.zeros((p, p)), np.full(p, np.inf), np.full(p, -np.inf)
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            if len(x):
                total, low, high = total + x.T @ x, np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        i, j = np.meshgrid(range(p), range(p), indexing="ij")
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "sij": total.ravel(), "low": low[i.ravel()], "high": high[i.ravel()]})

    parts = df.select(*columns).mapInPandas(run, "i int, j int, sij double, low double, high double")
    # p squared rows.
    rows = parts.groupBy("i", "j").agg(F.sum("sij").alias("sij"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    g, low, high = np.zeros((len(columns), len(columns))), np.zeros(len(columns)), np.zeros(len(columns))
    for r in rows:
        g[r["i"], r["j"]], low[r["i"]], high[r["i"]] = r["sij"], r["low"], r["high"]
    # Without any row there is no range.
    return g, np.where(np.isinf(low), 0.0, low), np.where(np.isinf(high), 0.0, high)


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each feature over all complete rows, no intercept added.

    The factor is the diagonal of the Gram matrix times that of its inverse, so every row counts and
    no sample is needed. Constant columns are left out. The inversion is p x p on the driver.
    """
    spark = df.sparkSession
    clean = sanitized(df.select(*columns), columns)
    g, low, high = gram_and_ranges(clean, columns)
    kept = [i for i in range(len(columns)) if low[i] != high[i]]
    moving, g = [columns[i] for i in kept], g[np.ix_(kept, kept)]
    scale = np.sqrt(np.diag(g))
    unit = g / np.outer(scale, scale)
    if np.linalg.matrix_rank(unit) < len(moving):
        raise np.linalg.LinAlgError("the columns are perfectly collinear")
    factors = np.diag(unit) * np.diag(np.linalg.inv(unit))
    return spark.createDataFrame([(c, float(v)) for c, v in zip(moving, factors)], "feature string, vif double")


def top_inflation(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    return variance_inflation(df, columns).orderBy(F.col("vif").desc(), "feature").limit(k)


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal bins between the extremes; the right edge belongs to the last bin. Empty bins are kept out."""
    values = df.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    edges = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("e")).scalar()
    cell = F.least(F.floor(ratio(F.col("x") - F.col("e.lo"), F.col("e.hi") - F.col("e.lo")) * bins), F.lit(bins - 1))
    binned = values.withColumn("e", edges).withColumn("bin", F.coalesce(cell, F.lit(0)).cast("int"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))
