"""Run registry: three Parquet tables, results, summary and runs, plus the production pointer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.upsert import table_exists

NUMERIC = [
    "window_idx", "mae", "rmse", "mape", "directional_accuracy",
    "naive_mae", "naive_rmse", "naive_mape", "naive_directional_accuracy",
]


def run_summary(results: DataFrame) -> DataFrame:
    """Long summary: mean and sample deviation of every numeric column per run and per (run, ticker).

    One pass with grouping sets; ``ticker`` is null in the rows over all tickers. The worst window
    comes from window means, which are a few rows per run.
    """
    stats = [x for c in NUMERIC for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    names = [f"{c}_{s}" for c in NUMERIC for s in ("mean", "std")]
    wide = results.groupingSets([["run_id"], ["run_id", "ticker"]], "run_id", "ticker").agg(*stats)
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    long = wide.select("run_id", "ticker", F.explode(entries).alias("e")).select("run_id", "ticker", "e.metric", "e.value")
    return long.unionByName(worst_windows(results))


def worst_windows(results: DataFrame) -> DataFrame:
    windows = results.groupBy("run_id", "window_idx").agg(
        F.avg("mape").alias("mape"), F.avg("directional_accuracy").alias("directional_accuracy")
    )
    worst = windows.groupBy("run_id").agg(
        F.max("mape").alias("worst_window_mape"), F.min("directional_accuracy").alias("worst_window_directional_accuracy")
    )
    entries = [
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
        for n in ("worst_window_mape", "worst_window_directional_accuracy")
    ]
    long = worst.select("run_id", F.lit(None).cast("string").alias("ticker"), F.explode(F.array(*entries)).alias("e"))
    return long.select("run_id", "ticker", "e.metric", "e.value")


def overall(summary: DataFrame, *metrics: str) -> DataFrame:
    """One row per run with the given metrics over all tickers as columns."""
    return summary.filter(F.col("ticker").isNull() & F.col("metric").isin(*metrics)).groupBy("run_id").pivot("metric", list(metrics)).agg(
        F.max("value")
    )


def ticker_spread(summary: DataFrame) -> DataFrame:
    """Greatest minus least mean directional accuracy over the tickers of a run."""
    rows = summary.filter(F.col("ticker").isNotNull() & (F.col("metric") == "directional_accuracy_mean"))
    return rows.groupBy("run_id").agg((F.max("value") - F.min("value")).alias("ticker_spread"))


# ------------------------------------------------------------------ promotion


@dataclass(frozen=True)
class PromotionRules:
    accuracy_margin: float = 2.0
    max_mape: float = 15.0
    max_worst_window_mape: float = 30.0
    max_ticker_spread: float = 5.0


#: A run without one of these is refused.
REQUIRED = (
    "directional_accuracy_mean",
    "directional_accuracy_std",
    "mape_mean",
    "mape_std",
    "naive_directional_accuracy_mean",
    "naive_mape_mean",
    "worst_window_mape",
    "worst_window_directional_accuracy",
)


def promotion_gate(summary: DataFrame, rules: PromotionRules = PromotionRules()) -> DataFrame:
    """One row per run with a column per rule and the verdict; a run without a metric fails."""
    df = overall(summary, *REQUIRED).join(ticker_spread(summary), "run_id", "left")
    present = F.lit(True)
    for c in REQUIRED:
        present = present & F.col(c).isNotNull()

    def passes(rule: Column) -> Column:
        return F.coalesce(rule, F.lit(False))

    accuracy, naive = F.col("directional_accuracy_mean"), F.col("naive_directional_accuracy_mean")
    checks = {
        "has_metrics": present,
        "beats_naive": passes(accuracy - naive >= rules.accuracy_margin),
        "mape_ok": passes(F.col("mape_mean") <= rules.max_mape),
        "worst_mape_ok": passes(F.col("worst_window_mape") <= rules.max_worst_window_mape),
        "worst_accuracy_ok": passes(F.col("worst_window_directional_accuracy") >= naive),
        "spread_ok": F.coalesce(F.col("ticker_spread") <= rules.max_ticker_spread, F.lit(True)),
    }
    verdict = F.lit(True)
    for name in checks:
        verdict = verdict & F.col(name)
    df = df.withColumns(checks)
    return df.select("run_id", "directional_accuracy_mean", *checks, verdict.alias("promoted"))


def best_qualifying(gate: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """The promoted run with the greatest directional accuracy; no row when none qualifies."""
    runs = gate.filter("promoted")
    if candidates is not None:
        runs = runs.join(candidates.select("run_id"), "run_id", "left_semi")
    return runs.orderBy(F.col("directional_accuracy_mean").desc(), "run_id").limit(1)


def best_run(runs: DataFrame, summary: DataFrame, metric: str = "directional_accuracy_mean", model_type: str | None = None) -> DataFrame:
    """The run with the greatest value of a metric; runs without the metric do not take part."""
    if model_type is not None:
        runs = runs.filter(F.col("model_type") == model_type)
    value = summary.filter(F.col("ticker").isNull() & (F.col("metric") == metric) & F.col("value").isNotNull())
    scored = runs.join(value.select("run_id", "value"), "run_id")
    return scored.orderBy(F.col("value").desc(), "run_id").limit(1)


def oldest_and_newest(runs: DataFrame, summary: DataFrame, metric: str = "directional_accuracy_mean") -> DataFrame:
    """The first and the last trained run with a metric of each."""
    ends = runs.agg(
        F.min_by("run_id", F.struct("trained_at", "run_id")).alias("old"), F.max_by("run_id", F.struct("trained_at", "run_id")).alias("new")
    )
    named = ends.select(F.expr("stack(2, 'old', old, 'new', new) as (which, run_id)"))
    value = summary.filter(F.col("ticker").isNull() & (F.col("metric") == metric))
    return named.join(runs.select("run_id", "trained_at"), "run_id").join(value.select("run_id", "value"), "run_id", "left")


# -------------------------------------------------------------------- storage


class Registry:
    """The registry below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def register(
        self, run_id: str, model_type: str, feature_set_version: str, tickers: list[str], results: DataFrame, trained_at=None, model_path=None
    ) -> None:
        """Store results, summary and metadata of a run; the model itself is written by its library.

        Each run has folders of its own, so registering it again replaces it, and its summary reads
        nothing but its own results.
        """
        path = f"{self.folder}/results/{run_id}"
        results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(path)
        run_summary(self.spark.read.parquet(path)).write.mode("overwrite").parquet(f"{self.folder}/summary/{run_id}")
        stamp = F.current_timestamp() if trained_at is None else F.lit(trained_at).cast("timestamp")
        row = self.spark.createDataFrame(
            [(run_id, model_type, feature_set_version, tickers, "price", model_path)],
            "run_id string, model_type string, feature_set_version string, ticker_list array<string>, metric_space string, model_path string",
        )
        row.withColumn("trained_at", stamp).write.mode("overwrite").parquet(f"{self.folder}/runs/{run_id}")

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/runs/*")

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results/*")

    def summary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/summary/*")

    def promote(self, rules: PromotionRules = PromotionRules(), candidates: DataFrame | None = None) -> str | None:
        """Point production at the best qualifying run; without one the pointer stays as it is."""
        best = best_qualifying(promotion_gate(self.summary(), rules), candidates)
        row = best.join(self.runs().select("run_id", "model_type", "model_path"), "run_id").first()
        if row is None:
            return None
        pointer = self.spark.createDataFrame(
            [(row["run_id"], row["model_type"], row["model_path"])], "run_id string, model_type string, model_path string"
        )
        pointer.write.mode("overwrite").parquet(f"{self.folder}/pointer")
        return row["run_id"]

    def promote_each(self, rules: PromotionRules = PromotionRules(), candidates: DataFrame | None = None) -> dict[str, str]:
        """Point production of each model type at its best qualifying run; others stay as they are.

        One gate over all runs; the best of a type is one partial aggregate.
        """
        gate = promotion_gate(self.summary(), rules).filter("promoted")
        if candidates is not None:
            gate = gate.join(candidates.select("run_id"), "run_id", "left_semi")
        known = gate.join(self.runs().select("run_id", "model_type", "model_path"), "run_id").filter("model_path is not null")
        rank = F.struct("directional_accuracy_mean", "run_id")
        best = known.groupBy("model_type").agg(F.max_by(F.struct("run_id", "model_path"), rank).alias("run")).collect()
        for row in best:  # one row per model type
            pointer = self.spark.createDataFrame(
                [(row["run"]["run_id"], row["model_type"], row["run"]["model_path"])], "run_id string, model_type string, model_path string"
            )
            pointer.write.mode("overwrite").parquet(f"{self.folder}/production/{row['model_type']}")
        return {row["model_type"]: row["run"]["run_id"] for row in best}

    def production_models(self) -> dict:
        """The fitted model that each type's production pointer names, loaded from where its run put it."""
        from pyspark.ml import PipelineModel

        if not table_exists(self.spark, f"{self.folder}/production"):
            return {}
        pointers = self.spark.read.parquet(f"{self.folder}/production/*").orderBy("model_type").collect()
        return {p["model_type"]: PipelineModel.load(p["model_path"]) for p in pointers}

    def production(self) -> DataFrame | None:
        path = f"{self.folder}/pointer"
        return self.spark.read.parquet(path) if table_exists(self.spark, path) else None
