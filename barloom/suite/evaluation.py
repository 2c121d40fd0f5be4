"""Splits, windows, sequences, metrics, registry and promotion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import evaluate as ev
from barloom.sources import registry as rg
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.sql_views import with_views

W = "PARTITION BY ticker ORDER BY date"
#: The views hold some 530 bars per ticker, so about half of the tickers pass this.
MIN_TRAIN = 480

# Predictions with the target, the trading dates, the cutoff and the walk-forward windows.
_TARGET = f"""
, scored AS (SELECT * FROM (SELECT *, (lead(close) OVER ({W}) - close) / close AS y FROM predictions) WHERE y IS NOT NULL)"""
_DATES = ", days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
_CUTOFF = (
    _DATES
    + f""", cut AS (SELECT coalesce(max(CASE WHEN n - 1 - i = CASE WHEN n < 250 + {MIN_TRAIN} THEN n // 5 ELSE 250 END THEN date END),
        DATE '2023-01-01') AS cutoff FROM days)"""
)


def _windows(mode: str = "rolling", train: int = 750, test: int = 60, step: int = 60) -> str:
    start = "(SELECT date FROM days x WHERE x.i = d.i - {0})".format(train) if mode == "rolling" else "(SELECT min(date) FROM days)"
    return (
        _DATES
        + f""", win0 AS (SELECT CAST((d.i - {train}) // {step} AS INTEGER) AS window_idx, {start} AS train_start, d.date - 1 AS train_end,
              d.date AS test_start, (SELECT max(date) FROM days x WHERE x.i <= d.i + {test - 1}) AS test_end
              FROM days d WHERE d.i >= {train} AND (d.i - {train}) % {step} = 0),
        win AS (SELECT * FROM win0 WHERE (SELECT count(*) FROM win0) >= 3)"""
    )


def metric_sql(p: str, prefix: str = "", digits: int = 4) -> str:
    price, guess = "(close * (1 + y))", f"(close * (1 + {p}))"
    return f"""round(avg(abs({price} - {guess})), 2) AS {prefix}mae, round(sqrt(avg(pow({price} - {guess}, 2))), 2) AS {prefix}rmse,
    round(avg(abs({price} - {guess}) / greatest(abs({price}), 2.220446049250313e-16)) * 100, {digits}) AS {prefix}mape,
    round(avg(CASE WHEN sign(y) = sign({p}) THEN 1.0 ELSE 0.0 END) * 100, {digits}) AS {prefix}directional_accuracy"""


def raw_metric_sql(p: str, prefix: str = "") -> str:
    price, guess = "(close * (1 + y))", f"(close * (1 + {p}))"
    return f"""avg(abs({price} - {guess})) AS {prefix}mae, sqrt(avg(pow({price} - {guess}, 2))) AS {prefix}rmse,
    avg(abs({price} - {guess}) / greatest(abs({price}), 2.220446049250313e-16)) * 100 AS {prefix}mape,
    avg(CASE WHEN sign(y) = sign({p}) THEN 1e0 ELSE 0e0 END) * 100 AS {prefix}directional_accuracy"""


def rounded_metrics(df: DataFrame, *keys: str, prefixes=("",)) -> DataFrame:
    cols = []
    for p in prefixes:
        cols += [F.round(f"{p}mae", 2).alias(f"{p}mae"), F.round(f"{p}rmse", 2).alias(f"{p}rmse")]
        cols += [F.round(f"{p}mape", 4).alias(f"{p}mape"), F.round(f"{p}directional_accuracy", 4).alias(f"{p}directional_accuracy")]
    return df.select(*keys, *cols)


def scored(v: Views) -> DataFrame:
    return ev.with_target(v.predictions)


def windows(v: Views, **kw) -> DataFrame:
    return ev.walk_forward_windows(ev.trading_dates(v.bars), **kw)


def cutoff(v: Views) -> DataFrame:
    return ev.global_cutoff(ev.trading_dates(v.bars), min_train_days=MIN_TRAIN)


# ------------------------------------------------------------- target, splits


@case("w20_target", with_views(_TARGET + "SELECT ticker, date, close, y AS target_return_t1 FROM scored", "predictions"))
def w20(v: Views):
    return ev.with_target(v.bars).select("ticker", "date", "close", "target_return_t1")


@case(
    "w21_prediction_alignment",
    with_views(
        f"SELECT ticker, date, close, lag(close * (1 + rf_return)) OVER ({W}) AS rf_pred, lag(close * (1 + lr_return)) OVER ({W}) AS lr_pred "
        "FROM predictions",
        "predictions",
    ),
)
def w21(v: Views):
    from barloom.operators.serve import aligned_history

    return aligned_history(v.predictions, rows=None).select("ticker", "date", "close", "rf_pred", "lr_pred")


@case("w26_global_cutoff", with_views(_CUTOFF + "SELECT cutoff FROM cut", "bars"))
def w26(v: Views):
    return cutoff(v)


@case(
    "w26_global_cutoff_short_history",
    with_views(_DATES + "SELECT max(date) FILTER (n - 1 - i = n // 5) AS cutoff FROM days", "bars"),
)
def w26_short(v: Views):
    return ev.global_cutoff(ev.trading_dates(v.bars), test_days=2000, min_train_days=2000)


for _mode in ("rolling", "expanding"):
    case(f"w27_windows_{_mode}", with_views(_windows(_mode) + "SELECT * FROM win", "bars"))(lambda v, m=_mode: windows(v, mode=m))
case("w27_windows_too_few", with_views(_windows(train=2400) + "SELECT * FROM win", "bars"))(lambda v: windows(v, train=2400))


@case("a06_trading_dates", with_views("SELECT DISTINCT date FROM bars", "bars"))
def a06(v: Views):
    return ev.trading_dates(v.bars)


@case(
    "a05_history_length",
    with_views(_CUTOFF + "SELECT ticker, count(*) AS train_days FROM bars, cut WHERE date <= cutoff GROUP BY ticker", "bars"),
)
def a05(v: Views):
    return ev.history_lengths(v.bars, cutoff(v))


_ELIGIBLE = (
    _CUTOFF
    + f""", elig AS (SELECT m.ticker, count(b.date) AS train_days, count(b.date) >= {MIN_TRAIN} AS is_eligible
          FROM meta m CROSS JOIN cut LEFT JOIN bars b ON b.ticker = m.ticker AND b.date <= cutoff WHERE m.is_active GROUP BY 1)"""
)


@case("j13_eligible_tickers", with_views(_ELIGIBLE + "SELECT * FROM elig", "bars", "meta"))
def j13(v: Views):
    return ev.eligible_tickers(v.bars, v.meta.filter("is_active"), cutoff(v), MIN_TRAIN)


@case(
    "u03_excluded_tickers",
    with_views(
        _ELIGIBLE + "SELECT ticker FROM meta WHERE is_active EXCEPT SELECT ticker FROM elig WHERE is_eligible", "bars", "meta"
    ),
)
def u03(v: Views):
    universe = v.meta.filter("is_active").select("ticker")
    good = ev.eligible_tickers(v.bars, universe, cutoff(v), MIN_TRAIN).filter("is_eligible").select("ticker")
    return universe.join(good, "ticker", "left_anti")


@case(
    "s24_split_record",
    with_views(
        _ELIGIBLE
        + f"""SELECT (SELECT cutoff FROM cut) AS global_cutoff_date, 250 AS test_trading_days_requested,
              {MIN_TRAIN} AS min_train_trading_days_requested, count(*) FILTER (is_eligible) AS valid_tickers_count,
              string_agg(ticker, ',' ORDER BY ticker) FILTER (NOT is_eligible) AS excluded_tickers FROM elig""",
        "bars",
        "meta",
    ),
)
def s24(v: Views):
    day = cutoff(v)
    record = ev.split_record(ev.eligible_tickers(v.bars, v.meta.filter("is_active"), day, MIN_TRAIN), day, 250, MIN_TRAIN)
    return record.withColumn("excluded_tickers", F.array_join("excluded_tickers", ","))


@case(
    "f01_date_range",
    with_views("SELECT ticker, date, close FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'", "bars"),
)
def f01(v: Views):
    return ev.between_dates(v.bars, "1995-01-01", "1996-06-30").select("ticker", "date", "close")


@case(
    "f02_split_by_cutoff",
    with_views(
        _CUTOFF + "SELECT ticker, date, close, CASE WHEN date <= cutoff THEN 'train' ELSE 'test' END AS split FROM bars, cut", "bars"
    ),
)
def f02(v: Views):
    return ev.split_by_cutoff(v.bars, cutoff(v)).select("ticker", "date", "close", "split")


_POOLED = (
    _TARGET
    + _ELIGIBLE
    + """, pooled AS (SELECT s.*, CASE WHEN date <= cutoff THEN 'train' ELSE 'test' END AS split FROM scored s, cut
          WHERE ticker IN (SELECT ticker FROM elig WHERE is_eligible))"""
)


@case(
    "q03_pooled_training_set",
    with_views(_POOLED + "SELECT ticker, date, close, y AS target_return_t1, split FROM pooled", "predictions", "meta"),
)
def q03(v: Views):
    day, universe = cutoff(v), v.meta.filter("is_active")
    good = ev.eligible_tickers(v.bars, universe, day, MIN_TRAIN).filter("is_eligible").select("ticker")
    rows = ev.split_by_cutoff(ev.with_target(v.bars.join(good, "ticker", "left_semi")), day)
    return rows.select("ticker", "date", "close", "target_return_t1", "split")


@case(
    "u01_pooled_configs",
    with_views(
        _TARGET
        + """SELECT 'rf' AS config, count(*) AS n, round(sum(rf_return), 4) AS total FROM scored UNION ALL
             SELECT 'lr', count(*), round(sum(lr_return), 4) FROM scored UNION ALL SELECT 'naive', count(*), 0.0 FROM scored""",
        "predictions",
    ),
)
def u01(v: Views):
    df = configs(v).groupBy("config").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 4).alias("total"))
    return df


def configs(v: Views) -> DataFrame:
    """The same rows once per config; the rows are produced once and unfolded."""
    arms = F.array(
        F.struct(F.lit("rf").alias("config"), F.col("rf_return").alias("prediction")),
        F.struct(F.lit("lr").alias("config"), F.col("lr_return").alias("prediction")),
        F.struct(F.lit("naive").alias("config"), F.lit(0.0).alias("prediction")),
    )
    return scored(v).select("ticker", "date", "close", "target_return_t1", F.explode(arms).alias("c")).select(
        "ticker", "date", "close", "target_return_t1", "c.*"
    )


# -------------------------------------------------------------------- metrics


@case("a07_error_metrics", with_views(_TARGET + f"SELECT ticker, {metric_sql('rf_return')} FROM scored GROUP BY ticker", "predictions"))
def a07(v: Views):
    return rounded_metrics(ev.metrics(scored(v), "ticker", prediction="rf_return"), "ticker")


@case(
    "a08_directional_accuracy",
    with_views(
        _TARGET
        + """SELECT ticker, round(avg(CASE WHEN sign(y) = sign(lr_return) THEN 100.0 ELSE 0 END), 6) AS directional_accuracy,
             round(avg(CASE WHEN y = 0 THEN 100.0 ELSE 0 END), 6) AS naive_directional_accuracy FROM scored GROUP BY ticker""",
        "predictions",
    ),
)
def a08(v: Views):
    df = scored(v).withColumn("zero", F.lit(0.0))
    model = ev.metric_exprs("target_return_t1", "lr_return", "close")[3]
    naive = ev.metric_exprs("target_return_t1", "zero", "close", "naive_")[3]
    out = df.groupBy("ticker").agg(model, naive)
    return out.select("ticker", *[F.round(c, 6).alias(c) for c in ("directional_accuracy", "naive_directional_accuracy")])


@case("m04_naive_persistence", with_views(_TARGET + f"SELECT ticker, {metric_sql('0.0')} FROM scored GROUP BY ticker", "predictions"))
def m04(v: Views):
    return rounded_metrics(ev.metrics(ev.naive_persistence(scored(v)), "ticker"), "ticker")


def _in_window(role: str) -> str:
    return f", hit AS (SELECT s.*, w.* FROM scored s JOIN win w ON s.date BETWEEN w.{role}_start AND w.{role}_end)"


@case(
    "j11_rows_in_train_windows",
    with_views(
        _TARGET + _windows() + _in_window("train") + "SELECT ticker, window_idx, count(*) AS n, round(sum(y), 5) AS total FROM hit GROUP BY 1, 2",
        "predictions",
    ),
)
def j11(v: Views):
    df = ev.rows_in_windows(scored(v), windows(v), "train")
    return df.groupBy("ticker", "window_idx").agg(F.count("*").alias("n"), F.round(F.sum("target_return_t1"), 5).alias("total"))


_RESULTS = (
    _TARGET
    + _windows()
    + _in_window("test")
    + f""", res AS (SELECT ticker, window_idx, train_start, train_end, test_start, test_end, {metric_sql('rf_return')}, {metric_sql('0.0', 'naive_')}
          FROM hit GROUP BY ALL)"""
)


def results(v: Views, prediction: str = "rf_return") -> DataFrame:
    return ev.window_metrics(ev.rows_in_windows(scored(v), windows(v), "test"), prediction)


@case("a09_window_metrics", with_views(_RESULTS + "SELECT * FROM res", "predictions"))
def a09(v: Views):
    keys = ("ticker", "window_idx", "train_start", "train_end", "test_start", "test_end")
    return rounded_metrics(results(v), *keys, prefixes=("", "naive_"))


@case(
    "a10_metrics_by_config",
    with_views(
        _TARGET
        + f""", cfg AS (SELECT 'rf' AS config, ticker, close, y, rf_return AS p FROM scored UNION ALL
                        SELECT 'lr', ticker, close, y, lr_return FROM scored UNION ALL SELECT 'naive', ticker, close, y, 0.0 FROM scored)
             SELECT config, ticker, {metric_sql('p')} FROM cfg GROUP BY GROUPING SETS ((config), (config, ticker))""",
        "predictions",
    ),
)
def a10(v: Views):
    return rounded_metrics(ev.ablation_metrics(configs(v)), "config", "ticker")


# ------------------------------------------------------- registry, promotion

# Three runs of different models; the first is copied with better figures so that some run qualifies.
_RUNS = (
    _TARGET
    + _windows()
    + _in_window("test")
    + ", "
    + ", ".join(
        f"""res_{m} AS (SELECT '{m}' AS run_id, ticker, window_idx, {raw_metric_sql(f'{m}_return')}, {raw_metric_sql('0.0', 'naive_')}
            FROM hit GROUP BY ticker, window_idx)"""
        for m in ("rf", "lr", "xgb")
    )
    + """, res_good AS (SELECT 'good' AS run_id, ticker, window_idx, mae, rmse, mape / 1000 AS mape,
           50 + (window_idx + length(ticker)) % 5 * 0.5 AS directional_accuracy, naive_mae, naive_rmse, naive_mape,
           naive_directional_accuracy FROM res_rf)
, runs_res AS (SELECT * FROM res_rf UNION ALL SELECT * FROM res_lr UNION ALL SELECT * FROM res_xgb UNION ALL SELECT * FROM res_good)"""
)
_METRIC_NAMES = [f"{c}_{s}" for c in rg.NUMERIC for s in ("mean", "std")]
_SUMMARY = (
    _RUNS
    + f""", wide AS (SELECT run_id, ticker, {', '.join(f"CAST(avg({c}) AS DOUBLE) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in rg.NUMERIC)}
          FROM runs_res GROUP BY GROUPING SETS ((run_id), (run_id, ticker))),
summ0 AS (UNPIVOT wide ON {', '.join(_METRIC_NAMES)} INTO NAME metric VALUE value),
worst AS (SELECT run_id, max(m) AS worst_window_mape, min(d) AS worst_window_directional_accuracy FROM (
          SELECT run_id, window_idx, avg(mape) AS m, avg(directional_accuracy) AS d FROM runs_res GROUP BY 1, 2) GROUP BY 1),
summ AS (SELECT run_id, ticker, metric, value FROM summ0 UNION ALL
         SELECT run_id, NULL, 'worst_window_mape', worst_window_mape FROM worst UNION ALL
         SELECT run_id, NULL, 'worst_window_directional_accuracy', worst_window_directional_accuracy FROM worst)"""
)
_RUN_ROWS = """, runs AS (SELECT * FROM (VALUES ('rf', 'baseline', TIMESTAMP '2024-01-03'), ('lr', 'ridge', TIMESTAMP '2024-01-01'),
  ('xgb', 'xgboost', TIMESTAMP '2024-01-04'), ('good', 'baseline', TIMESTAMP '2024-01-02')) t(run_id, model_type, trained_at))"""
RUN_ROWS = [
    ("rf", "baseline", dt.datetime(2024, 1, 3)),
    ("lr", "ridge", dt.datetime(2024, 1, 1)),
    ("xgb", "xgboost", dt.datetime(2024, 1, 4)),
    ("good", "baseline", dt.datetime(2024, 1, 2)),
]


def run_results(v: Views) -> DataFrame:
    """Results of four runs in one frame: the test rows are assigned to windows once.

    The models' errors are aggregated side by side, one group per window and ticker, and only then laid out by run.
    """
    hit = ev.rows_in_windows(scored(v), windows(v), "test").withColumn("zero", F.lit(0.0))
    models = ("rf", "lr", "xgb")
    sums = [x for m in models for x in ev.metric_exprs("target_return_t1", f"{m}_return", "close", f"{m}_")]
    wide = hit.groupBy("ticker", "window_idx").agg(*sums, *ev.metric_exprs("target_return_t1", "zero", "close", "naive_"))
    names = ("mae", "rmse", "mape", "directional_accuracy")

    def run(name: str, model: str, changed: dict[str, Column]) -> Column:
        own = {c: F.col(f"{model}_{c}") for c in names} | changed
        return F.struct(F.lit(name).alias("run_id"), *[x.alias(c) for c, x in own.items()])

    better = {"mape": F.col("rf_mape") / 1000, "directional_accuracy": 50 + (F.col("window_idx") + F.length("ticker")) % 5 * 0.5}
    arms = F.array(*[run(m, m, {}) for m in models], run("good", "rf", better))
    long = wide.withColumn("_a", F.explode(arms))
    return long.select("_a.run_id", "ticker", "window_idx", *[f"_a.{c}" for c in names], *[f"naive_{c}" for c in names])


def run_table(v: Views) -> DataFrame:
    return v.spark.createDataFrame(RUN_ROWS, "run_id string, model_type string, trained_at timestamp_ntz")


def _summary_sql(rows: str) -> str:
    return with_views(_SUMMARY + f"SELECT run_id, ticker, metric, round(value, 4) AS value FROM summ WHERE {rows}", "predictions")


def shown_summary(df: DataFrame) -> DataFrame:
    return df.filter(F.col("value").isNotNull()).withColumn("value", F.round("value", 4))


@case("a11_run_summary", _summary_sql("metric NOT LIKE 'worst%' AND value IS NOT NULL"))
def a11(v: Views):
    return shown_summary(rg.run_summary(run_results(v)).filter("metric not like 'worst%'"))


@case("a12_worst_window", _summary_sql("metric LIKE 'worst%'"))
def a12(v: Views):
    return shown_summary(rg.worst_windows(run_results(v)))


@case(
    "a13_ticker_spread",
    with_views(
        _SUMMARY
        + """SELECT run_id, round(max(value) - min(value), 4) AS ticker_spread FROM summ
             WHERE ticker IS NOT NULL AND metric = 'directional_accuracy_mean' GROUP BY 1""",
        "predictions",
    ),
)
def a13(v: Views):
    df = rg.ticker_spread(rg.run_summary(run_results(v)))
    return df.withColumn("ticker_spread", F.round("ticker_spread", 4))


_GATE = (
    _SUMMARY
    + """, top AS (SELECT run_id, max(value) FILTER (metric = 'directional_accuracy_mean') AS da,
                   max(value) FILTER (metric = 'naive_directional_accuracy_mean') AS nda, max(value) FILTER (metric = 'mape_mean') AS mape,
                   max(value) FILTER (metric = 'worst_window_mape') AS wm, max(value) FILTER (metric = 'worst_window_directional_accuracy') AS wd,
                   count(*) FILTER (value IS NOT NULL AND metric IN ('directional_accuracy_mean', 'directional_accuracy_std', 'mape_mean',
                     'mape_std', 'naive_directional_accuracy_mean', 'naive_mape_mean', 'worst_window_mape',
                     'worst_window_directional_accuracy')) AS present
            FROM summ WHERE ticker IS NULL GROUP BY 1),
spr AS (SELECT run_id, max(value) - min(value) AS s FROM summ WHERE ticker IS NOT NULL AND metric = 'directional_accuracy_mean' GROUP BY 1),
gate AS (SELECT run_id, round(da, 4) AS directional_accuracy_mean, present = 8 AS has_metrics, da - nda >= 2 AS beats_naive, mape <= 15 AS mape_ok,
                wm <= 30 AS worst_mape_ok, wd >= nda AS worst_accuracy_ok, s <= 5 AS spread_ok,
                present = 8 AND da - nda >= 2 AND mape <= 15 AND wm <= 30 AND wd >= nda AND s <= 5 AS promoted FROM top JOIN spr USING (run_id))"""
)


def gate(v: Views) -> DataFrame:
    return rg.promotion_gate(rg.run_summary(run_results(v))).withColumn(
        "directional_accuracy_mean", F.round("directional_accuracy_mean", 4)
    )


@case("m11_promotion_gate", with_views(_GATE + "SELECT * FROM gate", "predictions"))
def m11(v: Views):
    return gate(v)


@case(
    "m12_best_qualifying_run",
    with_views(
        _GATE + "SELECT run_id, directional_accuracy_mean FROM gate WHERE promoted ORDER BY 2 DESC, 1 LIMIT 1", "predictions"
    ),
)
def m12(v: Views):
    return rg.best_qualifying(gate(v)).select("run_id", "directional_accuracy_mean")


@case(
    "j12_candidate_runs",
    with_views(_GATE + "SELECT run_id, promoted FROM gate WHERE run_id IN ('rf', 'good')", "predictions"),
)
def j12(v: Views):
    wanted = v.spark.createDataFrame([("rf",), ("good",)], "run_id string")
    return gate(v).join(F.broadcast(wanted), "run_id", "left_semi").select("run_id", "promoted")


@case(
    "t05_best_run",
    with_views(
        _SUMMARY
        + _RUN_ROWS
        + """SELECT run_id, model_type, round(value, 4) AS value FROM runs JOIN summ USING (run_id)
             WHERE ticker IS NULL AND metric = 'directional_accuracy_mean' AND value IS NOT NULL ORDER BY summ.value DESC, run_id LIMIT 1""",
        "predictions",
    ),
)
def t05(v: Views):
    best = rg.best_run(run_table(v), rg.run_summary(run_results(v)))
    return best.select("run_id", "model_type", F.round("value", 4).alias("value"))


@case(
    "t06_oldest_and_newest_run",
    with_views(
        _SUMMARY
        + _RUN_ROWS
        + """SELECT CASE WHEN trained_at = (SELECT min(trained_at) FROM runs) THEN 'old' ELSE 'new' END AS which, run_id, trained_at,
             round(value, 4) AS value FROM runs JOIN summ USING (run_id) WHERE ticker IS NULL AND metric = 'directional_accuracy_mean'
             AND trained_at IN ((SELECT min(trained_at) FROM runs), (SELECT max(trained_at) FROM runs))""",
        "predictions",
    ),
)
def t06(v: Views):
    df = rg.oldest_and_newest(run_table(v), rg.run_summary(run_results(v)))
    return df.select("which", "run_id", "trained_at", F.round("value", 4).alias("value"))


@case(
    "m10_register_and_read_back",
    with_views(
        _SUMMARY + "SELECT metric, round(value, 4) AS value FROM summ WHERE run_id = 'rf' AND ticker IS NULL AND value IS NOT NULL",
        "predictions",
    ),
)
def m10(v: Views):
    """Register one run in a fresh registry and read its summary back: the scan of the registry tables."""
    from barloom.session import fresh_path

    registry = rg.Registry(v.spark, fresh_path(v.spark, "registry"))
    rows = results(v).select("ticker", *rg.NUMERIC)
    registry.register("rf", "baseline", "v2", ["S1"], rows)
    df = registry.summary().filter("ticker is null and value is not null")
    known = registry.runs().select("run_id")
    return df.join(known, "run_id", "left_semi").select("metric", F.round("value", 4).alias("value"))


@case(
    "m10_register_twice",
    with_views(
        _SUMMARY + "SELECT metric, round(value, 4) AS value FROM summ WHERE run_id = 'rf' AND ticker IS NULL AND value IS NOT NULL",
        "predictions",
    ),
)
def m10_twice(v: Views):
    """Registering a run again replaces it."""
    from barloom.session import fresh_path

    registry = rg.Registry(v.spark, fresh_path(v.spark, "registry"))
    rows = results(v).select("ticker", *rg.NUMERIC)
    for _ in range(2):
        registry.register("rf", "baseline", "v2", ["S1"], rows)
    df = registry.summary().filter("ticker is null and value is not null")
    return df.join(registry.runs().select("run_id"), "run_id").select("metric", F.round("value", 4).alias("value"))


def registered(v: Views):
    from barloom.session import fresh_path

    registry = rg.Registry(v.spark, fresh_path(v.spark, "registry"))
    registry.register("rf", "baseline", "v2", ["S1"], results(v).select("ticker", *rg.NUMERIC), trained_at="2024-01-03")
    registry.register("lr", "ridge", "v2", ["S1"], results(v, "lr_return").select("ticker", *rg.NUMERIC), trained_at="2024-01-01")
    return registry


@case(
    "s20_register_runs",
    with_views(
        _SUMMARY
        + """SELECT run_id, ticker, round(value, 4) AS value FROM summ WHERE run_id IN ('rf', 'lr') AND metric = 'mape_mean'""",
        "predictions",
    ),
)
def s20(v: Views):
    df = registered(v).summary().filter("metric = 'mape_mean'")
    return df.select("run_id", "ticker", F.round("value", 4).alias("value"))


@case(
    "s21_registry_scan",
    with_views(
        _RUNS
        + _RUN_ROWS
        + """SELECT run_id, model_type, count(*) AS results FROM runs JOIN runs_res USING (run_id) WHERE run_id IN ('rf', 'lr') GROUP BY 1, 2""",
        "predictions",
    ),
)
def s21(v: Views):
    registry = registered(v)
    return registry.runs().join(registry.results(), "run_id").groupBy("run_id", "model_type").agg(F.count("*").alias("results"))


# The labels and the ends of the scaled sequences, which SQL can state.
@case(
    "m13_sequence_labels",
    with_views(
        _TARGET
        + _CUTOFF
        + f""", p AS (SELECT s.*, CASE WHEN date <= cutoff THEN 'train' ELSE 'test' END AS split FROM scored s, cut),
rng AS (SELECT min(rf_return) AS a, max(rf_return) AS b, min(y) AS c, max(y) AS d FROM p WHERE split = 'train'),
sc AS (SELECT ticker, date, split, (rf_return - a) / (b - a) AS x, (y - c) / (d - c) AS label FROM p, rng)
SELECT ticker, date, f AS sequence_start, n AS size, round(x, 8) AS newest, round(x0, 8) AS oldest, round(label, 8) AS label, split FROM (
  SELECT *, count(*) OVER k AS n, min(date) OVER k AS f, first_value(x) OVER k AS x0, lead(date) OVER (PARTITION BY ticker, split ORDER BY date) AS nxt
  FROM sc WINDOW k AS (PARTITION BY ticker, split ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n = 30 AND nxt IS NOT NULL""",
        "predictions",
    ),
)
def m13_labels(v: Views):
    panel = ev.split_by_cutoff(scored(v), cutoff(v))
    df = ev.sequence_dataset(panel, v.meta, ["rf_return"], 30)
    seq = F.col("sequence")
    return df.select(
        "ticker",
        "date",
        "sequence_start",
        F.size(seq).cast("long").alias("size"),
        F.round(seq[29][0], 8).alias("newest"),
        F.round(seq[0][0], 8).alias("oldest"),
        F.round("label", 8).alias("label"),
        F.when(F.col("part") == "test", "test").otherwise("train").alias("split"),
    )


# ------------------------------------------------------ sequences and scaling


_SEQ_WINDOW = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@case(
    "w22_sequences",
    with_views(
        f"""SELECT ticker, date, s AS sequence_start, n AS size, round(first_close, 2) AS first_close, round(last_close, 2) AS last_close,
             round(total, 2) AS total FROM (SELECT ticker, date, count(*) {_SEQ_WINDOW} AS n, min(date) {_SEQ_WINDOW} AS s,
             first_value(close) {_SEQ_WINDOW} AS first_close, close AS last_close, sum(close) {_SEQ_WINDOW} AS total,
             lead(date) OVER ({W}) AS nxt FROM bars) WHERE n = 30 AND nxt IS NOT NULL""",
        "bars",
    ),
)
def w22(v: Views):
    df = ev.sequences(v.bars, ["close", "volume"], 30)
    seq = F.col("sequence")
    total = F.aggregate(seq, F.lit(0.0), lambda a, r: a + r[0])
    return df.select(
        "ticker",
        "date",
        "sequence_start",
        F.size(seq).cast("long").alias("size"),
        F.round(seq[0][0], 2).alias("first_close"),
        F.round(seq[29][0], 2).alias("last_close"),
        F.round(total, 2).alias("total"),
    )


_BEFORE = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"


@case(
    "w23_serving_sequences",
    with_views(
        f"""SELECT ticker, date, f AS first_close, l AS last_close FROM (SELECT ticker, date, count(*) {_BEFORE} AS n,
             first_value(close) {_BEFORE} AS f, last_value(close) {_BEFORE} AS l FROM bars) WHERE n = 30""",
        "bars",
    ),
)
def w23(v: Views):
    df = ev.sequences(v.bars, ["close"], 30, mode="serving")
    return df.select("ticker", "date", F.col("sequence")[0][0].alias("first_close"), F.col("sequence")[29][0].alias("last_close"))


@case(
    "c16_min_max_scaling",
    with_views(
        _CUTOFF
        + """, rng AS (SELECT min(close) AS lo, max(close) AS hi, min(volume) AS vlo, max(volume) AS vhi FROM bars, cut WHERE date <= cutoff)
             SELECT ticker, date, (close - lo) / (hi - lo) AS close, (volume - vlo) / CAST(vhi - vlo AS DOUBLE) AS volume, 0.0::DOUBLE AS flat
             FROM bars, rng""",
        "bars",
    ),
)
def c16(v: Views):
    df = v.bars.select("ticker", "date", "close", F.col("volume").cast("double").alias("volume"), F.lit(7.0).alias("flat"))
    columns = ["close", "volume", "flat"]
    bounds = ev.min_max_bounds(ev.split_by_cutoff(df, cutoff(v)).filter("split = 'train'"), columns)
    return ev.min_max_scale(df, bounds, columns)


@case(
    "c15_category_ids",
    with_views("SELECT ticker, CAST(row_number() OVER (ORDER BY ticker) - 1 AS INTEGER) AS ticker_id FROM meta", "meta"),
)
def c15(v: Views):
    return ev.category_ids(v.meta, "ticker", "ticker_id")


@case("m13_sequence_dataset")
def m13(v: Views):
    """Scaled sequences with ids and validation split, ready for a sequence trainer."""
    panel = ev.split_by_cutoff(scored(v), cutoff(v))
    return ev.sequence_dataset(panel, v.meta, ["rf_return", "lr_return"], 30)
