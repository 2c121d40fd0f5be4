"""Models: ridge with closed forms in SQL, tree ensembles by row count, walk-forward, ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import evaluate as ev
from barloom.operators import models as m
from barloom.operators import serve
from barloom.operators import technical as t
from barloom.plans import ablation
from barloom.plans import features as fb
from barloom.session import settle
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.evaluation import _CUTOFF, MIN_TRAIN, _windows, cutoff, metric_sql, rounded_metrics, windows
from barloom.suite.panel import FULL_BUILD, FULL_VIEWS, _not_null, tables
from barloom.suite.sql_views import with_views

W = "PARTITION BY ticker ORDER BY date"
FEATURES = ["daily_return", "return_lag_1"]
_SET = f"""
, lagged AS (SELECT *, lag(daily_return) OVER ({W}) AS return_lag_1, (lead(close) OVER ({W}) - close) / close AS y FROM returns),
rows AS (SELECT * FROM lagged WHERE y IS NOT NULL AND return_lag_1 IS NOT NULL AND daily_return IS NOT NULL)"""


def two_features(v: Views):
    return ev.with_target(t.daily_returns(v.bars, (1,))).dropna("any")


def stored_pair(v: Views):
    """The two features from stored bars, stored for the fits and scores that read them again and again."""
    return settle(ev.with_target(t.daily_returns(v.stored_bars, (1,))).dropna("any"), "two-features")


def stored_cutoff(v: Views):
    """The cutoff of :func:`cutoff` from stored bars."""
    return ev.global_cutoff(ev.trading_dates(v.stored_bars), min_train_days=MIN_TRAIN)


def train_part(df, v: Views):
    return ev.split_by_cutoff(df, settle(stored_cutoff(v), "cutoff")).filter("split = 'train'")


_RIDGE = (
    _SET
    + _CUTOFF
    + """, tr AS (SELECT * FROM rows, cut WHERE date <= cutoff),
mid AS (SELECT avg(daily_return) AS m1, avg(return_lag_1) AS m2, avg(y) AS my FROM tr),
g AS (SELECT sum((daily_return - m1) * (daily_return - m1)) + 1 AS a, sum((daily_return - m1) * (return_lag_1 - m2)) AS b,
             sum((return_lag_1 - m2) * (return_lag_1 - m2)) + 1 AS d, sum((daily_return - m1) * (y - my)) AS p,
             sum((return_lag_1 - m2) * (y - my)) AS q, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my FROM tr, mid),
w AS (SELECT (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2, * FROM g)"""
)


@case(
    "m02_ridge_coefficients",
    with_views(
        _RIDGE
        + """SELECT 'intercept' AS feature, round(my - w1 * m1 - w2 * m2, 6) AS coefficient FROM w UNION ALL
             SELECT 'daily_return', round(w1, 6) FROM w UNION ALL SELECT 'return_lag_1', round(w2, 6) FROM w""",
        "returns",
    ),
)
def m02(v: Views):
    model = m.fit_ridge(train_part(two_features(v), v), FEATURES)
    return m.ridge_coefficients(model, FEATURES).withColumn("coefficient", F.round("coefficient", 6))


@case(
    "m02_ridge_test_metrics",
    with_views(
        _RIDGE
        + f""", te AS (SELECT close, y, my - w1 * m1 - w2 * m2 + w1 * daily_return + w2 * return_lag_1 AS p FROM rows, cut, w WHERE date > cutoff)
              SELECT count(*) AS n, {metric_sql('p')} FROM te""",
        "returns",
    ),
)
def m02_metrics(v: Views):
    split = ev.split_by_cutoff(stored_pair(v), settle(stored_cutoff(v), "cutoff"))
    model = m.fit_ridge(split.filter("split = 'train'"), FEATURES)
    scored = m.predict(model, split.filter("split = 'test'"))
    out = scored.agg(F.count("*").alias("n"), *ev.metric_exprs("target_return_t1", "prediction", "close"))
    return rounded_metrics(out, "n")


@case(
    "m08_scored_history",
    with_views(
        _RIDGE
        + f""", p AS (SELECT ticker, date, close, close * (1 + my - w1 * m1 - w2 * m2 + w1 * daily_return + w2 * return_lag_1) AS price FROM lagged, w),
              h AS (SELECT ticker, date, close, lag(price) OVER ({W}) AS pred, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM p)
              SELECT ticker, date, close, round(pred, 1) AS lr_pred FROM h WHERE rn <= 1825""",
        "returns",
    ),
)
def m08_scored(v: Views):
    """A ridge is fitted, registered and promoted; the promoted model is loaded, scores all history and is served."""
    from barloom.plans import daily
    from barloom.session import fresh_path
    from barloom.sources.registry import NUMERIC, PromotionRules, Registry

    registry = Registry(v.spark, fresh_path(v.spark, "registry"))
    pair = stored_pair(v)
    train = ev.split_by_cutoff(pair, settle(stored_cutoff(v), "cutoff")).filter("split = 'train'")
    model = m.fit_ridge(train, FEATURES)
    path = f"{registry.folder}/models/one"
    model.write().save(path)
    spans = ev.walk_forward_windows(ev.trading_dates(v.stored_bars))
    results = ev.window_metrics(m.walk_forward_ridge(pair, spans, FEATURES))
    registry.register("one", "ridge", "v2", [], results.select("ticker", *NUMERIC), model_path=path)
    # These bars follow no market: the rules are set so that any run with all its metrics is served.
    open_rules = PromotionRules(accuracy_margin=-100.0, max_mape=1e12, max_worst_window_mape=1e12, max_ticker_spread=100.0)
    registry.promote_each(open_rules)
    scored = daily.score_production(t.daily_returns(v.stored_bars, (1,)), registry)
    return serve.aligned_history(scored, models=("lr",)).withColumn("lr_pred", F.round("lr_pred", 1))


_ONE = (
    _SET
    + _windows()
    + """, fit AS (SELECT ticker, window_idx, sum((daily_return - mx) * (y - my)) / (sum((daily_return - mx) * (daily_return - mx)) + 1) AS b,
                   any_value(mx) AS mx, any_value(my) AS my
            FROM (SELECT r.ticker, w.window_idx, daily_return, y, avg(daily_return) OVER k AS mx, avg(y) OVER k AS my
                  FROM rows r JOIN win w ON r.date BETWEEN w.train_start AND w.train_end WINDOW k AS (PARTITION BY r.ticker, w.window_idx))
            GROUP BY 1, 2),
out AS (SELECT r.ticker, w.window_idx, r.date, r.close, r.y, my + b * (daily_return - mx) AS p
        FROM rows r JOIN win w ON r.date BETWEEN w.test_start AND w.test_end JOIN fit f ON f.ticker = r.ticker AND f.window_idx = w.window_idx)"""
)


@case(
    "m05_walk_forward_ridge",
    with_views(_ONE + f"SELECT ticker, window_idx, {metric_sql('p')}, {metric_sql('0.0', 'naive_')} FROM out GROUP BY 1, 2", "returns"),
)
def m05(v: Views):
    scored = m.walk_forward_ridge(two_features(v), windows(v), ["daily_return"])
    return rounded_metrics(ev.window_metrics(scored), "ticker", "window_idx", prefixes=("", "naive_"))


#: All 48 features of rows that have every one of them, with the target.
_WHOLE = (
    FULL_BUILD
    + f""", built AS (SELECT ticker, date, close, pe_ratio, (lead(close) OVER ({W}) - close) / close AS y FROM panel WHERE {_not_null(False)}),
rows48 AS (SELECT ticker, date, close, y FROM built WHERE y IS NOT NULL AND pe_ratio IS NOT NULL)"""
)
_JUDGED = f"count(*) AS n, true AS predicted, {metric_sql('0.0', 'naive_')}"


def whole_panel(v: Views):
    """The full feature build, stored once for the fits that read it again and again."""
    df = ev.with_target(fb.build_features(*tables(v)))
    return settle(df.dropna("any", subset=fb.FEATURES), "whole")


def judged(scored, *keys: str):
    """What SQL can say of any model: rows, whether each has a prediction, and the errors of naive persistence."""
    df = scored.withColumn("_naive", F.lit(0.0))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.count("prediction") == F.count("*")).alias("predicted"),
        *ev.metric_exprs(m.LABEL, "_naive", "close", "naive_"),
    )
    return rounded_metrics(out, *keys, "n", "predicted", prefixes=("naive_",))


def _whole_sql(query: str, part: str) -> str:
    return with_views(_WHOLE + part + query, *FULL_VIEWS, recursive=True)


_WINDOWED = """, fit AS (SELECT DISTINCT ticker, window_idx FROM rows48 r JOIN win w ON r.date BETWEEN w.train_start AND w.train_end),
hit AS (SELECT r.*, w.window_idx FROM rows48 r JOIN win w ON r.date BETWEEN w.test_start AND w.test_end
        JOIN fit f ON f.ticker = r.ticker AND f.window_idx = w.window_idx)
"""


@case("m05_walk_forward_trees", _whole_sql(_WINDOWED + f"SELECT ticker, window_idx, {_JUDGED} FROM hit GROUP BY 1, 2", _windows()))
def m05_trees(v: Views):
    """Boosted trees of every (window, ticker): 200 rounds, eight tenths of rows and columns, all features."""
    return judged(m.walk_forward_trees(whole_panel(v), windows(v), fb.FEATURES), "ticker", "window_idx")


@case(
    "m05_walk_forward_ridge_all_features",
    _whole_sql(_WINDOWED + f"SELECT ticker, window_idx, {_JUDGED} FROM hit GROUP BY 1, 2", _windows()),
)
def m05_all(v: Views):
    return judged(m.walk_forward_ridge(whole_panel(v), windows(v), fb.FEATURES), "ticker", "window_idx")


@case("x04_callable_evaluator", with_views(_SET + _windows() + f""", hit AS (
      SELECT ticker, window_idx, close, y FROM rows r JOIN win w ON r.date BETWEEN w.test_start AND w.test_end)
      SELECT ticker, window_idx, {metric_sql('0.0')} FROM hit GROUP BY 1, 2""", "returns"))  # fmt: skip
def x04(v: Views):
    """The evaluator takes any fit function and row transform; here a model that always says zero."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    def fit(_rows):
        return PipelineModel(stages=[SQLTransformer(statement="SELECT *, 0D AS prediction FROM __THIS__")])

    panel = settle(two_features(v), "panel")
    scored = m.walk_forward(panel, windows(v), fit, lambda df: df.select("ticker", "date", "close", m.LABEL))
    return rounded_metrics(ev.window_metrics(scored), "ticker", "window_idx")


_TESTED = f"SELECT ticker, {_JUDGED} FROM rows48, cut WHERE date > cutoff GROUP BY 1"


@case("m01_random_forest", _whole_sql(_TESTED, _CUTOFF))
def m01(v: Views):
    """A hundred trees of depth ten on all features of all tickers."""
    split = ev.split_by_cutoff(whole_panel(v), settle(stored_cutoff(v), "cutoff"))
    model = m.fit_baseline(split.filter("split = 'train'"), fb.FEATURES)
    return judged(m.predict(model, split.filter("split = 'test'")), "ticker")


@case("m03_boosted_trees", _whole_sql(_TESTED, _CUTOFF))
def m03(v: Views):
    """A hundred boosted trees on all features with encoded ticker and sector."""
    split = ev.split_by_cutoff(whole_panel(v), settle(stored_cutoff(v), "cutoff"))
    model = m.fit_boosted(split.filter("split = 'train'"), fb.FEATURES)
    return judged(m.predict(model, split.filter("split = 'test'")), "ticker")


def _encoding_sql(category: str) -> str:
    return f"""
, {category}_part AS (SELECT {category} AS k, fold, sum(y) AS s, count(*) AS n FROM trf GROUP BY 1, 2),
{category}_every AS (SELECT k, sum(s) AS s, sum(n) AS n FROM {category}_part GROUP BY 1)"""


_ENCODED = (
    _SET
    + _CUTOFF
    + f""", named AS (SELECT r.ticker, r.date, r.y, sector, r.date <= cutoff AND r.ticker <> 'S1' AS known,
                      (r.date - DATE '1970-01-01') % {m.FOLDS} AS fold FROM rows r JOIN meta m ON m.ticker = r.ticker, cut),
trf AS (SELECT * FROM named WHERE known),
mean AS (SELECT fold, (SELECT avg(y) FROM trf t WHERE t.fold <> f.fold) AS other FROM (SELECT DISTINCT fold FROM trf) f)"""
    + _encoding_sql("ticker")
    + _encoding_sql("sector")
)
_SMOOTH = f"round(({{s}} + {m.SMOOTHING} * {{p}}) / ({{n}} + {m.SMOOTHING}), 8) AS {{name}}"


@case(
    "m03_category_encoding",
    with_views(
        _ENCODED
        + f"""SELECT r.ticker, r.date, {_SMOOTH.format(s='(te.s - tp.s)', n='(te.n - tp.n)', p='other', name='ticker_encoded')},
              {_SMOOTH.format(s='(se.s - sp.s)', n='(se.n - sp.n)', p='other', name='sector_encoded')}
              FROM trf r JOIN mean USING (fold) JOIN ticker_part tp ON tp.k = r.ticker AND tp.fold = r.fold JOIN ticker_every te ON te.k = r.ticker
              JOIN sector_part sp ON sp.k = r.sector AND sp.fold = r.fold JOIN sector_every se ON se.k = r.sector
              UNION ALL SELECT r.ticker, r.date, {_SMOOTH.format(s='coalesce(te.s, 0)', n='coalesce(te.n, 0)', p='p', name='ticker_encoded')},
              {_SMOOTH.format(s='coalesce(se.s, 0)', n='coalesce(se.n, 0)', p='p', name='sector_encoded')}
              FROM named r LEFT JOIN ticker_every te ON te.k = r.ticker LEFT JOIN sector_every se ON se.k = r.sector, (SELECT avg(y) AS p FROM trf)
              WHERE NOT known""",
        "returns",
        "meta",
    ),
)
def m03_encoding(v: Views):
    """Training rows by the other folds, other rows by all of training; one ticker is kept out of training."""
    split = ev.split_by_cutoff(two_features(v).join(v.meta.select("ticker", "sector"), "ticker"), cutoff(v))
    known = (F.col("split") == "train") & (F.col("ticker") != "S1")
    train = settle(split.filter(known), "encoded")
    columns = ["ticker", "date", *[F.round(m.encoded_name(c), 8).alias(m.encoded_name(c)) for c in m.CATEGORIES]]
    later = m.category_encoder(train).transform(split.filter(~known))
    return m.out_of_fold(train).select(*columns).unionByName(later.select(*columns))


_NAMES = ", ".join(f"'{c}'" for c in fb.FEATURES)


@case(
    "m07_feature_importance",
    f"SELECT unnest([{_NAMES}, 'ticker_encoded', 'sector_encoded']) AS feature, true AS counted, CAST(1.0 AS DOUBLE) AS total",
)
def m07(v: Views):
    """Importance of every feature in the boosted model; they add up to one."""
    shares = settle(m.feature_importance(m.fit_boosted(train_part(whole_panel(v), v), fb.FEATURES)), "importance")
    whole = shares.agg(F.round(F.sum("importance"), 6)).scalar()
    return shares.select("feature", (F.col("importance") >= 0).alias("counted"), whole.alias("total"))


@case("t03_top_importance", "SELECT CAST(range + 1 AS INTEGER) AS place, true AS falls FROM range(15)")
def t03(v: Views):
    """The fifteen features of the forest that count most, none above the one before it."""
    from pyspark.sql import Window

    top = settle(m.feature_importance(m.fit_baseline(train_part(whole_panel(v), v), fb.FEATURES), 15), "top")
    w = Window.partitionBy().orderBy(F.col("importance").desc(), "feature")  # fifteen rows
    before = F.coalesce(F.lag("importance").over(w), F.lit(1.0))
    return top.select(F.row_number().over(w).alias("place"), (F.col("importance") <= before).alias("falls"))


@case(
    "c14_category_codes",
    with_views(
        _CUTOFF
        + """, vocab AS (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS code FROM (
                SELECT DISTINCT sector FROM meta WHERE is_active AND sector <> 'EUROPE'))
             SELECT ticker, CAST(coalesce(code, (SELECT count(*) FROM vocab)) AS DOUBLE) AS sector_index FROM meta LEFT JOIN vocab USING (sector)""",
        "bars",
        "meta",
    ),
)
def c14(v: Views):
    """Codes by the vocabulary of the training rows; a sector unseen there gets the code after the last."""
    from pyspark.ml.feature import StringIndexer

    indexer = StringIndexer(inputCol="sector", outputCol="sector_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    model = indexer.fit(v.meta.filter("is_active and sector <> 'EUROPE'"))
    return model.transform(v.meta).select("ticker", "sector_index")


@case(
    "m06_ablation_naive",
    with_views(
        _SET
        + _CUTOFF
        + f""", te AS (SELECT ticker, close, y FROM lagged, cut WHERE y IS NOT NULL AND date > cutoff)
              SELECT 'naive' AS config, ticker, {metric_sql('0.0')} FROM te GROUP BY GROUPING SETS ((), (ticker))""",
        "returns",
    ),
)
def m06_naive(v: Views):
    test = ev.split_by_cutoff(ev.with_target(v.bars), cutoff(v)).filter("split = 'test'")
    scored = ev.naive_persistence(test).withColumn("config", F.lit("naive"))
    return rounded_metrics(ev.ablation_metrics(scored), "config", "ticker")


@case("m06_ablation")
def m06(v: Views):
    """All four configs with their own features; twenty rounds each (see README)."""
    sectors = v.meta.select("ticker", "sector")
    full = settle(fb.build_features(*tables(v)), "full")
    original = settle(ablation.original_panel(v.bars, v.daily_sentiment, v.dividends).join(sectors, "ticker"), "original")
    return ablation.run_ablation(original, full, settle(cutoff(v), "cutoff"), lambda rows, f: m.fit_boosted(rows, f, trees=20))


@case("q02_daily_job")
def q02(v: Views):
    """Features, three models, walk-forward, registration and promotion, all as the library's defaults say; shows the registered runs."""
    from barloom.plans import daily
    from barloom.session import fresh_path
    from barloom.sources.registry import Registry, promotion_gate

    registry = Registry(v.spark, fresh_path(v.spark, "registry"))
    daily.run_daily(v.spark, daily.Tables(*tables(v)), registry)
    runs = registry.runs().select("run_id", "model_type", "feature_set_version")
    return runs.join(promotion_gate(registry.summary()), "run_id").drop("run_id")
