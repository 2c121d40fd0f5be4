"""Building the base tables: bar cleaning, macro assembly, fundamentals derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]
MACRO_COLUMNS = ["pkr_usd_rate", "brent_oil_price", "sp500_close", "nasdaq_close", "dxy_close", "us10y_yield"]


def require_columns(df: DataFrame, required) -> DataFrame:
    """Refuse a frame that lacks a required column."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    return df


def clean_bars(raw: DataFrame, ticker: Column | str | None = None) -> DataFrame:
    """Vendor bars to the bar schema.

    Column names are lower-cased, numbers that do not parse become null, NaN becomes null, rows
    without date or close are dropped. ``ticker`` is a constant, a column, or the ticker column.
    """
    df = raw.toDF(*[c.lower() for c in raw.columns])
    require_columns(df, BAR_COLUMNS)
    name = F.col("ticker") if ticker is None else (F.lit(ticker) if isinstance(ticker, str) else ticker)
    number = {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None)) for c in BAR_COLUMNS[1:]}
    return df.select(
        F.upper(name).alias("ticker"),
        F.col("date").try_cast("date").alias("date"),
        *[number[c].alias(c) for c in BAR_COLUMNS[1:-1]],
        number["volume"].cast("long").alias("volume"),
    ).dropna(subset=["date", "close"])


def macro_table(series: DataFrame, policy_rate: Column | float = 22.0, synthetic: bool = True) -> DataFrame:
    """Long (series, date, close) rows to one row per date.

    A pivot over the fixed list of series is an n-way full outer join on date in a single shuffle.
    The policy rate has no source of its own, so it is given and flagged as synthetic. Of several values of
    one series and date the greatest counts, whatever order the rows come in.
    """
    rate = F.lit(policy_rate) if isinstance(policy_rate, (int, float)) else policy_rate
    return (
        series.filter(F.col("close").isNotNull())
        .groupBy("date")
        .pivot("series", MACRO_COLUMNS)
        .agg(F.max("close"))
        .withColumn("sbp_policy_rate", rate.cast("double"))
        .withColumn("is_synthetic_rate", F.lit(synthetic))
    )


# Field names of the statements (fixed values).
STATEMENT_FIELDS = [
    "Basic EPS",
    "Diluted EPS",
    "Net Income",
    "Net Income Common Stockholders",
    "Basic Average Shares",
    "Ordinary Shares Number",
    "Stockholders Equity",
    "Common Stock Equity",
    "Total Debt",
]


def derive_fundamentals(statements: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Long statement items (ticker, report_date, field, value) to the fundamentals table.

    Per-share earnings fall back on a missing value only; the other chains also skip a zero, so
    they use ``nullif`` first. ``info`` (ticker, eps, pe_ratio, roe, debt_to_equity,
    book_value_per_share) may complete the newest period of a ticker. Periods without any value are
    dropped. Of several values of one item the greatest counts, whatever order the rows come in.
    """
    wide = (
        statements.filter(~F.isnan("value"))
        .groupBy("ticker", "report_date")
        .pivot("field", STATEMENT_FIELDS)
        .agg(F.max("value"))
    )
    item = {f: F.col(f"`{f}`") for f in STATEMENT_FIELDS}

    def first_nonzero(a: str, b: str) -> Column:
        return F.coalesce(F.nullif(item[a], F.lit(0.0)), item[b])

    def over_positive(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den)

    shares_for_eps = first_nonzero("Basic Average Shares", "Ordinary Shares Number")
    shares = first_nonzero("Ordinary Shares Number", "Basic Average Shares")
    equity = first_nonzero("Stockholders Equity", "Common Stock Equity")
    income = first_nonzero("Net Income Common Stockholders", "Net Income")
    df = wide.select(
        F.upper("ticker").alias("ticker"),
        "report_date",
        F.coalesce(item["Basic EPS"], item["Diluted EPS"], over_positive(item["Net Income"], shares_for_eps)).alias("eps"),
        F.lit(None).cast("double").alias("pe_ratio"),
        over_positive(income, equity).alias("roe"),
        over_positive(item["Total Debt"], equity).alias("debt_to_equity"),
        over_positive(equity, shares).alias("book_value_per_share"),
    )
    values = ["eps", "pe_ratio", "roe", "debt_to_equity", "book_value_per_share"]
    if info is not None:
        newest = F.max("report_date").over(Window.partitionBy("ticker")) == F.col("report_date")
        known = info.select("ticker", *[F.col(c).alias(f"_{c}") for c in values])
        df = df.withColumn("_newest", newest).join(known, "ticker", "left")
        df = df.withColumns({c: F.coalesce(c, F.when(F.col("_newest"), F.col(f"_{c}"))) for c in values})
        df = df.drop("_newest", *[f"_{c}" for c in values])
    return df.dropna("all", subset=values)


def read_constituents(spark, path: str) -> DataFrame:
    """Constituents file with header; values may hold quoted commas."""
    schema = "ticker string, company_name string, sector string, fetched_at string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
