"""Sources, cleaning, upserts, assembly and page fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators.technical import sma_distance
from barloom.plans import features as fb
from barloom.session import fresh_path
from barloom.sources import assemble, html
from barloom.sources import upsert as up
from barloom.sources.views import Views
from barloom.suite.case import case
from barloom.suite.sql_views import full, with_views

# --------------------------------------------------------------------- bars


@case("s01_load_bars", with_views("SELECT * FROM bars WHERE ticker = 'S7'", "bars"))
def s01(v: Views):
    """A cleaned copy partitioned by ticker; reading one ticker prunes the others."""
    path = fresh_path(v.spark, "bars")
    v.bars.hint("rebalance", "ticker").write.partitionBy("ticker").parquet(path)
    schema = "open double, high double, low double, close double, volume bigint, date date, ticker string"
    return v.spark.read.schema(schema).parquet(path).filter("ticker = 'S7'")


_RAW = """
, raw AS (SELECT lower(ticker) AS ticker, CASE WHEN day(date) = 13 THEN 'n/a' ELSE CAST(date AS VARCHAR) END AS date,
                 CASE WHEN volume % 7 = 0 THEN '-' ELSE CAST(open AS VARCHAR) END AS open, CAST(high AS VARCHAR) AS high,
                 CAST(low AS VARCHAR) AS low, CASE WHEN volume % 11 = 0 THEN '' ELSE CAST(close AS VARCHAR) END AS close, volume FROM bars)"""


@case(
    "s02_clean_bars",
    with_views(
        _RAW
        + """SELECT upper(ticker) AS ticker, TRY_CAST(date AS DATE) AS date, TRY_CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high,
             CAST(low AS DOUBLE) AS low, TRY_CAST(close AS DOUBLE) AS close, volume
             FROM raw WHERE TRY_CAST(date AS DATE) IS NOT NULL AND TRY_CAST(close AS DOUBLE) IS NOT NULL""",
        "bars",
    ),
)
def s02(v: Views):
    b = v.bars
    raw = b.select(
        F.lower("ticker").alias("Ticker"),
        F.when(F.dayofmonth("date") == 13, "n/a").otherwise(F.col("date").cast("string")).alias("Date"),
        F.when(F.col("volume") % 7 == 0, "-").otherwise(F.col("open").cast("string")).alias("OPEN"),
        F.col("high").cast("string").alias("High"),
        F.col("low").cast("string").alias("Low"),
        F.when(F.col("volume") % 11 == 0, "").otherwise(F.col("close").cast("string")).alias("Close"),
        F.col("volume").cast("string").alias("Volume"),
    )
    return assemble.clean_bars(raw)


# ------------------------------------------------------------------- upserts


def _upsert_sql(view: str, date: str, rule: up.UpsertRule, kept: list[str], changed: dict[str, str], split: tuple[str, str]) -> str:
    """Full outer join of the stored part and the batch, as the conflict clause is defined."""
    keys = ", ".join(rule.keys)
    new = ", ".join(f"{changed.get(c, c)} AS {c}" for c in (*rule.updates, *kept))
    picks = [f"CASE WHEN n.present THEN n.{c} ELSE o.{c} END AS {c}" for c in rule.updates]
    picks += [f"CASE WHEN o.present THEN o.{c} ELSE n.{c} END AS {c}" for c in kept]
    return f"""
, o AS (SELECT *, true AS present FROM {view} WHERE {date} < DATE '{split[1]}'),
n AS (SELECT {keys}, {new}, true AS present FROM {view} WHERE {date} >= DATE '{split[0]}')
SELECT {keys}, {', '.join(picks)} FROM o FULL JOIN n USING ({keys})"""


def _upserted(df: DataFrame, date: str, rule: up.UpsertRule, changed: dict, split: tuple[str, str]) -> DataFrame:
    stored = df.filter(F.col(date) < F.lit(split[1]).cast("date"))
    batch = df.filter(F.col(date) >= F.lit(split[0]).cast("date"))
    return up.upsert(stored, batch.withColumns({k: F.expr(x) for k, x in changed.items()}), rule)


#: (inventory id, view, date column, rule, columns that a conflict keeps, changes of the batch)
UPSERTS = [
    ("s04_upsert_bars", "bars", "date", up.BARS, [], {"close": "close * 2", "open": "CASE WHEN volume % 2 = 0 THEN open END"}),
    ("s05_upsert_sentiment", "daily_sentiment", "date", up.SENTIMENT, [], {"sentiment_score": "sentiment_score / 2"}),
    ("s08_upsert_dividends", "dividends", "ex_dividend_date", up.DIVIDENDS, ["dividend_type"],
     {"dividend_amount": "dividend_amount * 3", "dividend_type": "'Stock'"}),
    ("s07_upsert_macro_partial", "macro", "date", up.MACRO, ["sp500_close", "nasdaq_close", "dxy_close", "us10y_yield"],
     {c: f"{c} * 2" for c in ("sbp_policy_rate", "pkr_usd_rate", "sp500_close", "dxy_close", "us10y_yield")}),
    ("s07_upsert_macro_all", "macro", "date", up.MACRO_ALL, [],
     {c: f"{c} * 2" for c in ("sbp_policy_rate", "pkr_usd_rate", "sp500_close", "dxy_close", "us10y_yield")}),
]
_SPLIT = ("1996-01-01", "1997-01-01")

for _name, _view, _date, _rule, _kept, _changed in UPSERTS:
    case(_name, with_views(_upsert_sql(_view, _date, _rule, _kept, _changed, _SPLIT), _view))(
        lambda v, a=(_view, _date, _rule, _changed): _upserted(getattr(v, a[0]), a[1], a[2], a[3], _SPLIT)
    )


_FUND_CHANGE = {"eps": "eps * 2", "roe": "CASE WHEN debt_to_equity > 1 THEN roe END"}


@case(
    "s06_upsert_fundamentals",
    with_views(
        ", f AS (SELECT *, CAST(NULL AS DOUBLE) AS pe_ratio FROM fundamentals)"
        + _upsert_sql("f", "report_date", up.FUNDAMENTALS, [], _FUND_CHANGE, _SPLIT),
        "fundamentals",
    ),
)
def s06(v: Views):
    df = v.fundamentals.withColumn("pe_ratio", F.lit(None).cast("double"))
    return _upserted(df, "report_date", up.FUNDAMENTALS, _FUND_CHANGE, _SPLIT)


_INDEX = """, idx AS (SELECT 'KSE100' AS index_name, date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close,
              CAST(sum(volume) AS BIGINT) AS volume, true AS is_synthetic_index FROM bars GROUP BY date)"""


@case("s09_upsert_index", with_views(_INDEX + _upsert_sql("idx", "date", up.MARKET_INDEX, [], {"close": "close + 1"}, _SPLIT), "bars"))
def s09(v: Views):
    from barloom.operators.context import market_index

    return _upserted(market_index(v.bars), "date", up.MARKET_INDEX, {"close": "close + 1"}, _SPLIT)


@case("s23_upsert_twice", with_views(_upsert_sql("bars", "date", up.BARS, [], {"close": "close * 2"}, _SPLIT), "bars"))
def s23(v: Views):
    """A stored table partitioned by month, the same batch applied twice; only its months are rewritten."""
    path = fresh_path(v.spark, "stored-bars")
    bars = v.bars
    up.upsert_table(v.spark, path, bars.filter("date < date'1997-01-01'"), up.BARS)
    batch = bars.filter("date >= date'1996-01-01'").withColumn("close", F.col("close") * 2)
    for _ in range(2):
        up.upsert_table(v.spark, path, batch, up.BARS)
    return up.read_table(v.spark, path)


# ------------------------------------------------------------ assembled tables


@case(
    "s18_macro_assembly",
    with_views(
        """SELECT date, pkr_usd_rate, brent_oil_price, sp500_close, nasdaq_close, dxy_close, us10y_yield, 22.0::DOUBLE AS sbp_policy_rate,
           is_synthetic_rate FROM macro""",
        "macro",
    ),
)
def s18(v: Views):
    return assemble.macro_table(v.macro_long)


def _series(priority: str, name: str) -> str:
    return f"(SELECT date, avg(px) AS {name} FROM ord WHERE priority = '{priority}' GROUP BY date)"


@case(
    "j09_full_outer_join",
    with_views(
        f"""SELECT date, pkr_usd_rate, brent_oil_price, sp500_close FROM {_series('1-URGENT', 'pkr_usd_rate')}
            FULL JOIN {_series('2-HIGH', 'brent_oil_price')} USING (date) FULL JOIN {_series('3-MEDIUM', 'sp500_close')} USING (date)""",
        "ord",
    ),
)
def j09(v: Views):
    """Full outer join of several series on the date, as one pivot with a single shuffle."""
    wanted = ["pkr_usd_rate", "brent_oil_price", "sp500_close"]
    df = assemble.macro_table(v.macro_long.filter(F.col("series").isin(wanted)))
    return df.select("date", *wanted)


_QUARTERS = """
, qtr AS (SELECT ticker, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date,
                 count(*) AS n, sum(px) AS s, max(px) AS hi, min(px) AS lo FROM ord GROUP BY 1, 2),
items AS (SELECT ticker, report_date,
  CASE WHEN n % 3 = 0 THEN hi / 1e6 END AS basic_eps, CASE WHEN n % 3 = 1 THEN lo / 1e6 END AS diluted_eps,
  CASE WHEN n % 7 <> 0 THEN s END AS income, CASE WHEN n % 2 = 0 THEN s * 0.9 WHEN n % 5 = 0 THEN 0e0 END AS income_common,
  CASE WHEN n % 4 <> 1 THEN n * 1e5 ELSE 0e0 END AS average_shares, CASE WHEN n % 5 <> 0 THEN n * 1.1e5 ELSE 0e0 END AS ordinary_shares,
  CASE WHEN n % 3 <> 2 THEN hi * 2 - 3e7 END AS equity, hi AS common_equity, CASE WHEN n % 6 <> 0 THEN lo END AS debt FROM qtr)"""
_INFO = """, info AS (SELECT ticker, CAST(length(company_name) AS DOUBLE) AS eps, 12.5::DOUBLE AS pe_ratio, NULL::DOUBLE AS roe, 0.5::DOUBLE AS debt_to_equity,
             NULL::DOUBLE AS book_value_per_share FROM meta)"""


def statements(v: Views) -> DataFrame:
    """Long statement items with gaps and zeros, so that every fallback is taken somewhere."""
    quarter_end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("report_date")
    q = v.orders_of_tickers.groupBy("ticker", quarter_end).agg(
        F.count("*").alias("n"), F.sum("px").alias("s"), F.max("px").alias("hi"), F.min("px").alias("lo")
    )
    n = F.col("n")
    items = {
        "Basic EPS": F.when(n % 3 == 0, F.col("hi") / 1e6),
        "Diluted EPS": F.when(n % 3 == 1, F.col("lo") / 1e6),
        "Net Income": F.when(n % 7 != 0, F.col("s")),
        "Net Income Common Stockholders": F.when(n % 2 == 0, F.col("s") * 0.9).when(n % 5 == 0, 0.0),
        "Basic Average Shares": F.when(n % 4 != 1, n * 1e5).otherwise(0.0),
        "Ordinary Shares Number": F.when(n % 5 != 0, n * 1.1e5).otherwise(0.0),
        "Stockholders Equity": F.when(n % 3 != 2, F.col("hi") * 2 - 3e7),
        "Common Stock Equity": F.col("hi"),
        "Total Debt": F.when(n % 6 != 0, F.col("lo")),
    }
    arms = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), x.alias("value")) for k, x in items.items()]))
    return q.select("ticker", "report_date", arms.alias("i")).select("ticker", "report_date", "i.field", "i.value").filter(
        "value is not null"
    )


@case(
    "s17_fundamentals_derivation",
    with_views(
        _QUARTERS
        + _INFO
        + """, d AS (SELECT ticker, report_date, coalesce(basic_eps, diluted_eps, CASE WHEN sh1 > 0 THEN income / sh1 END) AS eps,
               NULL::DOUBLE AS pe_ratio, CASE WHEN eq > 0 THEN ni / eq END AS roe, CASE WHEN eq > 0 THEN debt / eq END AS debt_to_equity,
               CASE WHEN sh2 > 0 THEN eq / sh2 END AS book_value_per_share
             FROM (SELECT *, coalesce(nullif(average_shares, 0), ordinary_shares) AS sh1, coalesce(nullif(ordinary_shares, 0), average_shares) AS sh2,
                          coalesce(nullif(equity, 0), common_equity) AS eq, coalesce(nullif(income_common, 0), income) AS ni FROM items)),
             e AS (SELECT *, report_date = max(report_date) OVER (PARTITION BY ticker) AS newest FROM d),
             r AS (SELECT e.ticker, report_date, coalesce(e.eps, CASE WHEN newest THEN i.eps END) AS eps,
                          CASE WHEN newest THEN i.pe_ratio END AS pe_ratio, e.roe,
                          coalesce(e.debt_to_equity, CASE WHEN newest THEN i.debt_to_equity END) AS debt_to_equity, e.book_value_per_share
                   FROM e LEFT JOIN info i USING (ticker))
             SELECT * FROM r WHERE coalesce(eps, pe_ratio, roe, debt_to_equity, book_value_per_share) IS NOT NULL""",
        "ord",
        "meta",
    ),
)
def s17(v: Views):
    info = v.meta.select(
        "ticker",
        F.length("company_name").cast("double").alias("eps"),
        F.lit(12.5).alias("pe_ratio"),
        F.lit(None).cast("double").alias("roe"),
        F.lit(0.5).alias("debt_to_equity"),
        F.lit(None).cast("double").alias("book_value_per_share"),
    )
    return assemble.derive_fundamentals(statements(v), info)


@case(
    "u02_report_dates",
    with_views(
        _QUARTERS
        + """SELECT ticker, report_date FROM items WHERE income IS NOT NULL UNION SELECT ticker, report_date FROM items WHERE debt IS NOT NULL""",
        "ord",
    ),
)
def u02(v: Views):
    """Periods of two statements; the union is one aggregation."""
    s = statements(v)
    income = s.filter("field = 'Net Income'").select("ticker", "report_date")
    balance = s.filter("field = 'Total Debt'").select("ticker", "report_date")
    return income.union(balance).distinct()


@case("c18_synthetic_flags", with_views("SELECT is_synthetic_rate, count(*) AS n FROM macro GROUP BY 1", "macro"))
def c18(v: Views):
    return assemble.macro_table(v.macro_long).groupBy("is_synthetic_rate").agg(F.count("*").alias("n"))


# ------------------------------------------------------------ files and columns

_SMA50 = f"close / ({full('avg', 'close', 50)}) - 1"


@case(
    "s11_feature_dataset",
    with_views(
        f"SELECT * FROM (SELECT ticker, date, round({_SMA50}, 6) AS sma_50_dist FROM bars) WHERE ticker IN ('S3', 'S5') AND sma_50_dist IS NOT NULL",
        "bars",
    ),
)
def s11(v: Views):
    path = fresh_path(v.spark, "features")
    df = sma_distance(v.bars, (50,)).dropna("any", subset=["sma_50_dist"])
    fb.write_features(df.select("ticker", "date", F.round("sma_50_dist", 6).alias("sma_50_dist")), path)
    both = [fb.read_features(v.spark, path, t) for t in ("S3", "S5")]
    return both[0].unionByName(both[1])


@case(
    "s13_constituents_csv",
    with_views(
        """SELECT ticker, company_name || ', "' || sector || '"' AS company_name, sector, '2024-05-01' AS fetched_at FROM meta""", "meta"
    ),
)
def s13(v: Views):
    """Constituents through a CSV file with header, quotes and commas inside of values."""
    path = fresh_path(v.spark, "constituents")
    rows = v.meta.select(
        "ticker", F.concat("company_name", F.lit(', "'), "sector", F.lit('"')).alias("company_name"), "sector",
        F.lit("2024-05-01").alias("fetched_at"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return assemble.read_constituents(v.spark, path)


@case("f04_feature_selection", with_views("SELECT ticker, high, low, open, volume FROM bars", "bars"))
def f04(v: Views):
    return fb.select_features(v.bars).select("ticker", "high", "low", "open", "volume")


@case(
    "x02_row_function",
    with_views("SELECT ticker, date, greatest(open, close) - least(open, close) AS body FROM bars", "bars"),
)
def x02(v: Views):
    """A function of several columns of a row, as a native expression."""
    return v.bars.select("ticker", "date", (F.greatest("open", "close") - F.least("open", "close")).alias("body"))


# ----------------------------------------------------------------------- pages

# Listing, quote and profile pages restate the links and paragraphs of the given pages.
_LI, _LI_ALL = '<li><a href="/([^"]*)">([^<]*)</a></li>', "g"


def _listing_row(group: str) -> str:
    return f"<tr><td>PSX:&nbsp;{group}1</td><td>2020</td><td><b>{group}2</b> &amp; Co</td><td> Cement </td></tr>"


_HEAD = '<table class="wikitable sortable"><tr><th>Ticker</th><th>Year</th><th>Company</th><th>Sector</th></tr>'


@case(
    "s14_constituents_from_pages",
    f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{_LI}', 1) AS a, regexp_extract_all(html, '{_LI}', 2) AS b FROM pages)
    SELECT page_id, CAST(i AS INTEGER) AS row, trim(a[i]) AS ticker, trim(b[i]) || ' & Co' AS company_name, 'Cement' AS sector
    FROM (SELECT page_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM l)""",
)
def s14(v: Views):
    listing = F.regexp_replace("html", _LI, _listing_row("$"))
    listing = F.regexp_replace(listing, "<ul>", _HEAD)
    listing = F.regexp_replace(listing, "</ul>", "<tr><td>short row</td></tr></table>")
    pages = v.table("pages").select("page_id", listing.alias("html"))
    return html.constituents(pages)


def quote_pages(v: Views) -> DataFrame:
    x = F.round(F.col("value") * 1000) / 100
    return v.table("events").select(
        F.col("event_id").alias("page_id"),
        F.concat(
            F.lit('<div class="quote__price"><div class="quote__close">Rs.'), F.format_number(x, 2),
            F.lit('</div><div class="change__value up">'), F.format_number(-x, 2),
            F.when(F.col("event_id") % 10 == 0, "</div>").otherwise(F.concat(F.lit('</div><div class="change__percent"> ('), F.format_number(x, 2), F.lit("%)</div>"))),
            F.lit("</div>"),
        ).alias("html"),
    )


@case(
    "s15_quote_fields",
    """SELECT event_id AS page_id, round(x, 2) AS price, round(-x, 2) AS change,
       CASE WHEN event_id % 10 = 0 THEN 0 ELSE round(x, 2) END AS change_percent FROM (SELECT *, round(value * 1000) / 100 AS x FROM events)""",
)
def s15(v: Views):
    return html.quotes(quote_pages(v))


@case(
    "c17_number_cleanup",
    """SELECT event_id, round(round(value * 1000) / 100, 2) AS price FROM events""",
)
def c17(v: Views):
    x = F.round(F.col("value") * 1000) / 100
    return v.table("events").select("event_id", tx.number(F.concat(F.lit(" Rs. "), F.format_number(x, 2), F.lit(" (%)"))).alias("price"))


@case(
    "s16_profile_fields",
    f"""SELECT 'P' || page_id AS ticker, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)).replace('&amp;', '&') AS name,
        CASE WHEN page_id % 3 = 0 THEN 'Unknown Sector' ELSE regexp_extract(html, '<html lang="([a-z]*)"', 1) END AS sector,
        len(regexp_extract_all(html, '{_LI}', 1)) AS people, trim(regexp_extract(html, '{_LI}', 2)) AS first_role,
        regexp_extract(url, '^([a-z]*)', 1) AS web FROM pages""",
)
def s16(v: Views):
    page = F.col("html")
    lang = F.regexp_extract(page, '<html lang="([a-z]*)"', 1)
    sector = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit('<div class="quote__sector"><span>'), lang, F.lit("</span></div>")))
    people = F.array_join(F.regexp_extract_all(page, F.lit(_LI), 0), "")
    people = F.regexp_replace(people, _LI, "<tr><td>$1</td><td><i>$2</i></td></tr>")
    scheme = F.regexp_extract("url", "^([a-z]*)", 1)
    built = F.concat(
        F.lit('<div class="quote__name">'), F.regexp_extract(page, "<title>([^<]*)</title>", 1), F.lit("</div>"), sector,
        F.lit('<div class="profile__item profile__item--people"><table>'), people, F.lit("<tr><td>alone</td></tr></table></div>"),
        F.lit('<div class="profile__item"><div class="item__head">WEBSITE</div><p>'), scheme, F.lit("</p></div>"),
    )
    pages = v.table("pages").select(F.concat(F.lit("P"), F.col("page_id")).alias("ticker"), built.alias("html"))
    df = html.profiles(pages)
    return df.select(
        "ticker",
        "name",
        "sector",
        F.size("people").cast("long").alias("people"),
        F.col("people")[0]["role"].alias("first_role"),
        F.col("details")["WEBSITE"].alias("web"),
    )
