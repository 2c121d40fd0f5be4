"""The views of ``barloom.sources.views`` once more, as SQL common table expressions."""

from __future__ import annotations

_BARS_OF = """
SELECT ticker, date,
       first(px ORDER BY l_orderkey, l_linenumber, px) AS open, max(px) AS high, min(px) AS low,
       last(px ORDER BY l_orderkey, l_linenumber, px) AS close, CAST(sum(q) AS BIGINT) AS volume
FROM {source} GROUP BY ticker, date"""

VIEWS = {
    "lines": """SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
       round(l_extendedprice * 100) AS px, l_quantity AS q FROM lineitem""",
    "bars": _BARS_OF.format(source="lines"),
    "lines_dense": """SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
       round(l_extendedprice * 100) AS px, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars_dense": _BARS_OF.format(source="lines_dense"),
    "meta": """SELECT 'S' || s_suppkey AS ticker, s_name AS company_name,
       CASE r_name WHEN 'AFRICA' THEN 'Oil & Gas Exploration' WHEN 'ASIA' THEN 'Power Generation & Distribution'
                   ELSE r_name END AS sector, s_acctbal > 0 AS is_active
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ord": """SELECT 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS ticker, CAST(o_orderdate AS DATE) AS date,
       o_orderpriority AS priority, o_orderstatus AS status, round(o_totalprice * 100) AS px FROM orders""",
    "macro": """SELECT date,
       avg(px) FILTER (priority = '1-URGENT') AS pkr_usd_rate, avg(px) FILTER (priority = '2-HIGH') AS brent_oil_price,
       avg(px) FILTER (priority = '3-MEDIUM') AS sp500_close, avg(px) FILTER (priority = '4-NOT SPECIFIED') AS nasdaq_close,
       avg(px) FILTER (priority = '5-LOW') AS dxy_close, avg(px) AS us10y_yield,
       CAST(20 + year(date) % 3 AS DOUBLE) AS sbp_policy_rate, true AS is_synthetic_rate FROM ord GROUP BY date""",
    "dividends": """SELECT ticker, date AS ex_dividend_date, max(px) / 1e6 AS dividend_amount, 'Cash' AS dividend_type
FROM ord WHERE priority = '1-URGENT' GROUP BY ticker, date""",
    "fundamentals": """SELECT ticker, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date,
       avg(px) / 1e7 - 1.0 AS eps, avg(px) FILTER (status = 'F') / 1e8 AS roe,
       count(*) / CAST(4 AS DOUBLE) AS debt_to_equity, max(px) / 1e5 AS book_value_per_share
FROM ord GROUP BY 1, 2""",
    "daily_sentiment": """SELECT ticker, date, (avg(px) - 25e6) / 25e6 AS sentiment_score, CAST(count(*) AS INTEGER) AS article_count
FROM ord WHERE priority IN ('4-NOT SPECIFIED', '5-LOW') GROUP BY ticker, date""",
    "sentiment_raw": """SELECT event_id, 'U' || user_id AS ticker, ts AS published_at, event_type AS headline,
       (round(value * 100) - 24500) / 24500 AS sentiment_score FROM events""",
    "articles": """SELECT d.doc_id AS article_id, split_part(d.text, chr(10), 1) AS headline, CASE WHEN contains(d.text, chr(10)) THEN substr(d.text, instr(d.text, chr(10)) + 1) END AS summary,
       d.text AS content, p.url, d.source, e.ts AS published_at
FROM documents d JOIN events e ON e.event_id = d.doc_id JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)""",
    "quotes": "SELECT event_id, event_type AS ticker, ts, value AS price FROM events",
    "returns": """SELECT *, close / lag(close) OVER w - 1 AS daily_return FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "predictions": """SELECT ticker, date, close, r0 * 0.5 AS rf_return, r1 * 0.25 AS lr_return, r0 * -0.1 AS xgb_return,
       (r0 + r1) / 8 AS lstm_return
FROM (SELECT ticker, date, close, coalesce(daily_return, 0) AS r0,
             coalesce(lag(daily_return) OVER (PARTITION BY ticker ORDER BY date), 0) AS r1 FROM returns)""",
}
NEEDS = {
    "bars": ["lines"],
    "bars_dense": ["lines_dense"],
    "macro": ["ord"],
    "dividends": ["ord"],
    "fundamentals": ["ord"],
    "daily_sentiment": ["ord"],
    "returns": ["bars"],
    "predictions": ["returns"],
}


def _closure(names) -> list[str]:
    done: list[str] = []

    def visit(name: str):
        for dep in NEEDS.get(name, []):
            visit(dep)
        if name not in done:
            done.append(name)

    for name in names:
        visit(name)
    return done


def with_views(query: str, *names: str, recursive: bool = False) -> str:
    """``WITH <views> <query>``; the query may add further common table expressions with ``, name AS``.

    A query that starts with ``,`` continues the list of expressions.
    """
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in _closure(names))
    sep = "" if query.lstrip().startswith(",") else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{sep}{query.strip()}"


#: Trailing frame of n rows, guarded like a rolling window: null until n values are present.
def full(agg: str, value: str, n: int, part: str = "PARTITION BY ticker ORDER BY date") -> str:
    over = f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) {over} = {n} THEN {agg}({value}) {over} END"
