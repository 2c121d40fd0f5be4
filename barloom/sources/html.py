"""Fields of listing, quote and profile pages, read with regular expressions inside the JVM.

Every operator maps one page to one or more rows and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.text import bare_symbol, let, number


def inner_text(html: Column) -> Column:
    """Text without tags, with the few entities of table cells resolved, trimmed of white space."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.regexp_replace(bare, r"^[\s\xA0]+|[\s\xA0]+$", "")


def by_class(html: Column, name: str) -> Column:
    """Inner text of the first element that carries the class, null when there is none."""
    pattern = rf'(?s)<(\w+)[^>]*class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</\1>'
    found = F.regexp_extract(html, pattern, 0)
    return F.when(found != "", inner_text(F.regexp_extract(html, pattern, 2)))


def constituents(pages: DataFrame, prefix: str = "PSX:") -> DataFrame:
    """Rows of the first listing table with the headings Ticker and Company that have four cells or more."""
    tables = F.regexp_extract_all(F.col("html"), F.lit(r'(?s)<table[^>]*class="[^"]*wikitable[^"]*"[^>]*>.*?</table>'), 0)

    def headings(t: Column) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(r"(?s)<th[^>]*>(.*?)</th>"), 1), inner_text)

    wanted = F.filter(
        tables, lambda t: F.array_contains(headings(t), "Ticker") & F.array_contains(headings(t), "Company")
    )
    rows = F.regexp_extract_all(F.try_element_at(wanted, F.lit(1)), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)
    body = pages.select("page_id", F.posexplode(rows).alias("row", "_tr")).filter("row > 0")
    cells = F.transform(F.regexp_extract_all("_tr", F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), inner_text)
    body = body.withColumn("_cells", cells).filter(F.size("_cells") >= 4)
    return body.select(
        "page_id",
        "row",
        bare_symbol(F.col("_cells")[0], prefix).alias("ticker"),
        F.col("_cells")[2].alias("company_name"),
        F.col("_cells")[3].alias("sector"),
    )


def quotes(pages: DataFrame) -> DataFrame:
    """Price, change and percent of quote pages; a field that is missing or unreadable is 0."""
    fields = {"price": "quote__close", "change": "change__value", "change_percent": "change__percent"}
    return pages.select(
        "page_id", *[F.coalesce(number(by_class(F.col("html"), cls)), F.lit(0.0)).alias(name) for name, cls in fields.items()]
    )


def profiles(pages: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Company profile: name, sector, description, people and further details, with defaults."""
    html = F.col("html")
    people_block = F.regexp_extract(html, r'(?s)<(\w+)[^>]*class="[^"]*profile__item--people[^"]*"[^>]*>(.*?)</\1>', 2)
    trs = F.regexp_extract_all(people_block, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(trs, lambda tr: F.regexp_extract_all(tr, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1))
    pairs = F.filter(cells, lambda c: F.size(c) == 2)
    people = F.transform(pairs, lambda c: F.struct(inner_text(c[0]).alias("name"), inner_text(c[1]).alias("role")))
    head = r'(?s)<div[^>]*class="[^"]*item__head[^"]*"[^>]*>(.*?)</div>\s*<p[^>]*>(.*?)</p>'
    keys = F.transform(F.regexp_extract_all(html, F.lit(head), 1), inner_text)
    values = F.transform(F.regexp_extract_all(html, F.lit(head), 2), inner_text)
    description = r'(?s)class="[^"]*profile__item--decription[^"]*"[^>]*>.*?<p[^>]*>(.*?)</p>'
    text = F.regexp_extract(html, description, 1)
    return pages.select(
        F.col(ticker).alias("ticker"),
        F.coalesce(by_class(html, "quote__name"), F.upper(ticker)).alias("name"),
        F.coalesce(by_class(html, "quote__sector"), F.lit("Unknown Sector")).alias("sector"),
        F.when(F.regexp_like(html, F.lit(description)), inner_text(text))
        .otherwise("No description available.")
        .alias("description"),
        people.alias("people"),
        F.map_from_entries(F.transform(_last_per_key(keys, values), lambda e: F.struct(e["k"], e["v"]))).alias("details"),
    )


def _last_per_key(keys: Column, values: Column) -> Column:
    """A repeated heading keeps its last value."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    pairs = F.transform(pairs, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i")))

    def last(known: Column) -> Column:
        return F.filter(known, lambda e: ~F.exists(known, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))

    return let(pairs, last)
