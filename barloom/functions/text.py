"""Text and URL expressions of the news pipeline. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the reader (fixed values).
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")

#: News from this UTC hour on belongs to the next trading day.
CUTOFF_HOUR_UTC = 11

# A word is a run of letters, digits and underscores of any script; combining marks end it.
_W = r"[\p{L}\p{N}_]"
WORD = _W + "+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, also inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def _form_decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _form_encoded(text: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized_url(url: Column | str) -> Column:
    """Drop tracking and blank parameters; repeated keys are gathered at their first place."""
    u = col(url)
    base = F.regexp_extract(u, r"^([^?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    base = F.concat(F.lower(scheme), F.substring(base, F.length(scheme) + F.lit(1), F.length(base)))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(u, r"^[^#]*#(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]*=."))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            _form_decoded(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"),
            _form_decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING_PARAMETERS))

    def gathered(known: Column) -> Column:
        keys = F.array_distinct(F.transform(known, lambda p: p["k"]))
        return F.flatten(F.transform(keys, lambda k: F.filter(known, lambda p: p["k"] == k)))

    encoded = F.transform(
        let(pairs, gathered), lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))
    )
    text = F.array_join(encoded, "&")
    return F.concat(
        base,
        F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def headline_hash(headline: Column | str) -> Column:
    return F.md5(F.regexp_replace(F.lower(col(headline)), r"[^\p{L}\p{N}]", ""))


def trading_date(published_at: Column | str) -> Column:
    """The calendar day of the trading session that news of this moment counts for."""
    ts = col(published_at)
    return F.date_add(ts.cast("date"), F.when(F.hour(ts) >= CUTOFF_HOUR_UTC, 1).otherwise(0))


def searched_text(*parts: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def first_word(term: Column) -> Column:
    return F.regexp_extract(F.lower(term), WORD, 0)


def whole_term(term: Column) -> Column:
    """Pattern of a literal term between word boundaries."""
    t = F.lower(term)
    left = F.when(t.rlike("^" + _W), rf"(?<!{_W})").otherwise(rf"(?<={_W})")
    right = F.when(t.rlike(_W + "$"), rf"(?!{_W})").otherwise(rf"(?={_W})")
    return F.concat(left, F.regexp_replace(t, r"([^\w\s])", r"\\$1"), right)


def compound(total: Column) -> Column:
    """Squash a sum of word valences into (-1, 1)."""
    return total / F.sqrt(total * total + 15)


def sentiment_label(score: Column | str) -> Column:
    s = col(score)
    return F.when(s > 0.05, "Bullish").when(s < -0.05, "Bearish").otherwise("Neutral")


def number(text: Column | str) -> Column:
    """A quoted amount to a double: currency mark, thousands commas, brackets and percent removed."""
    bare = F.regexp_replace(col(text), r"Rs\.|[,()%]", "")
    return F.trim(bare).try_cast("double")


def bare_symbol(text: Column | str, prefix: str = "PSX:") -> Column:
    """A listing symbol without exchange prefix and non-breaking spaces."""
    return F.trim(F.replace(F.replace(col(text), F.lit(prefix), F.lit("")), F.lit("\u00a0"), F.lit("")))
