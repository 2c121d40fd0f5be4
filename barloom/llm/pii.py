"""Personal data by fixed rules, widened by bootstrapped context patterns; DataFrame functions only.

The rules find e-mail addresses, IP addresses, card and phone numbers. They seed a graph of lexical
patterns (the two words before an instance in the whole text, and its shape) and instances (rule matches
and other tokens). Long hexadecimal keys are a fifth seed: they are no spans by themselves, only behind a
trusted pattern. Scores flow from seeds to patterns and back for a few rounds; instances behind trusted
patterns are further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.session import settle

KINDS = ("email", "ip", "card", "phone")
#: Found by context alone, after the kinds of the rules.
ALL_KINDS = (*KINDS, "key")
_KEY = len(KINDS)
# The rules of the contract. Quantifiers are possessive wherever nothing could be given back, and a match
# starts at the head of a run or where the last match ended, so long runs cost linear time.
_WORDCHARS = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_WORDCHARS}]))[{_WORDCHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BLANK = r"\x20\x09-\x0D"
#: Words with a digit or an at sign: what the patterns can speak for.
TOKEN = rf"(?<![^{_BLANK}])[^{_BLANK}0-9@]*+[0-9@][^{_BLANK}]*+"
#: An instance: a phone or card number with its blanks as one, else a word. A card here need not pass its check digit.
INSTANCE = (
    rf"(?<![^{_BLANK}])\+[0-9][\x20().0-9-]+[0-9]"
    rf"|(?<![^{_BLANK}])(?<![0-9]\x20)[0-9](?:[\x20-]?[0-9]){{12,18}}+(?![\x20-]?[0-9])(?![A-Za-z_])|{TOKEN}"
)
#: What seeds keys: 32 or more hexadecimal digits, of both kinds.
KEY_SEED = r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])"


#: Matches placed at a time.
_BLOCK = 256


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def _last_two(text: Column) -> Column:
    words = F.filter(F.split(text, rf"[{_BLANK}]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Array of ``(start, end, body, before)`` of all matches, in code points.

    ``before`` is null, or with ``context`` the last two words of all the text before a match. They are carried from
    match to match, so a text is read once however many matches it has.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    kind = "struct<start:int,end:int,body:string,before:string>"
    empty = F.array().cast(f"array<{kind}>")
    no_tail = F.lit("" if context else None).cast("string")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gaps"])
        end = start + F.length(x["found"])

        def grown(before: Column) -> Column:
            one = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("body"), before.alias("before"))
            # A match is a word of its own, blanks inside it included.
            tail = F.concat(F.element_at(F.split(before, " "), -1), F.lit(" "), F.regexp_replace(x["found"], rf"[{_BLANK}]", "")) if context else no_tail
            return F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["all"], F.array(one)).alias("all"))

        return _bound(_last_two(F.concat(acc["tail"], x["gaps"])), grown) if context else grown(no_tail)

    def place(p: Column) -> Column:
        # Appending copies an array: blocks keep the work for texts with very many matches nearly linear.
        def block(acc: Column, b: Column) -> Column:
            pairs = F.arrays_zip(
                F.slice(p["gaps"], b * _BLOCK + 1, F.lit(_BLOCK)).alias("gaps"), F.slice(p["found"], b * _BLOCK + 1, F.lit(_BLOCK)).alias("found")
            )
            pairs = F.filter(pairs, lambda x: x["found"].isNotNull())
            inner = F.aggregate(pairs, F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("all")), add)
            return _bound(inner, lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(acc["all"], F.array(x["all"])).alias("all")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(p["found"]) - 1) / _BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), no_tail.alias("tail"), F.array().cast(f"array<array<{kind}>>").alias("all"))
        return F.when(F.size(p["found"]) == 0, empty).otherwise(
            F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["all"]))
        )

    return _bound(parts, place)


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(body, r"\."), part)
    if kind == "phone":
        return F.length(_digits(body)).between(9, 15)
    return _bound(_digits(body), lambda d: F.length(d).between(13, 19) & _luhn(d))


def _valid_spans(text: Column, kind: str, number: int) -> Column:
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["body"]))
    return F.transform(good, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of ``(kind, start, end)`` of the rules' valid matches, by kind as listed, then by start."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    found = []
    for k, kind in enumerate(KINDS):
        spans = _valid_spans(text, kind, k)
        needed = F.contains(text, F.lit(_NEEDS[kind])) if _NEEDS[kind] else F.lit(True)
        found.append(F.when(needed & text.rlike("[0-9@]"), spans).otherwise(none))
    return F.concat(*found)


def _shape(body: Column) -> Column:
    """Long runs that mix letters and digits as k, other digits as 9 and letters as a, each run kept once."""
    mixed = F.regexp_replace(body, r"(?=[0-9]*+\p{L})(?=\p{L}*+[0-9])[\p{L}0-9]{16,}+", "\u0001")
    letters = F.regexp_replace(F.regexp_replace(mixed, r"\p{L}+", "a"), "[0-9]", "9")
    return F.translate(F.regexp_replace(letters, "9{5,}", "9+"), "\u0001", "k")


def candidates(text: Column, base: Column) -> Column:
    """Array of ``(start, end, body, pattern, seed)``; seed is the kind of the rule match in the instance, or null.

    A pattern is the two words before the instance, whatever lies between, and its shape.
    """

    def describe(m: Column) -> Column:
        seeds = F.filter(base, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"]))
        key = F.when(m["body"].rlike(KEY_SEED), F.lit(_KEY))
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["body"].alias("body"),
            F.concat_ws("\t", F.lower(m["before"]), _shape(m["body"])).alias("pattern"),
            F.coalesce(F.get(seeds, 0)["kind"], key).alias("seed"),
        )

    none = F.array().cast("array<struct<start:int,end:int,body:string,pattern:string,seed:int>>")
    return F.when(text.rlike("[0-9@]"), F.transform(matches(text, INSTANCE, context=True), describe)).otherwise(none)


def trusted_patterns(
    tokens: DataFrame, rounds: int = 3, confidence: float = 0.6, support: int = 3, smoothing: float = 1.0
) -> DataFrame:
    """``(pattern, kind)`` of patterns trusted after ``rounds`` over the graph of ``(pattern, body, seed)`` rows.

    A pattern's score for a kind is the mean score of its distinct instances (smoothed by one unknown);
    an instance's is 1 for a seed, else its best pattern's. Only patterns with ``support`` distinct seeds
    pass anything on. Repeated tokens are one edge, so a frequent line cannot outvote others.
    """
    edges = settle(tokens.groupBy("pattern", F.xxhash64("body").alias("instance")).agg(F.min("seed").alias("seed")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    scores = edges.filter("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    seeds = settle(scores, "seeds")
    scores = seeds
    patterns = None
    for _ in range(rounds):
        sums = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind")
        sums = sums.agg(F.sum("score").alias("sum"), F.count(F.when(F.col("score") == 1, 1)).alias("seeds"))
        mean = F.col("sum") / (F.col("size") + smoothing)
        patterns = sums.join(sizes, "pattern").filter(F.col("seeds") >= support).select("pattern", "kind", mean.alias("score"))
        patterns = settle(patterns, "patterns")
        passed = edges.join(patterns, "pattern").groupBy("instance", "kind").agg(F.max("score").alias("score"))
        scores = seeds.union(passed.select("instance", "kind", "score")).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    best = F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")
    return patterns.filter(F.col("score") >= confidence).groupBy("pattern").agg(best)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, base, spans`` for every row: arrays of ``(kind, start, end)``, kind by number in ``KINDS``.

    ``base`` are the rules' matches, ``spans`` those and the instances behind trusted patterns that hold none; the
    kinds of ``spans`` are numbers in ``ALL_KINDS``.
    A null text is empty; rows equal in id and text come out alike, as often as they come; null ids are
    kept; an empty table gives no rows; other columns are ignored.
    """
    text = text_of(text_col)
    slim = docs.select(F.col(id_col), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    slim = slim.withColumn("base", base_spans(F.col("_text")))
    slim = slim.withColumn("_tokens", candidates(F.col("_text"), F.col("base"))).drop("_text")
    slim = settle(slim, "pii")
    tokens = slim.select(id_col, "_hash", F.explode("_tokens").alias("t")).select(id_col, "_hash", "t.*")
    trusted = trusted_patterns(tokens.select("pattern", "body", "seed"), **options)
    new = tokens.filter(F.col("seed").isNull() | (F.col("seed") == _KEY)).join(trusted, "pattern")
    span = F.struct("kind", "start", "end")
    extra = new.groupBy(id_col, "_hash").agg(F.collect_set(span).alias("_extra"))
    extra = extra.withColumnRenamed(id_col, "_id").withColumnRenamed("_hash", "_same")
    joined = slim.join(extra, slim[id_col].eqNullSafe(extra["_id"]) & (slim["_hash"] == extra["_same"]), "left")
    spans = F.when(F.col("_extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "_extra")))
    return joined.select(id_col, "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, ALL_KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
