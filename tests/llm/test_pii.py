"""Personal data against a plain Python version of the rules."""

import hashlib
import random
import re

from pyspark.sql import functions as F

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_rules_equal_plain_python(spark):
    from barloom.llm.pii import find_personal_data, written

    rng = random.Random(5)
    alphabet = ["1", "23", "4111111111111111", "255", ".", "-", " ", "@", "a", "b.c", "+", "+1 (555) 010-9999", "é", "😀", "_", "\n", "(", ")", "0"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(800)]
    texts += [None, "", "a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "0255.1.1.001 256.1.1.1 00000000000000000255.1.1.1", "1" * 8_000 + ".1"]
    texts += ["x" * 8_000, "a." * 4_000 + "@", "1 " * 40_000, ("4111 1111 1111 1111, x@y.zz +1 (555) 010-9999 " * 300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[3], "y", 2)], "doc_id long, text string, base string, spans int")
    got = find_personal_data(docs).select("doc_id", written(F.col("base")).alias("base")).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r["base"] == plain_spans(texts[3 if r["doc_id"] is None else r["doc_id"]])


def test_contexts_find_what_the_rules_miss(spark):
    from barloom.llm.pii import find_personal_data, written

    good = ["4539578763621486", "4485275742308327", "4716461583322103", "4929420371563110", "4024007109022143"]
    texts = [f"pay with card no: {c} now" for c in good] + ["my card no: 1234567890123456 is lost", "page no. 1234567890123456 of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in find_personal_data(docs).select("doc_id", written(F.col("spans"))).collect()}
    assert got[5] == "card:12:28"
    assert got[6] == ""
    assert all(got[i] == "card:18:34" for i in range(5))


def test_contexts_reach_over_instances_and_blanks(spark):
    from barloom.llm.pii import INSTANCE, matches

    text = "call me  +1 (555) 010-9999 or 4111 1111 1111 1111,\n x5 now 7é"
    df = spark.createDataFrame([(text,), ("a " * 600 + "9",), ("",), ("12 " * 700,)], "text string")
    got = [r[0] for r in df.select(matches(F.col("text"), INSTANCE, context=True)).collect()]
    found = [(text[m["start"] : m["end"]], m["body"], m["before"]) for m in got[0]]
    assert [f[1:] for f in found] == [
        ("+1 (555) 010-9999", "call me"),
        ("4111 1111 1111 1111", "+1(555)010-9999 or"),
        ("x5", "or 4111111111111111,"),
        ("7é", "x5 now"),
    ]
    assert all(at == body for at, body, _ in found)
    assert [m["before"] for m in got[1]] == ["a a"] and got[2] == []
    assert len(got[3]) == 700 and [m["before"] for m in got[3]][:3] == ["", "12", "12 12"]


def test_held_out_identifiers_behind_learned_contexts(spark):
    """Identifiers that no rule finds, behind contexts that seeds share, against look-alikes elsewhere."""
    from barloom.llm.pii import find_personal_data

    rng = random.Random(11)
    words = "the of and rivers hold many stones under old bridges near quiet towns".split()
    filler = lambda k: " ".join(rng.choices(words, k=k))
    key = lambda letters, k: "".join(rng.choices(letters, k=k))
    contexts = ['auth token = "{}"', "api secret: {}", "my access key {}"]
    seeds = [filler(9) + " " + rng.choice(contexts).format(key("0123456789abcdef", 40)) + " " + filler(9) for _ in range(120)]
    other = "ghijklmnopqrstuvwxyz0123456789"
    planted = [filler(9) + " " + rng.choice(contexts).format(key(other, 36)) + " " + filler(9) for _ in range(200)]
    harmless = [filler(9) + " " + rng.choice(["order ref {}", "build of {}", 'file name = "{}"']).format(key(other, 36)) + " " + filler(9) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(seeds + planted + harmless)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in find_personal_data(docs).collect()}
    hit = lambda r: any(s["kind"] == 4 for s in r["spans"])
    assert not any(len(got[i]["base"]) for i in range(120, 320))
    right = sum(hit(got[i]) for i in range(120, 320))
    wrong = sum(hit(got[i]) for i in range(320, 520))
    assert right >= 0.9 * 200 and right >= 0.9 * (right + wrong)


def test_empty_table(spark):
    from barloom.llm.pii import find_personal_data

    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digests(spark):
    from barloom.llm.queries import QUERIES

    rows = QUERIES["op5_personal_data"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_card"] == want.count("card:") and set(want.split(",")) <= set(r["spans"].split(","))
