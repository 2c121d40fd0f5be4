"""Reply order from quotes."""

from barloom.llm.quotes import levels, normal, own_text

A = "The plan is ready.\nPlease have a look at it.\n\nWe start on Monday."
ROWS = [
    (1, 0, "user", A),
    (1, 1, "assistant", "> We start on Monday.\n\nMonday is too early."),
    (1, 2, "user", "An own topic."),
    (1, 3, "user", "On Tuesday X wrote:\n> > We start on\n> > Monday.\n>\n> Monday is too early.\n\nThen Tuesday."),
    (1, 4, "assistant", "> The plan is  READY.\n> Please have a look\n> at it.\nI did."),
    (1, 5, "assistant", "> nobody said this\nNo link."),
    (2, 0, "user", "> We start on Monday.\nAnother conversation."),
    (None, 0, "user", "alone"),
    (3, None, None, None),
    (3, 1, "user", ""),
    (3, 1, "user", "> only a quote"),
    (3, 1, "user", ""),
]
SCHEMA = "conv_id long, turn long, role string, text string, path string, row int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_levels_and_own_text():
    found = levels("hi\n>a\n> > b\n  >>c\nJo wrote:\n> d\n>= e")
    assert [k for k, _ in found] == [0, 1, 2, 2, 1, 1, 1]
    assert own_text(levels("a\n> b\n\n\n\nc")) == "a\n\nc" and normal(" A\n b ") == "a b"


def test_replies_stand_under_what_they_quote(spark):
    from barloom.llm.quotes import reply_order

    got = reply_order(table(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["turn"] for r in one] == [0, 1, 3, 4, 2, 5]
    assert {r["turn"]: (r["reply_to"], r["depth"]) for r in one} == {0: (None, 0), 1: (0, 1), 2: (None, 0), 3: (1, 2), 4: (0, 1), 5: (None, 0)}
    assert {r["turn"]: r["text"] for r in one}[3].strip() == "Then Tuesday."
    assert next(r for r in got if r["conv_id"] == 2)["reply_to"] is None
    three = sorted((r for r in got if r["conv_id"] == 3), key=lambda r: r["position"])
    assert [r["text"] for r in three][0] is None and [r["text"] for r in three].count("") == 3
    assert one[0]["rendered"] == f"<|user|>\n{A}\n"


def test_long_chain_and_empty_table(spark):
    from barloom.llm.quotes import reply_order

    chain = [(9, 0, "user", "word 0")] + [(9, i, "user", f"> word {i - 1}\nword {i}") for i in range(1, 40)]
    got = sorted(reply_order(table(spark, chain)).collect(), key=lambda r: r["turn"])
    assert [r["depth"] for r in got] == list(range(40)) and [r["position"] for r in got] == list(range(40))
    assert reply_order(table(spark, [])).count() == 0


def test_without_quotes_turn_order_and_texts_stay(spark):
    from barloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    given = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    rows = QUERIES["op10_quotes"](spark, folder).collect()
    assert {(r["conv_id"], r["turn"]): r["text"] for r in rows} == given
    assert all(r["position"] == r["turn"] for r in rows)
