"""Near copies of the pipeline's stage against all pairs."""

import random

import numpy as np
import pytest
from plain import near_pairs, sets
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def groups_of(spark, texts, **options):
    from barloom.llm.nearcopies import near_copy_groups

    df = spark.createDataFrame(list(texts.items()), "key long, text string")
    return {r["key"]: r["component"] for r in near_copy_groups(df, **options).collect()}


def test_recall_and_precision_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, want = groups_of(spark, texts), near_pairs(texts)
    assert len(want) >= 10
    assert sum(got[a] == got[b] for a, b in want) >= 0.95 * len(want)
    # No group without links: every member but the smallest has a near or equal text in its group.
    near = {}
    for a, b in want:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    known = sets(texts)
    for k, c in got.items():
        if k != c:
            assert any(got[o] == c for o in near.get(k, ())) or any(known[o] == known[k] for o, g in got.items() if g == c and o != k)


@pytest.mark.parametrize("edits, goes", [(1, True), (3, True), (5, True), (12, False)])
def test_copies_with_changed_words(spark, edits, goes):
    rng = random.Random(edits)
    texts = {}
    for i in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        copy = list(words)
        for at in rng.sample(range(5, 295), edits):
            copy[at] = f"new{rng.randint(0, 10**6)}"
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(copy)}
    got = groups_of(spark, texts)
    share = np.mean([got[2 * i + 1] == 2 * i for i in range(60)])
    assert share >= 0.95 if goes else share == 0


def test_a_large_group_of_near_copies_in_small_blocks(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 300):
        copy = list(base)
        copy[rng.randrange(5, 195)] = f"x{i}"
        texts[i] = " ".join(copy)
    texts |= {1000 + i: " ".join(f"y{rng.randint(0, 5000)}" for _ in range(100)) for i in range(100)}
    got = groups_of(spark, texts, block=16, crowd=200)
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(100))


def test_a_link_between_dense_groups_is_found(spark):
    """Every member's nearest candidates are in its own group; the only link between both is the pair of unchanged texts."""
    rng = random.Random(5)
    one = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    two = [*one[:268], *(f"v{rng.randint(0, 10**6)}" for _ in range(32))]
    texts = {0: " ".join(one), 100: " ".join(two)}
    for i in range(1, 40):
        for at, base in ((0, one), (100, two)):
            copy = list(base)
            copy[20 + 5 * i] = f"x{at + i}"
            texts[at + i] = " ".join(copy)
    links = [p for p in near_pairs(texts) if (p[0] < 100) != (p[1] < 100)]
    assert [tuple(sorted(p)) for p in links] == [(0, 100)]
    assert set(groups_of(spark, texts, recall=0.9999).values()) == {0}


def test_members_of_all_blocks_of_a_crowded_cell_meet(spark):
    rng = random.Random(7)
    texts = {}
    for i in range(100):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        copy = list(words)
        copy[100] = "new"
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(copy)}
    got = groups_of(spark, texts, block=2, crowd=200, recall=0.9999)
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(100))


def test_odd_rows(spark):
    from barloom.llm.nearcopies import drop_near_copies

    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, row string, nid int"
    text = "one two three four five six seven"
    rows = [(None, text), (4, text), (4, text), (5, text.upper()), (6, None), (7, ""), (8, " \n"), (9, "a b"), (10, "word " * 50_000), (11, "word word word word word")]
    df = spark.createDataFrame([(*r, "en", "s", 1, 2, "r", 3) for r in rows], schema)
    got = drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [4, 6, 9, 10]
    assert drop_near_copies(df.filter(F.lit(False))).count() == 0


def test_cells_of_all_tables_are_never_broadcast(spark):
    """A node is a row per table and block there, while Spark sizes these rows by those of the nodes' small file."""
    from barloom.llm.nearcopies import Cells, _candidates, _links_between, _placed
    from barloom.session import settle

    rows = [(i, bytes([i % 7]) * 16, 5, i % 5) for i in range(60)]
    nodes = settle(spark.createDataFrame(rows, "nid long, fp binary, size int, root long"), "nodes")
    cells = Cells(60, 0.8, 0.99, 32, 3)
    open_cells = settle(_placed(nodes, cells).select("table", "cell").distinct(), "open")

    def sets_of(wanted):
        sets = spark.createDataFrame([(i, [i % 7, 100]) for i in range(60)], "nid long, shingles array<long>")
        return settle(wanted.distinct().join(sets, "nid"), "sets")

    for made in (_candidates(nodes, cells, 0.8, 16), _links_between(nodes, open_cells, sets_of, cells, 0.8, 16)):
        assert made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
