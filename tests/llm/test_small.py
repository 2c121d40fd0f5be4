"""Operators against plain versions, with nulls, ties, repeated rows, long texts and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from plain import components, drop_chunks, fingerprint
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def frame(spark, rows, extra="_key string, key int, row int, id int, hash string"):
    """Rows of (doc_id, text, lang, source) with columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], f"doc_id long, text string, lang string, source string, {extra}")


def odd_rows():
    rng = random.Random(11)
    words = ["stone", "RIVER", "é", "😀", "a", "winter", "|", "@"]
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))), "en", "s") for i in range(60)]
    rows += [(60 + i, rows[i][1] + "\ntail", "de", None) for i in range(10)]
    rows += [(70, None, None, None), (71, "", "en", "s"), (72, "word " * 50_000, "en", "s"), (73, "\n" * 3000, "fr", "s")]
    return rows + [(None, rows[3][1], None, "s"), rows[5], rows[5], (None, None, None, None)]


# line chunks


def test_chunks_equal_plain(spark, given):
    from barloom.llm.linechunks import drop_repeated_chunks

    rows = [r for r in odd_rows()[:74]]
    got = drop_repeated_chunks(frame(spark, rows))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    want = drop_chunks({r[0]: r[1] or "" for r in rows})
    assert {k: v or "" for k, v in texts.items()} == want and texts[70] is None
    assert got.columns == [*frame(spark, rows[:1]).columns, "_chunks", "_dropped"]


def test_chunks_of_repeated_rows_and_null_ids(spark):
    from barloom.llm.linechunks import drop_repeated_chunks

    got = drop_repeated_chunks(frame(spark, odd_rows()))
    assert got.count() == len(odd_rows())
    assert got.filter("doc_id = 5").select("text").distinct().count() == 1
    assert drop_repeated_chunks(frame(spark, [])).count() == 0


def test_chunk_boundaries_shift_with_insertions(spark):
    from barloom.llm.linechunks import drop_repeated_chunks

    body = [f"line {i} of the shared passage" for i in range(60)]
    rows = [(1, "\n".join(body), "en", "s"), (2, "\n".join(["new", *body[:30], "another", *body[30:]]), "en", "s")]
    left = {r["doc_id"]: r["text"] for r in drop_repeated_chunks(frame(spark, rows)).collect()}
    assert left[1] == rows[0][1] and len(left[2].split("\n")) < 20 and "another" in left[2]


def test_passages_go_whole_between_unlike_neighbours(spark):
    from barloom.llm.linechunks import drop_repeated_chunks

    rng = random.Random(3)
    line = lambda: " ".join(rng.choices("alpha beta gamma delta eps zeta eta theta iota".split(), k=12)) + f" {rng.random()}"
    rows, size, k = [], {}, 0
    for length in (2, 3, 4, 6, 10):
        for _ in range(100):
            passage = [line() for _ in range(length)]
            for _ in range(2):
                rows.append((k, "\n".join([line() for _ in range(rng.randint(1, 6))] + passage + [line() for _ in range(rng.randint(0, 6))]), "en", "s"))
                size[k] = length
                k += 1
    left = {r["doc_id"]: r["text"] for r in drop_repeated_chunks(frame(spark, rows)).collect()}
    whole = {n: sum(left[i].count("\n") == rows[i][1].count("\n") - n for i in range(1, k, 2) if size[i] == n) for n in (2, 3, 4, 6, 10)}
    assert all(left[i] == rows[i][1] for i in range(0, k, 2))
    assert min(whole.values()) >= 95, whole


def test_nested_passages_share_their_edges(spark):
    from barloom.llm.linechunks import drop_repeated_chunks

    body = [f"sentence {i} of a document that is copied" for i in range(24)]
    rows = [(1, "\n".join(body), "en", "s"), (2, "\n".join(body), "en", "s")]
    rows += [(3, "\n".join(["own start", *body[7:12], "own end"]), "en", "s")]
    left = {r["doc_id"]: r["text"] for r in drop_repeated_chunks(frame(spark, rows)).collect()}
    assert left == {1: rows[0][1], 2: "", 3: "own start\nown end"}


# SimHash


def test_simhash_equals_plain(spark, given):
    from barloom.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op2_simhash"](spark, FOLDER).collect()}
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == {k: fingerprint(t) for k, t in given.items()}
    assert {k: r["component_id"] for k, r in got.items()} == components(given)


def test_simhash_odd_rows(spark):
    from barloom.llm.simhash import drop_near_duplicates, simhash_groups

    rows = odd_rows()
    got = simhash_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = components({r[0]: r[1] for r in rows if r[0] is not None})
    assert all(r["component"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash_groups(frame(spark, [])).count() == 0
    kept = drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


@pytest.mark.parametrize("block", [3, 1024])
def test_no_link_within_four_bits_is_lost(spark, block):
    from barloom.llm.components import connected_components
    from barloom.llm.simhash import near_links

    rng = random.Random(block)
    centres = [rng.getrandbits(64) for _ in range(15)]
    prints = set(centres)
    for c in centres:
        for _ in range(12):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = connected_components(near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, block)).collect()
    label = {p: p for p in signed}
    for _ in signed:
        new = {a: min(label[b] for b in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4) for a in signed}
        if new == label:
            break
        label = new
    got = {r["node"]: r["component"] for r in found}
    assert {p: got.get(p, p) for p in signed} == label


def test_components_of_chains_and_stars(spark):
    from barloom.llm.components import connected_components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


# packing


def test_coder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from barloom.llm.packing import coder

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rng = random.Random(8)
    alphabet = ["'s", "'RE", "'", "a", "Bc", "ß", "ẞ", "İ", "Σ", "é", "é", "½", "²", "_", "%%", "7", "42", " ", "\n", "\x1c", "\x85", "\xa0", "€", "<|endoftext|>", "😀", "–", "ǅ", "ª", "´"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)] + [""]
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert coder(path)(texts) == want


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_and_swaps(seed):
    from barloom.llm.packing import Places, best_fit, swap_search

    rng = random.Random(seed)
    limit = rng.choice([10, 16, 20, 50])
    sizes = Counter(rng.randint(1, limit) for _ in range(rng.randint(1, 200)))
    free: list[int] = []
    for s in sorted(sizes.elements(), reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(limit - s)
    bins = best_fit(sizes, limit)
    assert bins.total() == len(free)
    better = swap_search(bins, limit)
    held = Counter()
    for b, n in better.items():
        assert 0 < sum(s * k for s, k in b) <= limit
        for s, k in b:
            held[s] += k * n
    assert held == sizes and better.total() <= bins.total()
    places, filled = Places(better), defaultdict(list)
    for s, n in sizes.items():
        for q, o in zip(*places.find(np.full(n, s), np.arange(n)), strict=True):
            filled[int(q)].append((int(o), s))
    assert len(filled) == better.total()
    for row in filled.values():
        at = 0
        for o, s in sorted(row):
            assert o == at
            at += s


def test_swaps_empty_a_bin():
    from barloom.llm.packing import swap_search

    # 10 = 6+4 = 5+5: best fit of another order left three bins that two can hold.
    assert swap_search(Counter({((6, 1), (3, 1)): 1, ((5, 1), (4, 1)): 1, ((2, 1),): 1}), 10).total() == 2


def test_pack_odd_rows(spark, given):
    import public_tokenizers
    from tokenizers import Tokenizer

    from barloom.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = odd_rows() + [(1000 + k, t, "en", "s") for k, t in given.items()]
    got = pack(frame(spark, rows), path, 64).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            want[doc_id, piece, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    total = sum(r["length"] for r in got)
    assert max(ends.values()) <= 64 and len(ends) <= 1.02 * -(-total // 64)
    assert pack(frame(spark, []), path, 64).count() == 0


# sharding


def test_shards(spark):
    from barloom.llm.sharding import shard_by_bytes

    rows = odd_rows()
    got = shard_by_bytes(frame(spark, rows), 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    even = [(i, "x" * 99, "en", "s") for i in range(800)]
    sizes = Counter()
    ids = defaultdict(list)
    for r in shard_by_bytes(frame(spark, even), 8).collect():
        sizes[r["shard"]] += r["size"]
        ids[r["shard"]].append((r["slot"], r["doc_id"]))
    assert set(sizes.values()) == {10_000}
    assert [d for s in range(8) for _, d in sorted(ids[s])] == list(range(800))
    assert shard_by_bytes(frame(spark, [])).count() == 0


# embeddings


def test_vectors_against_brute_force(spark):
    from barloom.llm.projections import near_vectors

    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 32))
    near = np.repeat(base, 6, axis=0) + rng.standard_normal((240, 32)) * 0.12
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate((base, near, base[:5], 3 * base[:5])))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 32, 1), (n + 3, [float("nan")] * 32, 1), (n + 4, [1.0] * 31 + [None], 1), (n + 5, [float("inf")] * 32, 1)]
    rows += [(n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.01], 1), (None, rows[0][1], 1)]
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows[: n]}
    for block in (8, 1024):
        got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int"), block=block).collect()}
        assert len(got) == len(rows)
        true = {a: sum(float(units[a] @ units[b]) >= 0.95 for b in units) - 1 for a in units}
        true[0] += 1
        extra = sum(float(units[0] @ units[b]) >= 0.95 for b in units)
        found, all_ = sum(r["n_links"] for k, r in got.items() if k is not None and k < n), sum(true.values()) + extra - 1
        assert 0.9 * all_ <= found <= all_
        assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(n, n + 6))
        assert got[n + 6]["n_links"] == got[n + 7]["n_links"] == 1 and got[n + 7]["component_id"] == n + 6
        assert got[None]["component_id"] == 0 and not got[None]["kept"]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_given_vectors(spark):
    from barloom.llm.projections import near_vectors

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    units = np.array([r["embedding"] for r in rows], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rng = np.random.default_rng(1)
    close = units[:300] + rng.standard_normal((300, units.shape[1])) * 0.03
    all_ = np.concatenate((units, close / np.linalg.norm(close, axis=1, keepdims=True)))
    want = (all_ @ all_.T >= 0.95).sum() - len(all_)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "vec_id long, embedding array<double>")
    found = near_vectors(table).agg(F.sum("n_links")).first()[0]
    assert 0.95 * want <= found <= want


# mixing


def test_rates_hold_the_marginals(spark):
    from barloom.llm.mixing import CELL, described, mixed, rake

    rows = [(i, "w " * (1 + i % 7) + (" | " if i % 5 == 0 else ""), ["en", "de", None][i % 3], ["a", "b"][(i // 3) % 2]) for i in range(400)]
    docs = described(frame(spark, rows))
    cells = docs.groupBy(*CELL).agg(F.sum("tokens").alias("tokens"))
    shares = {"source": {"a": 0.8, "b": 0.2}, "lang": 0.5, "topic": {"table": 0.3}}
    fitted = rake(cells, shares, rounds=25).collect()
    by = lambda i: {k: sum(r["fitted"] for r in fitted if r[i] == k) for k in {r[i] for r in fitted}}
    assert by("source") == pytest.approx({"a": 0.8, "b": 0.2}, abs=1e-6)
    assert by("topic") == pytest.approx({"table": 0.3, "prose": 0.7}, abs=1e-6)
    tokens = {k: sum(r["tokens"] for r in fitted if r["lang"] == k) for k in ("en", "de", None)}
    roots = {k: v**0.5 for k, v in tokens.items()}
    assert by("lang") == pytest.approx({k: v / sum(roots.values()) for k, v in roots.items()}, abs=1e-6)
    many = frame(spark, [(i, "one two three", "en", "ab"[i % 2]) for i in range(4000)])
    drawn = mixed(many, {"source": {"a": 0.75, "b": 0.25}}, fraction=0.5).collect()
    kept = Counter(r["source"] for r in drawn if r["kept"])
    assert kept["a"] == pytest.approx(1500, rel=0.1) and kept["b"] == pytest.approx(500, rel=0.15)


def test_drawn_shares_hold_the_marginals_above_rate_one(spark):
    from barloom.llm.mixing import mixed, repeated

    def row(i):
        return (i, "one two three" + (" | " if i % 10 == 0 else ""), "de" if i % 7 == 0 else "en", "b" if i % 12 == 0 else "a")

    shares = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"table": 0.3, "prose": 0.7}}
    found = mixed(frame(spark, [row(i) for i in range(12_000)]), shares, fraction=0.5).localCheckpoint()
    drawn, total = repeated(found), found.agg(F.sum("tokens")).first()[0]
    assert found.filter("weight * 0.5 > 1").count() > 0
    assert found.filter("kept <> (copies > 0)").count() == 0
    assert drawn.agg(F.sum("tokens")).first()[0] == pytest.approx(total * 0.5, rel=0.03)
    for margin, want in shares.items():
        sums = {r[0]: r[1] for r in drawn.groupBy(margin).agg(F.sum("tokens")).collect()}
        assert {k: v / sum(sums.values()) for k, v in sums.items()} == pytest.approx(want, abs=0.02)


def test_mixing_odd_rows(spark):
    from barloom.llm.mixing import mixed

    got = mixed(frame(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert len({(r["doc_id"], r["kept"]) for r in got if r["doc_id"] == 5}) == 1
    assert all(0 < r["probability"] <= 1 for r in got)
    assert mixed(frame(spark, [])).count() == 0


# queries next to their SQL


def test_queries_equal_their_sql(spark):
    from barloom.llm.queries import QUERIES, SQL
    from barloom.suite.compare import _rows, connect

    con = connect(FOLDER)
    for name, sql in SQL.items():
        df = QUERIES[name](spark, FOLDER)
        cur = con.execute(sql)
        assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in cur.description], cur.fetchall()), name


def test_copies_of_the_query_meet_the_shares(spark):
    """Drawn tokens of the query's own rows, by topic, against the target shares."""
    from barloom.llm.mixing import TOPIC_SHARES
    from barloom.llm.queries import QUERIES

    rows = QUERIES["op9_mixing"](spark, "/root/testdata/sf0.1").select("topic", "tokens", "copies", "kept").collect()
    drawn = Counter()
    for r in rows:
        drawn[r["topic"]] += r["tokens"] * r["copies"]
        assert r["kept"] == (r["copies"] > 0)
    total, wanted = sum(drawn.values()), sum(TOPIC_SHARES[t] for t in drawn)
    assert all(abs(n / total - TOPIC_SHARES[t] / wanted) < 0.01 for t, n in drawn.items())


def test_each_scaling_of_a_mix_is_settled_by_itself(spark, monkeypatch):
    """The plan of one round must not hold the sums of its earlier margins again."""
    from barloom.llm import mixing

    plans, settle = [], mixing.settle
    monkeypatch.setattr(mixing, "settle", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df, name))
    cells = spark.createDataFrame([("a", "en", "prose", 5), ("a", "de", "table", 3), ("b", "en", "prose", 2)], "source string, lang string, topic string, tokens long")
    mixing.rake(cells, {"source": 0.5, "lang": 0.5, "topic": 0.5}, rounds=2).collect()
    assert max(p.count("Aggregate") for p in plans[2:]) == 1
