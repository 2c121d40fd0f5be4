"""Secret scans: rules against a plain version, the network on held-out and planted findings."""

import random
import re

import numpy as np
import pytest

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    found = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return [(k, a, b) for a, k, b in sorted(found)]


def odd_texts():
    rng = random.Random(3)
    pieces = ["password", "Token", "ſecret", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdefgh", "x1", "AKIA", "AKIAABCDEFGH1234", "0f" * 16, "-", "é", "😀", "\n", "."]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "a" * 100_000, "token=token:abcdefghijk", "f" * 90_000, "A1" * 60_000, "token = " * 10_000, "passKword=abcdefgh12"]
    return texts


@pytest.fixture(scope="module")
def detector(spark):
    from barloom.llm import credentials as c
    from barloom.llm.common import table

    found = c.labelled_findings(c.read_texts(table(spark, FOLDER, "documents")))
    return c.fit_detector(*found), found


def test_rules_equal_plain(spark, detector):
    from barloom.llm.credentials import find_secrets

    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, base string, id int")
    for r in find_secrets(docs, detector[0]).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert base == plain(texts[r["doc_id"]])
        assert [s for s in spans if s[0] < 3] == base
        assert spans == sorted(spans, key=lambda s: (s[1], s[0]))
        new = [s for s in spans if s[0] == 3]
        assert all(b[2] <= a or b[1] >= e for _, a, e in new for b in base)


def test_held_out_findings(detector):
    """Keys and harmless tokens drawn anew: recall and precision of the fitted detector."""
    from barloom.llm.credentials import drawn_findings

    fitted, (found, _) = detector
    findings, labels = drawn_findings([(f[0], f[2]) for f in found], 1500, 12345)
    got = fitted.accepts(findings)
    assert got[labels == 1].mean() >= 0.97
    assert labels[got].mean() >= 0.95


def test_probabilities_are_calibrated(detector):
    from barloom.llm.credentials import drawn_findings

    fitted, (found, _) = detector
    findings, labels = drawn_findings([(f[0], f[2]) for f in found], 1500, 54321)
    p = fitted.probabilities(findings)
    assert abs(p.mean() - labels.mean()) < 0.03
    for low, high in ((0.0, 0.1), (0.9, 1.0)):
        these = (p >= low) & (p <= high)
        assert abs(p[these].mean() - labels[these].mean()) < 0.05


def test_planted_keys_without_a_rule_are_found_and_plain_texts_left_alone(spark, detector):
    from barloom.llm.credentials import find_secrets

    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    docs, want = [], {}
    base = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(100).collect()]
    for i in range(100):
        key = "".join(rng.choices(chars, k=rng.randint(28, 50)))
        text = f"{base[i][:300]} Authorization: Bearer {key} and more"
        want[i] = (text.index(key), text.index(key) + len(key))
        docs.append((i, text))
    docs += [(1000 + i, f"see report_{i}2024.pdf of the 2024-03-{i % 28 + 1:02d}T10 build, mail{i}.example.com or item-{i}00") for i in range(100)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3] for r in find_secrets(spark.createDataFrame(docs, "doc_id long, text string"), detector[0]).collect()}
    assert sum(want[i] in got[i] for i in want) >= 95
    assert sum(bool(got[i]) for i in got if i >= 1000) <= 3


def test_long_runs_are_read_whole(detector):
    """Scores in pieces equal scores at once, and the end of a long run counts."""
    network = detector[0].network
    run = ("see ", "ab1" * 2000, " x")
    assert np.allclose(network.scores([run], piece=64), network.scores([run], piece=1 << 20))
    other = ("see ", "ab1" * 2000 + "Zq9/T+w0", " x")
    assert abs(network.scores([run], piece=64)[0] - network.scores([other], piece=64)[0]) > 1e-6


def test_gradients_are_those_of_the_loss():
    from barloom.llm.credentials import Network

    findings = [("key ", "aB3dEf9h", " x"), ("", "version1", ""), ("é", "00ff00ff00", "..")]
    labels = np.array([1.0, 0.0, 1.0])
    network = Network(size=3, filters=4, dense=3, seed=2)

    def loss():
        z = network.scores(findings)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    found = network._gradients(findings, labels)
    rng = np.random.default_rng(0)
    for name, w in network.weights.items():
        for flat in rng.integers(0, w.size, 5):
            at, step = np.unravel_index(flat, w.shape), 1e-6
            kept = w[at]
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * step) - found[name][at]) < 1e-5, name


def test_no_findings_at_all_repeats_and_null_ids(spark):
    from barloom.llm.credentials import find_secrets

    schema = "doc_id long, text string"
    assert find_secrets(spark.createDataFrame([], schema)).count() == 0
    text = "secret = abcdefgh99 and x"
    got = find_secrets(spark.createDataFrame([(None, text), (1, text), (1, text), (None, None)], schema), fit_rows=40).collect()
    assert sorted(len(r["base"]) for r in got) == [0, 1, 1, 1]


def some_findings(spark, hits, others, long=0):
    from barloom.llm.credentials import read_texts

    rng = random.Random(5)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    docs = [f'lorem {i} ipsum token = "{key(40)}" dolor' for i in range(hits)] + [f"see item_{i}{i % 7}x.pdf of the list" for i in range(others)]
    docs += [f"a long run x{'Ab1' * 300}{i} ends" for i in range(long)]
    return read_texts(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))


def test_every_finding_has_its_label(spark):
    """No limit on how many findings of the texts there are, nor on their length."""
    from barloom.llm.credentials import labelled_findings

    findings, labels = labelled_findings(some_findings(spark, 60, 90, 3), rows=40)
    assert len(findings) == len(labels) == 60 + 90 + 3 + 20
    assert labels.sum() == 60 + 10 and sum(len(f[1]) > 512 for f in findings) == 3


def test_shares_hold_every_finding_and_their_network_finds_keys(spark):
    from barloom.llm import credentials as c

    read = some_findings(spark, 60, 700, 2)
    found = c.corpus_findings(read)
    rows = c.dealt_findings(found, {True: 3, False: 11}, 11).collect()
    assert {(r["before"], r["value"], r["after"]) for r in rows} == {(r["before"], r["value"], r["after"]) for r in found.collect()}
    assert {r["part"] for r in rows} == set(range(11))
    assert all(len({r["held"] for r in rows if r["value"] == v}) == 1 for v in {r["value"] for r in rows})
    fitted, again = (c.fitted_detector(read, rows=1200) for _ in range(2))
    assert fitted.thresholds == again.thresholds
    assert all(np.array_equal(w, again.network.weights[k]) for k, w in fitted.network.weights.items())
    findings, labels = c.drawn_findings([("see ", " and")], 500, 12345)
    got = fitted.accepts(findings)
    assert got[labels == 1].mean() >= 0.95 and labels[got].mean() >= 0.9


def test_gradients_in_pieces_equal_those_at_once():
    from barloom.llm.credentials import Network

    findings = [("key ", "aB3dEf9h", " x"), ("", "ab1" * 100 + "Zq9", " y"), ("é", "00ff00ff00", ".."), ("v", "x1" * 60, "")]
    labels, network = np.array([1.0, 0.0, 1.0, 0.0]), Network(seed=2)
    whole = network._gradients(findings, labels)
    for piece in (16, 50, 150):
        for name, g in network._gradients(findings, labels, piece).items():
            assert np.allclose(g, whole[name], atol=1e-12), (piece, name)


def test_weighted_thresholds_equal_repeated_findings():
    from barloom.llm.credentials import _calibrated, _threshold

    rng = np.random.default_rng(4)
    logit, labels, weight = rng.normal(size=200), (rng.random(200) < 0.5).astype(float), rng.integers(1, 6, 200)
    logit += 2 * labels
    many = [np.repeat(x, weight) for x in (logit, labels)]
    one = np.ones(weight.sum())
    assert np.allclose(_calibrated(logit, labels, weight.astype(float)), _calibrated(*many, one))
    p, q = (1 / (1 + np.exp(-x)) for x in (logit, many[0]))
    assert np.isclose(_threshold(p, labels, weight.astype(float), 0.9), _threshold(q, many[1], one, 0.9))
