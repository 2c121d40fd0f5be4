"""The distributed Kneser-Ney model and the base rules against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

BLANK = "\x20\t\n\x0b\x0c\r"


def discount(counts):
    n = Counter(counts)
    n1, n2, n3, n4 = (n[i] for i in (1, 2, 3, 4))
    if not all((n1, n2, n3, n4)):
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), top) for d, top in zip(raw, (0.95, 1.9, 2.85)))


def plain_bits(texts, order=5):
    """Bits per byte of each text under an interpolated modified Kneser-Ney model of all of them."""
    bodies = [b"\n" * (order - 1) + (t or "").encode() for t in texts]
    levels = [Counter(b[i - order + 1 : i + 1] for b in bodies for i in range(order - 1, len(b)))]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    model = {b"": 1 / 256}
    for counts in reversed(levels):
        d, total, taken = discount(counts.values()), Counter(), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            taken[g[:-1]] += d[min(n, 3) - 1]
        lower = lambda g: model[g[1:]] if len(g) > 1 else model[b""]
        model |= {g: (n - d[min(n, 3) - 1]) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * lower(g) for g, n in counts.items()}
    out = []
    for b in bodies:
        cost = [-math.log2(model[b[i - order + 1 : i + 1]]) for i in range(order - 1, len(b))]
        out.append(sum(cost) / len(cost) if cost else None)
    return out


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    duplicates = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(marked))


def test_scores_and_base_counts(spark):
    from barloom.llm.perplexity import judged

    rng = random.Random(2)
    syllables = ["an", "ber", "do", "é", "ß", "😀", " ", " ", "\n", " ", "#", "|", "x\ty"]
    texts = ["".join(rng.choices(syllables, k=rng.randint(0, 300))) for _ in range(60)] + [None, "", "a a a a a a", "one\ntwo\none\n\n\n"]
    langs = [rng.choice(["en", "de", None]) for _ in texts]
    rows = [(i, t, lang, "x", 2.0) for i, (t, lang) in enumerate(zip(texts, langs))]
    rows += [(None, texts[4], "en", "y", 1.0), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, bits double")
    got = judged(docs, parts=4).collect()
    assert len(got) == len(rows)
    want = {}
    for lang in ("en", "de", None):
        own = [r for r in rows if r[2] == lang]
        want |= {(r[0], r[2]): b for r, b in zip(own, plain_bits([r[1] for r in own]))}
    by_id = {r[0]: r for r in rows}
    for r in got:
        b = want[r["doc_id"], r["lang"]]
        assert (r["perplexity"] is None) == (b is None)
        assert b is None or math.log2(r["perplexity"]) == pytest.approx(b, abs=1e-4)
        base = plain_base(by_id[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["kept"] and r["base_failed"])


def test_bands_reject_what_is_unlike_its_language(spark):
    from barloom.llm.perplexity import judged

    rng = random.Random(4)
    words = [a + b for a in ("stone", "river", "winter", "house", "garden", "walk", "under", "light") for b in ("", "s", "ing", "er", "ed", "ly", "ful")]
    texts = [" ".join(rng.choices(words, k=90)) for _ in range(200)]
    noise = " ".join("".join(rng.choices("qxzjkvw0123456789", k=6)) for _ in range(90))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, noise])], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in judged(docs, parts=3, least=0.15).collect()}
    assert not kept[200] and all(kept[i] for i in range(200))
    assert judged(docs.limit(0)).count() == 0


def test_held_out_grams_are_those_of_a_model_without_them():
    import numpy as np

    from barloom.llm.perplexity import Bucket, _merged, bits, counted

    rng = random.Random(6)
    part = lambda: [bytes(rng.choices(b"abcd ", k=400))]
    ours, others = counted(part()), counted(part())
    keys, n = _merged([ours[0], others[0]], [ours[1], others[1]])
    tables, pairs = [np.array([0.5, 1.0, 1.5])] * 3, np.linspace(0.01, 0.9, 65536)
    got = Bucket(keys, n, tables, pairs).held_out(np.searchsorted(keys, ours[0]), ours[1])
    both = np.isin(ours[0], others[0])
    want = bits(*others, tables, pairs)[np.searchsorted(others[0], ours[0][both])]
    assert both.any() and not both.all()
    assert got[both] == pytest.approx(want)
    assert got[~both].min() > 0 and np.isfinite(got).all()


def test_default_bands_reject_noise_and_keep_mixed_languages(spark):
    """Noise beside clean texts in two languages; texts that mix the two and one with a key stay."""
    from barloom.llm.perplexity import judged

    rng = random.Random(8)
    tails = {"en": ("", "s", "ing", "er", "ed", "ly", "ful"), "de": ("", "en", "ung", "heit", "lich", "bar", "te")}
    stems = {"en": ("stone", "river", "winter", "house", "garden", "walk"), "de": ("straß", "fluß", "wand", "haus", "gärt", "kauf")}
    words = {k: [a + b for a in stems[k] for b in tails[k]] for k in tails}
    clean = {k: [" ".join(rng.choices(words[k], k=90)) for _ in range(150)] for k in words}
    mixed = [" ".join(rng.choices(words["en"], k=60) + rng.choices(words["de"], k=40)) for _ in range(3)]
    key = " ".join(rng.choices(words["en"], k=90)) + " " + "".join(rng.choices("0123456789abcdef", k=20))
    noise = [" ".join("".join(rng.choices(letters, k=6)) for _ in range(90)) for letters in ("qxzjkvw0123456789", "abcdefghijklmnopqrstuvwxyz")]
    rows = [(t, k) for k in clean for t in clean[k]] + [(t, "en") for t in (*mixed, key, *noise)]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in judged(docs).collect()}
    assert [i for i, ok in kept.items() if not ok] == [304, 305]
