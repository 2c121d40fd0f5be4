"""Plain versions of operators for small data."""

from __future__ import annotations

import collections
import hashlib
import re

import xxhash


def line_pairs(text):
    lines = text.split("\n")
    return list(zip(lines, lines[1:]))


def chunks(text, counts, window=2, divisor=3, base=1_000_003, prime=2_147_483_647):
    """Lists of lines; a cut at ``i`` is between lines ``i - 1`` and ``i``, inside their pair."""
    lines, n = text.split("\n"), len(text.split("\n"))
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    count = {i + 1: counts[pair] for i, pair in enumerate(line_pairs(text))}
    at = lambda i: count.get(i, 1)
    edge = set()
    for i in range(1, n):
        low = at(i) <= min(at(i - 1), at(i + 1)) and at(i) < max(at(i - 1), at(i + 1))
        if low and not (at(i) > 1 and i - 1 in edge):
            edge.add(i)
    fixed = edge | {n}
    drawn = set()
    for i in range(window, n):
        value = 0
        for h in hashes[i - window : i]:
            value = (value * base + h) % prime
        if value % divisor == 0 and not fixed & {i - 1, i, i + 1}:
            drawn.add(i)
    ends = sorted(fixed | {i for i in drawn if i - 1 not in drawn})
    return [lines[a:b] for a, b in zip([0, *ends], ends)]


def drop_chunks(texts, **options):
    """id -> text without multi-line chunks that a smaller id, or an earlier place, holds."""
    counts = collections.Counter(pair for text in texts.values() for pair in line_pairs(text))
    seen, out = set(), {}
    for k in sorted(texts):
        kept = []
        for chunk in chunks(texts[k], counts, **options):
            body = "\n".join(chunk)
            if len(chunk) > 1 and re.search(r"[^\x20\x09-\x0D]", body):
                if body in seen:
                    continue
                seen.add(body)
            kept += chunk
        out[k] = "\n".join(kept)
    return out


def fingerprint(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(texts, distance=4):
    """id -> smallest id that it reaches over fingerprints within ``distance``."""
    prints = {k: fingerprint(t) for k, t in texts.items()}
    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {k: root(k) for k in texts}


def sets(texts, width=5):
    out = {}
    for k, t in texts.items():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode("utf-8").split()
        out[k] = frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()
    return out


def near_pairs(texts, similarity=0.8):
    """All pairs of different shingle sets that are similar enough."""
    found, by_shingle, known = [], {}, sets(texts)
    for k in sorted(known):
        common = {}
        for s in known[k]:
            for other in by_shingle.setdefault(s, []):
                common[other] = common.get(other, 0) + 1
            by_shingle[s].append(k)
        found += [(o, k) for o, n in common.items() if known[o] != known[k] and n >= similarity * (len(known[o]) + len(known[k]) - n)]
    return found
