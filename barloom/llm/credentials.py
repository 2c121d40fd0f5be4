"""Secrets in texts: fixed rules, widened by a character convolutional network over every candidate.

A candidate is a run of key characters that mixes letters and digits (or, if long, cases). The network reads
its characters with those around it: embedding, one convolution, maximum and mean over all positions, a
dense layer. Runs of any length are read whole; the pooling is put together from pieces. It is trained in
numpy on labelled findings: all that the rules found in the corpus, all other candidates of it,
and drawn keys and harmless tokens of common formats set into contexts of the corpus. Many findings are cut into shares;
their tasks train side by side and their weights are averaged after each epoch. A held-out part of the
findings calibrates the scores and sets, for each alphabet of candidates, the threshold with the best precision
among those that keep the wanted recall.
"""

from __future__ import annotations

import copy
import itertools
import re
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of, texts, whole_groups
from barloom.session import settle

KINDS = ("assign", "access", "hex", "learned")
# The rules of the contract: pattern, group that carries the value, least length of it (fixed values).
RULES = (
    (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 1, 8),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    (re.compile(r"[0-9a-f]{32,}+"), 0, 32),
)
#: Runs of key characters; full stops and equals signs at their edges belong to the text.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}+")
#: Characters of context before and after a candidate.
BEFORE, AFTER = 32, 8

Finding = tuple[str, str, str]  # before, value, after


def rule_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the value)`` of the rules' matches, by start, then kind."""
    found = []
    for kind, (pattern, group, least) in enumerate(RULES):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end(), m.start(group)))
    return sorted(found)


def _mixed(run: str) -> bool:
    if any(c.isdigit() for c in run):
        return any(c.isalpha() for c in run)
    return len(run) >= 16 and re.search("[a-z][A-Z]", run) is not None


def candidate_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every run that can be a key."""
    for m in _RUN.finditer(text):
        run = m.group()
        if not _mixed(run):
            continue
        start = m.start() + len(run) - len(run.lstrip(".="))
        end = m.end() - (len(run) - len(run.rstrip(".")))
        if end - start >= 8:
            yield start, end


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_CANDIDATES = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("value", pa.string()), ("after", pa.string()), ("hit", pa.bool_())]
    )
)


def _read(text: str) -> tuple[list[dict], list[dict]]:
    """The rules' spans and all candidates of one text; a hit is a candidate in the value of a rule's match."""
    rules = rule_spans(text)
    base = [{"kind": k, "start": a, "end": b} for a, k, b, _ in rules]
    reach = np.maximum.accumulate([b for _, _, b, _ in rules]).tolist() if rules else []
    found, at = [], 0
    for start, end in candidate_spans(text):
        while at < len(rules) and reach[at] <= start:
            at += 1
        touched = hit = False
        for a, _, b, value in itertools.takewhile(lambda r: r[0] < end, itertools.islice(rules, at, None)):  # noqa: B023
            touched |= b > start
            hit |= b > start and value < end
        if touched and not hit:
            continue  # the name of a key, not its value
        found.append(
            {"start": start, "end": end, "before": text[max(0, start - BEFORE) : start], "value": text[start:end], "after": text[end : end + AFTER], "hit": hit}
        )
    return base, found


def read_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, candidates`` of every row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read(t) for t in texts(batch, "_text")]
            columns = [batch.column("id"), pa.array([r[0] for r in rows], _SPANS), pa.array([r[1] for r in rows], _CANDIDATES)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "base", "candidates"])

    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, base array<struct<kind:int,start:int,end:int>>, "
        "candidates array<struct<start:int,end:int,before:string,value:string,after:string,hit:boolean>>"
    )
    return slim.mapInArrow(run, schema)


# ------------------------------------------------------------------ network

_OTHER, _PAD = 128, 129
_GAP = "￿"


EPOCHS, RATE = 12, 4e-3


@dataclass
class State:
    """Weights of a network with Adam's running sums."""

    weights: dict[str, np.ndarray]
    mean: dict[str, np.ndarray]
    square: dict[str, np.ndarray]
    step: int = 0


@dataclass
class Network:
    """Embedding of characters and roles, one convolution, maximum and mean, a dense layer, a logit."""

    size: int = 12
    width: int = 5
    filters: int = 40
    dense: int = 24
    seed: int = 11
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            shapes = {"code": (_PAD + 1, self.size), "role": (3, self.size), "conv": (self.width, self.size, self.filters)}
            shapes |= {"inner": (2 * self.filters, self.dense), "outer": (self.dense, 1)}
            for name, shape in shapes.items():
                fan = np.prod(shape[:-1]) if name in ("conv", "inner", "outer") else 4
                self.weights[name] = rng.normal(0, np.sqrt(2 / fan), shape)
            self.weights |= {"conv_bias": np.zeros(self.filters), "inner_bias": np.zeros(self.dense), "outer_bias": np.zeros(1)}

    def _layout(self, findings: Sequence[Finding]):
        """All characters in a row with gaps between findings, their roles, and the bounds of findings and values."""
        gap = _GAP * (self.width - 1)
        flat = np.frombuffer((gap.join("".join(f) for f in findings) + gap).encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = np.where(flat == ord(_GAP), _PAD, np.minimum(flat, _OTHER)).astype(np.int64)
        sizes = np.array([[len(x) for x in f] for f in findings], dtype=np.int64)
        whole = sizes.sum(axis=1)
        starts = np.concatenate(([0], np.cumsum(whole + self.width - 1)[:-1]))
        roles = np.zeros(len(codes), dtype=np.int64)
        value = starts + sizes[:, 0]
        inside = np.zeros(len(codes) + 1, dtype=np.int64)
        for at, sign in ((value, 1), (value + sizes[:, 1], 1)):
            np.add.at(inside, at, sign)
        np.add.at(inside, starts + whole, -2)
        roles = np.cumsum(inside)[:-1]
        return codes, roles, starts, whole, value, sizes[:, 1]

    def _convolved(self, codes: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        cells = w["code"][codes] + w["role"][roles]
        n = len(codes) - self.width + 1
        out = np.repeat(w["conv_bias"][None], n, axis=0)
        for k in range(self.width):
            out += cells[k : k + n] @ w["conv"][k]
        return cells, np.maximum(out, 0)

    @staticmethod
    def _over(fold, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``fold`` over one stretch of rows for each start."""
        edges = np.stack((starts, np.minimum(starts + sizes, len(values) - 1)), axis=1).ravel()
        # A stretch that ends with the rows ends one row early in that list.
        out = fold.reduceat(values, edges, axis=0)[::2]
        if starts[-1] + sizes[-1] == len(values):
            out[-1] = fold.reduce(values[starts[-1] :], axis=0)
        return out

    def _logits(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        hidden = np.maximum(pooled @ w["inner"] + w["inner_bias"], 0)
        return hidden, (hidden @ w["outer"] + w["outer_bias"])[:, 0]

    def _long(self, finding: Finding, piece: int) -> np.ndarray:
        """Pooled features of one finding, read in pieces."""
        codes, roles, starts, whole, value, size = self._layout([finding])
        best, total = np.zeros(self.filters), np.zeros(self.filters)
        for at in range(0, int(whole[0]), piece):
            _, h = self._convolved(codes[at : at + piece + self.width - 1], roles[at : at + piece + self.width - 1])
            best = np.maximum(best, h.max(axis=0))
            a, b = max(int(value[0]) - at, 0), min(int(value[0] + size[0]) - at, len(h))
            total += h[a:b].sum(axis=0) if a < b else 0
        return np.concatenate((best, total / size[0]))

    def scores(self, findings: Sequence[Finding], piece: int = 1 << 15) -> np.ndarray:
        """Logit of every finding; memory is that of ``piece`` characters."""
        out = np.empty((len(findings), 2 * self.filters))
        for at, end in self._blocks(findings, piece):
            if sum(map(len, findings[at])) + self.width > piece:
                out[at] = self._long(findings[at], piece)
                continue
            codes, roles, starts, whole, value, size = self._layout(findings[at:end])
            _, h = self._convolved(codes, roles)
            out[at:end, : self.filters] = self._over(np.maximum, h, starts, whole)
            out[at:end, self.filters :] = self._over(np.add, h, value, size) / size[:, None]
        return self._logits(out)[1]

    def _blocks(self, findings: Sequence[Finding], piece: int) -> Iterator[tuple[int, int]]:
        """Bounds of stretches of findings of at most ``piece`` characters; a longer finding is a stretch of its own."""
        at = 0
        while at < len(findings):
            end, room = at, piece
            while end < len(findings) and (size := sum(map(len, findings[end])) + self.width) <= room:
                room -= size
                end += 1
            yield at, max(end, at + 1)
            at = max(end, at + 1)

    def _gradients(self, findings: Sequence[Finding], labels: np.ndarray, piece: int = 1 << 18) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss; memory is that of ``piece`` characters."""
        w, f = self.weights, self.filters
        pooled, blocks = np.empty((len(findings), 2 * f)), list(self._blocks(findings, piece))
        held = None
        for at, end in blocks:
            if sum(map(len, findings[at])) + self.width > piece:
                pooled[at] = self._long(findings[at], piece)
                continue
            held = self._layout(findings[at:end])
            codes, roles, starts, whole, value, size = held
            cells, h = self._convolved(codes, roles)
            pooled[at:end, :f] = self._over(np.maximum, h, starts, whole)
            pooled[at:end, f:] = self._over(np.add, h, value, size) / size[:, None]
        hidden, logit = self._logits(pooled)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels)[:, None] / len(labels)
        d_hidden = (error @ w["outer"].T) * (hidden > 0)
        d_pooled = d_hidden @ w["inner"].T
        found = {k: np.zeros_like(w[k]) for k in ("code", "role", "conv", "conv_bias")}
        for at, end in blocks:
            best, d = pooled[at:end, :f], d_pooled[at:end]
            if sum(map(len, findings[at])) + self.width > piece:
                codes, roles, starts, whole, value, size = self._layout([findings[at]])
                for first in range(0, int(whole[0]), piece):
                    part = slice(first, first + piece + self.width - 1)
                    cells, h = self._convolved(codes[part], roles[part])
                    self._back(found, codes[part], roles[part], cells, h, np.zeros(len(h), np.int64), np.arange(len(h)) + first, starts, whole, value, size, best, d)
                continue
            if len(blocks) > 1:
                held = self._layout(findings[at:end])
                cells, h = self._convolved(*held[:2])
            codes, roles, starts, whole, value, size = held
            # Rows of the convolution belong to a finding, or to the gap after it.
            owner = np.repeat(np.arange(len(starts)), whole + self.width - 1)[: len(h)]
            self._back(found, codes, roles, cells, h, owner, np.arange(len(h)), starts, whole, value, size, best, d)
        return found | {
            "inner": pooled.T @ d_hidden,
            "inner_bias": d_hidden.sum(axis=0),
            "outer": hidden.T @ error,
            "outer_bias": error.sum(axis=0),
        }

    def _back(self, found: dict, codes, roles, cells, h, owner, row, starts, whole, value, size, best, d_pooled) -> None:
        """Add to ``found`` what rows ``row`` of the convolution, each of finding ``owner``, give to the weights below the pooling."""
        w, f = self.weights, self.filters
        d_h = (h == best[owner]) * d_pooled[owner, :f] * (row - starts[owner] < whole[owner])[:, None]
        within = (row >= value[owner]) & (row < (value + size)[owner])
        d_h += d_pooled[owner, f:] * (within / size[owner])[:, None]
        d_h *= h > 0
        d_cells = np.zeros_like(cells)
        for k in range(self.width):
            found["conv"][k] += cells[k : k + len(h)].T @ d_h
            d_cells[k : k + len(h)] += d_h @ w["conv"][k].T
        spread = lambda index, n: np.stack([np.bincount(index, d_cells[:, j], n) for j in range(self.size)], axis=1)
        found["code"] += spread(codes, _PAD + 1)
        found["role"] += spread(roles, 3)
        found["conv_bias"] += d_h.sum(axis=0)

    def untrained(self) -> State:
        """The weights with Adam's sums before the first step."""
        return State(self.weights, *({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2)))

    def steps(self, state: State, findings: Sequence[Finding], labels: np.ndarray, order: np.ndarray, rate: float, batch: int = 64) -> State:
        """Adam over the findings in that order, once; weights and sums are changed in place."""
        self.weights, mean, square = state.weights, state.mean, state.square
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            state.step += 1
            for k, g in self._gradients([findings[i] for i in chosen], labels[chosen]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                scaled = mean[k] / (1 - 0.9**state.step) / (np.sqrt(square[k] / (1 - 0.999**state.step)) + 1e-8)
                self.weights[k] -= rate * scaled
        return state

    def fit(self, findings: Sequence[Finding], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Network:
        """Adam over shuffled batches."""
        rng, state = np.random.default_rng(self.seed), self.untrained()
        for epoch in range(epochs):
            self.steps(state, findings, labels, rng.permutation(len(findings)), rate * (1 - epoch / epochs))
        return self


# ------------------------------------------------------------ labelled findings

#: Words that introduce a key or a harmless token in drawn findings (fixed values).
_KEY_CONTEXTS = ("Authorization: Bearer ", "pwd=", "private_key: ", "client key ", "-u admin:", "credential = '", "auth=", "signature: ", "")
_PLAIN_CONTEXTS = ("see page ", "version ", "file ", "at ", "http://www.", "in section ", "model ", "order no. ", "")


def drawn_findings(contexts: Sequence[tuple[str, str]], count: int, seed: int) -> tuple[list[Finding], np.ndarray]:
    """``count`` findings of each label: keys and harmless tokens of common formats in the given contexts."""
    rng = np.random.default_rng(seed)
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    pick = lambda chars, n: "".join(np.array(list(chars))[rng.integers(0, len(chars), n)])
    number = lambda a, b: int(rng.integers(a, b))

    def key() -> str:
        while True:
            form, n = number(0, 7), number(20, 65)
            drawn = [
                lambda: pick(digits + "abcdef", n),
                lambda: pick(digits + "ABCDEF", n),
                lambda: pick(upper + lower + digits, n),
                lambda: pick(upper + lower + digits + "+/", n) + "=" * number(0, 3),
                lambda: pick(lower, 2 + number(0, 3)) + "_" + pick(upper + lower + digits, n),
                lambda: pick(upper + lower + digits + "_-", n),
                lambda: pick(upper + digits, n),
            ][form]()
            if _mixed(drawn):
                return drawn

    def word(least: int = 2) -> str:
        return "".join(pick("bcdfghlmnprst", 1) + pick("aeiou", 1) for _ in range(number(least, least + 4)))

    def plain() -> str:
        form = number(0, 9)
        while True:
            drawn = [
                lambda: f"{number(1900, 2100)}-{number(1, 13):02d}-{number(1, 29):02d}T{number(0, 24):02d}",
                lambda: f"{word()}_{number(1, 2100)}.{pick(lower, 3)}",
                lambda: f"{word()}.{word()}{number(1, 100)}.com",
                lambda: f"{word().upper()}-{number(100, 10**6)}",
                lambda: "".join(word().capitalize() for _ in range(4)),
                lambda: f"v{number(0, 20)}.{number(0, 20)}.{number(0, 20)}-{word()}",
                lambda: f"{word()}/{word()}/{word()}{number(0, 100)}",
                lambda: pick(lower, 1) * number(6, 30) + pick(digits, 1) * number(2, 20),
                lambda: f"{word(4)}{number(1, 10000)}",
            ][form]()
            if _mixed(drawn) and len(drawn) >= 8:
                return drawn

    out: list[Finding] = []
    for i in range(2 * count):
        before, after = contexts[number(0, len(contexts))] if contexts else ("", "")
        words = _KEY_CONTEXTS if i < count else _PLAIN_CONTEXTS
        # A plain word in front of a key and a telling one in front of a harmless token come up as well.
        words = words if rng.random() < 0.8 else _KEY_CONTEXTS + _PLAIN_CONTEXTS
        intro = words[number(0, len(words))]
        out.append(((before + intro)[-BEFORE:], key() if i < count else plain(), after))
    return out, np.repeat([1.0, 0.0], count)


def corpus_findings(read: DataFrame, seed: int = 11) -> DataFrame:
    """All distinct findings ``(before, value, after, hit, rank)`` of :func:`read_texts`, ranked by their hashes."""
    flat = read.select(F.explode("candidates").alias("c")).select("c.before", "c.value", "c.after", "c.hit").distinct()
    return flat.withColumn("rank", F.xxhash64(F.lit(seed), "value", "before", "after"))


def _contexts(hits: list[tuple[str, str]], others: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """What stands around findings, without the names and quotes that the rules ask for."""
    return others + [(before.split("=")[0][:-8], after.lstrip("\"'")) for before, after in hits]


def labelled_findings(read: DataFrame, rows: int = 4000, seed: int = 11) -> tuple[list[Finding], np.ndarray]:
    """All findings of the texts with labels, and a quarter of ``rows`` drawn ones of each label.

    Values of the rules' matches are positive, other candidates negative. Everything comes to the driver:
    :func:`fitted_detector` calls this for texts with few findings and leaves others where they are.
    """
    found = corpus_findings(read, seed)
    taken: dict[bool, list[Finding]] = {}
    for hit in (True, False):
        chosen = found.filter(F.col("hit") == hit).orderBy("rank", "value", "before", "after").collect()
        taken[hit] = [(r["before"], r["value"], r["after"]) for r in chosen]
    contexts = _contexts(*([(f[0], f[2]) for f in taken[hit]] for hit in (True, False)))
    drawn, labels = drawn_findings(contexts, rows // 4, seed)
    every = [*taken[True], *taken[False], *drawn]
    return every, np.concatenate((np.ones(len(taken[True])), np.zeros(len(taken[False])), labels))


# ---------------------------------------------------------------- detector

#: Alphabets with thresholds of their own.
ALPHABETS = ("hexadecimal", "letters and digits", "with marks")


def alphabet(value: str) -> int:
    if not set(value) - set(string.hexdigits):
        return 0
    return 1 if value.isalnum() else 2


@dataclass
class Detector:
    """A fitted network with its calibration ``probability = 1 / (1 + exp(-(slope * logit + shift)))`` and thresholds."""

    network: Network
    slope: float
    shift: float
    thresholds: tuple[float, ...]

    def probabilities(self, findings: Sequence[Finding]) -> np.ndarray:
        if not findings:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.scores(findings) + self.shift, -40, 40)))

    def accepts(self, findings: Sequence[Finding]) -> np.ndarray:
        bounds = np.array([self.thresholds[alphabet(f[1])] for f in findings])
        return self.probabilities(findings) >= bounds


def _calibrated(logit: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method on the smoothed logistic loss."""
    positive, negative = (labels * weight).sum(), ((1 - labels) * weight).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x, theta = np.stack((logit, np.ones_like(logit)), axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hessian = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ ((p - target) * weight))
    return float(theta[0]), float(theta[1])


def _threshold(p: np.ndarray, labels: np.ndarray, weight: np.ndarray, recall: float) -> float:
    """The best precision among thresholds that keep ``recall`` of the positives; the lowest of equal ones."""
    order = np.argsort(p, kind="stable")
    p, weight, positive = p[order], weight[order], labels[order] == 1
    own, other = p[positive], p[~positive]
    if not len(own):
        return 0.5
    upto, total = np.cumsum(weight[positive]), weight[positive].sum()
    bounds = own[upto - weight[positive] <= (1 - recall) * total]
    above = lambda x, w: w.sum() - np.append(0.0, np.cumsum(w))[np.searchsorted(x, bounds)]
    kept, false = above(own, weight[positive]), above(other, weight[~positive])
    best = np.argmax(kept / (kept + false))
    # Half-way down to the next harmless one, so that keys a little less clear are found too.
    below = other[other < bounds[best]]
    return float((bounds[best] + (below.max() if len(below) else 0.0)) / 2)


def _detector(network: Network, logit: np.ndarray, labels: np.ndarray, kinds: np.ndarray, weight: np.ndarray, recall: float) -> Detector:
    """Calibration and thresholds by held-out findings, each as often as its weight says."""
    slope, shift = _calibrated(logit, labels, weight)
    p = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -40, 40)))
    thresholds = tuple(_threshold(p[kinds == k], labels[kinds == k], weight[kinds == k], recall) for k in range(len(ALPHABETS)))
    return Detector(network, slope, shift, thresholds)


def _third(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A third of ``n`` places, held out, and the others."""
    order = np.random.default_rng(seed).permutation(n)
    return order[: n // 3], order[n // 3 :]


def fit_detector(findings: Sequence[Finding], labels: np.ndarray, recall: float = 0.97, seed: int = 11) -> Detector:
    """Two thirds of the findings fit the network, one third calibrates it; ``recall`` holds on that third."""
    held, used = _third(len(findings), seed)
    network = Network(seed=seed).fit([findings[i] for i in used], labels[used])
    logit = network.scores([findings[i] for i in held])
    kinds = np.array([alphabet(findings[i][1]) for i in held])
    return _detector(network, logit, labels[held], kinds, np.ones(len(held)), recall)


#: Characters of the values of one kind in a share.
SHARE_CHARS = 1 << 22
#: Averages are of whole multiples of this, and held-out logits are counted by multiples of the other, so that no order of tasks shows.
_UNIT, _BIN = 2.0**-40, 2.0**-8


def _packed(state: State) -> np.ndarray:
    """All numbers of a state in units; Adam's squares by their roots."""
    roots = {k: np.sqrt(v) for k, v in state.square.items()}
    flat = np.concatenate([t[k].ravel() for t in (state.weights, state.mean, roots) for k in sorted(t)])
    return np.append(np.rint(flat / _UNIT), state.step).astype(np.int64)


def _unpacked(sums: np.ndarray, n: int, like: dict[str, np.ndarray]) -> State:
    """The mean of ``n`` states from the sum of their packed forms."""
    values, at, tables = sums[:-1] / n * _UNIT, 0, []
    for _ in range(3):
        tables.append({})
        for k in sorted(like):
            tables[-1][k] = values[at : at + like[k].size].reshape(like[k].shape)
            at += like[k].size
    return State(tables[0], tables[1], {k: v * v for k, v in tables[2].items()}, int(round(sums[-1] / n)))


def dealt_findings(found: DataFrame, shares: dict[bool, int], seed: int) -> DataFrame:
    """``found`` with ``part`` and ``held``: each kind is dealt in its number of shares, and these are dealt again to as many
    parts as the kind with more has shares. A third of the findings is held out, in all parts alike."""
    count = F.when(F.col("hit"), shares[True]).otherwise(shares[False])
    dealt = found.withColumn("_shares", count.cast("int")).withColumn("_own", F.expr("cast(pmod(rank, _shares) as int)"))
    dealt = dealt.withColumn("part", F.explode(F.sequence("_own", F.lit(max(shares.values()) - 1), "_shares")))
    held = F.pmod(F.xxhash64(F.lit(seed + 1), "value", "before", "after"), F.lit(3)) == 0
    return dealt.select("part", "rank", "before", "value", "after", "hit", held.alias("held"))


def fit_on_shares(dealt: DataFrame, drawn: Sequence[Finding], labels: np.ndarray, parts: int, recall: float, seed: int) -> Detector:
    """:func:`fit_detector` for findings that stay in their tasks.

    In each epoch every part goes on from the same weights over its own findings and all drawn ones, and the results
    are averaged. Held-out findings are scored where they lie; their logits come back as counts.
    """
    held, used = _third(len(drawn), seed)
    near, near_labels = [drawn[i] for i in used], labels[used]
    network = Network(seed=seed)
    state = network.untrained()
    spark = dealt.sparkSession
    tasks = min(parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    rows = dealt.repartition(tasks, "part").sortWithinPartitions("part", "rank", "value", "before", "after", "hit")

    def findings_of(t: pa.Table, of_held: bool) -> tuple[list[Finding], np.ndarray]:
        t = t.filter(pc.equal(t.column("held"), of_held))
        return list(zip(*(t.column(c).to_pylist() for c in ("before", "value", "after")), strict=True)), np.array(t.column("hit").to_pylist(), dtype=float)

    for epoch in range(EPOCHS):

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch, given: State = state) -> Iterator[pa.RecordBatch]:
            total, n = 0, 0
            for t in whole_groups(batches, ["part"]):
                own, own_labels = findings_of(t, False)
                order = np.random.default_rng([seed, epoch, t.column("part")[0].as_py()]).permutation(len(own) + len(near))
                done = Network(seed=seed, weights=given.weights).steps(
                    copy.deepcopy(given), [*own, *near], np.append(own_labels, near_labels), order, RATE * (1 - epoch / EPOCHS)
                )
                total, n = total + _packed(done), n + 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n], pa.int64())], ["state", "n"])

        done = rows.mapInArrow(run, "state binary, n long").collect()
        sums = sum(np.frombuffer(r["state"], dtype=np.int64) for r in done)
        state = _unpacked(sums, sum(r["n"] for r in done), state.weights)
    network.weights = state.weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["part"]):
            own, own_labels = findings_of(t, True)
            if own:
                bins = np.rint(np.clip(network.scores(own), -128, 128) / _BIN).astype(np.int64)
                columns = [bins, own_labels, np.array([alphabet(f[1]) for f in own], np.int32)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["bin", "label", "kind"])

    # At most as many rows as there are bins, labels and alphabets.
    seen = rows.mapInArrow(judge, "bin long, label double, kind int").groupBy("bin", "label", "kind").count().orderBy("kind", "label", "bin").collect()
    others = [drawn[i] for i in held]
    logit = np.append([r["bin"] * _BIN for r in seen], network.scores(others))
    kinds = np.append([r["kind"] for r in seen], [alphabet(f[1]) for f in others])
    weight = np.append([float(r["count"]) for r in seen], np.full(len(others), float(parts)))
    return _detector(network, logit, np.append([r["label"] for r in seen], labels[held]), kinds, weight, recall)


def fitted_detector(read: DataFrame, rows: int = 4000, recall: float = 0.97, seed: int = 11) -> Detector:
    """A detector fitted on all findings of the texts.

    Rules' values and other candidates are each cut into shares of at most a quarter of ``rows``. If one share holds all,
    the driver fits the network; else it is fitted where the shares are (:func:`fit_on_shares`).
    """
    quarter = max(1, rows // 4)
    found = settle(corpus_findings(read, seed), "findings")
    sizes = found.groupBy("hit").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).collect()
    shares = {True: 1, False: 1} | {r["hit"]: max(1, -(-r["n"] // quarter), -(-r["chars"] // SHARE_CHARS)) for r in sizes}
    parts = max(shares.values())
    if parts == 1:
        return fit_detector(*labelled_findings(read, rows, seed), recall, seed)
    around = [
        [tuple(r) for r in found.filter(F.col("hit") == hit).orderBy("rank", "value", "before", "after").limit(quarter).select("before", "after").collect()]
        for hit in (True, False)
    ]
    # Only the contexts that drawn findings are set in are picked; all findings of the texts are dealt.
    drawn, labels = drawn_findings(_contexts(*around), quarter, seed)
    return fit_on_shares(dealt_findings(found, shares, seed), drawn, labels, parts, recall, seed)


def find_secrets(
    docs: DataFrame,
    detector: Detector | None = None,
    fit_rows: int = 4000,
    recall: float = 0.97,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, base, spans`` for every row: arrays of ``(kind, start, end)``, kind by number in ``KINDS``.

    ``base`` are the rules' matches by start, then kind; ``spans`` those and the candidates the detector
    accepts, which overlap none of them. Without ``detector`` one is fitted on all findings of these texts, in
    shares of some ``fit_rows`` with drawn ones; all candidates of all texts are scored. A null text is empty; equal texts come
    out alike, as often as they come; null ids are kept; an empty table gives no rows; other columns are
    ignored. Texts are read once; spans and candidates are settled, and no row leaves its task.
    """
    read = settle(read_texts(docs, id_col, text_col), "candidates")
    if detector is None:
        detector = fitted_detector(read, fit_rows, recall, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column("base").to_pylist()
            open_ = [[c for c in row if not c["hit"]] for row in batch.column("candidates").to_pylist()]
            flat = [(c["before"], c["value"], c["after"]) for row in open_ for c in row]
            good = iter(detector.accepts(flat).tolist())
            rows = []
            for own, row in zip(base, open_, strict=True):
                new = [{"kind": 3, "start": c["start"], "end": c["end"]} for c in row if next(good)]
                rows.append(sorted([*own, *new], key=lambda s: (s["start"], s["kind"])) if new else own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("base"), pa.array(rows, _SPANS)], ["id", "base", "spans"])

    kind = read.schema["id"].dataType.simpleString()
    span = "array<struct<kind:int,start:int,end:int>>"
    return read.mapInArrow(run, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
