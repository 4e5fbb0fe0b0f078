"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of the statistics, with monotonic constraints: more of a listed statistic (symbols, lines
and windows that repeat, shouting, table bars) never raises the score. The trees are then flattened into numpy node
arrays, and a batch of documents walks all trees level by level.

The model is fitted on a sample of about ``Fit.documents`` labelled documents, drawn by a hash of their id over all
labels. Nulls: a null text has no words, so it fails the base rules; a null label or id is not learned from. Where no
label has both classes, the verdict keeps all that the base rules keep. Repeated rows give a row each. Extra columns are
not read. Texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, prepare

# The base rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW, LEAST_WORDS, MOST_REPEATS = 8, 20, 30
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TO_SPACE = str.maketrans({c: " " for c in SPACES})

#: Name of each statistic, and its constraint: -1 if more of it never raises the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "bars": -1, "dup_lines": -1, "repeat_words": -1,
    "upper": -1, "digits": 0, "marks": -1, "letters": 0, "distinct": 0, "line_words": 0, "short_words": 0,
}


def repeated_words(words: list[str]) -> int:
    """Words in windows of eight that the text holds twice or more. Windows are compared by hash, then word by word."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    a, b = order[1:][same], order[:-1][same]
    twice = np.zeros(n, bool)
    if (windows[a] == windows[b]).all():
        twice[a] = twice[b] = True
    else:  # two windows share a hash: count them one by one
        seen: dict[bytes, list[int]] = {}
        for i in np.union1d(a, b).tolist():
            seen.setdefault(windows[i].tobytes(), []).append(i)
        for found in seen.values():
            twice[found] = len(found) > 1
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base(text: str | None) -> tuple[list[str], list[int]]:
    """The words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        words = text.split()
    else:
        words = [w for w in text.translate(_TO_SPACE).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    counts = [len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)]
    return words, counts


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATS * n_words


def features(text: str | None, words: list[str], counts: list[int]) -> list[float]:
    n, chars, symbols, dup, repeat = counts
    if not n:
        return [0.0] * len(FEATURES)
    text = text or ""
    body = "".join(words)
    lines = text.count("\n") + 1
    upper, digits, letters = (chars - len(kind.sub("", body)) for kind in (_UPPER, _DIGIT, _LETTER))
    return [
        float(np.log1p(n)), chars / n, symbols / chars, text.count("|") / n, dup / lines, repeat / n,
        upper / chars, digits / chars, (body.count("!") + body.count("?")) / n, letters / chars,
        len(set(words)) / n, min(n / lines, 200.0), sum(1 for w in words if len(w) <= 2) / n,
    ]


_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[^\W\d_]+")


# --- trees ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    documents: int = 8000
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least_weight: float = 4.0
    keep_from: float = 0.5
    seed: int = 10


@dataclass
class Forest:
    """Node arrays of all trees. A leaf points at itself, so every row takes as many steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability that a row is good."""
        total = np.full(len(x), self.start)
        if len(self.roots):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at].sum(1)
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, fit: Fit, signs: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss. Leaves keep within bounds that the splits above them set, so that the constraints hold."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start, nodes, roots = float(np.log(mean / (1 - mean))), [], []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, fit.bins + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]) if len(y) else np.zeros((0, 0), int)
    raw = np.full(len(y), start)

    def weight(g, h, low, high):
        return np.clip(-g / (h + fit.ridge), low, high)

    def gain(g, h, w):
        return -(g * w + 0.5 * (h + fit.ridge) * w * w)

    def grow(rows, g, h, depth, low, high) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        w = float(weight(gs, hs, low, high))
        nodes.append([0, np.inf, me, me, w * fit.rate])
        best = (1e-6, -1, -1)
        if depth < fit.depth:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.bincount(binned[rows, f], g[rows], len(c) + 1).cumsum()[:-1]
                hl = np.bincount(binned[rows, f], h[rows], len(c) + 1).cumsum()[:-1]
                wl, wr = weight(gl, hl, low, high), weight(gs - gl, hs - hl, low, high)
                won = gain(gl, hl, wl) + gain(gs - gl, hs - hl, wr) - gain(gs, hs, w)
                ok = (hl >= fit.least_weight * 0.25) & (hs - hl >= fit.least_weight * 0.25) & (signs[f] * (wr - wl) >= 0)
                won = np.where(ok, won, -1.0)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (float(won[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            go = binned[rows, f] <= k
            a, b = rows[go], rows[~go]
            wl, wr = weight(g[a].sum(), h[a].sum(), low, high), weight(g[b].sum(), h[b].sum(), low, high)
            mid = (wl + wr) / 2
            bounds = [(low, high), (low, high)] if not signs[f] else [(low, mid), (mid, high)] if signs[f] > 0 else [(mid, high), (low, mid)]
            left = grow(a, g, h, depth + 1, *bounds[0])
            right = grow(b, g, h, depth + 1, *bounds[1])
            nodes[me] = [f, cuts[f][k], left, right, 0.0]
        return me

    def forest() -> Forest:
        t = np.array(nodes, dtype=float).reshape(-1, 5)
        return Forest(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4], np.array(roots, int), fit.depth, start)

    if len(np.unique(y)) == 2:
        for _ in range(fit.trees):
            p = 1 / (1 + np.exp(-raw))
            first = len(nodes)
            roots.append(first)
            grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0)
            one = forest()
            one.roots, one.start = np.array([first]), 0.0
            s = np.clip(one.scores(x), 1e-12, 1 - 1e-12)
            raw += np.log(s / (1 - s))
    else:
        start = 20.0  # nothing to tell apart: keep all
    return forest()


# --- operators --------------------------------------------------------------------------------------------------------

_STATS = "doc_id long, " + ", ".join(f"{n} double" for n in FEATURES)


def _features(ids, texts):
    rows = [features(t, *base(t)) for t in texts]
    return [ids, *([r[k] for r in rows] for k in range(len(FEATURES)))]


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Forest:
    """A forest that tells quality 1 from 0 among the labelled documents."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, fit.documents / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(fit.seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    stats = arrow_rows(docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id"), _features, _STATS)  # about Fit.documents ids
    got = stats.join(F.broadcast(drawn), "doc_id").toPandas().sort_values(["doc_id", "quality"], ignore_index=True)
    return boost(got[list(FEATURES)].to_numpy(float), got["quality"].to_numpy(float), fit, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: Forest, fit: Fit = Fit()) -> DataFrame:
    """doc_id, the base counts and verdict, the score of the trees, and kept, of every row of ``docs``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(ids, texts):
        counts, rows = [], []
        for text in texts:
            words, c = base(text)
            counts.append(c)
            rows.append(features(text, words, c))
        score = shared.value.scores(np.array(rows, float).reshape(len(rows), len(FEATURES))).tolist()
        bad = [failed(c[0], c[4]) for c in counts]
        cols = [[c[k] for c in counts] for k in range(5)]
        return [ids, *cols, bad, [not b and s >= fit.keep_from for b, s in zip(bad, score)], score]

    return arrow_rows(docs.select("doc_id", "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
