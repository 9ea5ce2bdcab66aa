"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import apply_texts, fold_of, sample_ids, space_words

#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
#: Share of good documents, among those held back from the trees, that the threshold keeps at least.
KEEP_GOOD = 0.998

#: Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: Features of a document and the sign of their effect on its quality: -1 never helps, 1 never hurts, 0 free.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "stop_share": 0,
    "pipe_share": -1,
    "bang_share": -1,
    "distinct_share": 0,
    "mean_line": 0,
    "end_mark_share": 0,
    "longest_word": -1,
}

_NON_START = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text; zeros for null."""
    words = space_words(text)
    if not words:
        return 0, 0, 0, 0, 0
    chars = len(b"".join(words)) if text.isascii() else len(b"".join(words).translate(None, _NON_START))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    return len(words), chars, symbols, dup, _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def features(text: bytes | None, base: tuple[int, int, int, int, int]) -> list[float]:
    """The values of FEATURES; an empty text has zeros."""
    n, chars, symbols, dup, repeat = base
    if not n:
        return [0.0] * len(FEATURES)
    words = text.split()
    lines = text.count(b"\n") + 1
    size = len(text)
    lower = [w for w in words if len(w) <= 3]
    marks = text.count(b".") + text.count(b"?") + text.count(b"!")
    return [
        float(np.log1p(n)),
        chars / n,
        symbols / n,
        dup / lines,
        repeat / n,
        (size - len(text.translate(None, _UPPER))) / size,
        (size - len(text.translate(None, _DIGITS))) / size,
        len(lower) / n,
        text.count(b"|") / n,
        text.count(b"!") / n,
        len(set(words)) / n,
        float(np.log1p(n / lines)),
        marks / n,
        float(np.log1p(max(map(len, words)))),
    ]


@dataclass
class Forest:
    """All trees in flat arrays: node i goes to left[i] if x[feature[i]] <= cut[i], else right[i]; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for the rows of ``x``, all trees and rows at once."""
        if not len(x):
            return np.zeros(0)
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """Boosted trees on logistic loss from binned features.

    Where a feature has a sign, a split on it must order its children's values by that sign, and the children's
    leaves stay on their side of the mean of both values, so the forest is monotonic in that feature.
    """
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    if not len(y):
        return Forest(np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), 0, start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []

    def grow(rows, g, h, level, low, high):
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        nodes.append([0, 0.0, at, at, rate * value])
        best = (1e-6, None)
        if level:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least) | (signs[j] * (vr - vl) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            middle = (vl + vr) / 2
            bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[signs[j]]
            goes = binned[rows, j] <= k
            nodes[at][0], nodes[at][1] = j, float(cuts[j][k])
            nodes[at][2] = grow(rows[goes], g, h, level - 1, bounds[0], bounds[1])
            nodes[at][3] = grow(rows[~goes], g, h, level - 1, bounds[2], bounds[3])
        return at

    every = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(every, p - y, p * (1 - p), depth, -np.inf, np.inf))
        part = Forest(*_arrays(nodes), np.array(roots[-1:]), depth, 0.0)
        leaf = np.full(len(y), roots[-1])
        for _ in range(depth):
            leaf = np.where(x[every, part.feature[leaf]] <= part.cut[leaf], part.left[leaf], part.right[leaf])
        margin = margin + part.value[leaf]
    return Forest(*_arrays(nodes), np.array(roots), depth, start)


def _arrays(nodes):
    a = np.array(nodes, dtype=np.float64)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def _measure(texts):
    base = [base_counts(t) for t in texts]
    return {
        "base": [dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), b)) for b in base],
        "x": [features(t, b) for t, b in zip(texts, base)],
    }


_BASE_DDL = "base struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Fit the forest on at most ``rows`` labelled documents (crc32 fold 2 is left out, for tests).

    Fold 0 of the sample only sets the threshold: the largest that keeps KEEP_GOOD of its good documents, and 0.5 at
    most. Labels that are null are skipped; an id labelled twice takes its larger label; without labels every
    document scores 0.5 and is kept.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (fold_of(id_col) != 2))
    ids = sample_ids(known, id_col, rows)
    picked = F.broadcast(known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).join(F.broadcast(ids), "id").groupBy("id").agg(F.max("y").alias("y")))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").withColumn("fold", fold_of("id"))
    got = apply_texts(sample, "text", _measure, f"{_BASE_DDL}, x array<double>", ["id", "y", "fold"]).select("row.*", "out.x").toArrow().sort_by("id")
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()))
    x = np.array(got["x"].to_pylist())
    y, fold = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    forest = fit(x[fold != 0], y[fold != 0], list(FEATURES.values()))
    good = np.sort(forest.score(x[(fold == 0) & (y == 1)]))
    forest.threshold = min(0.5, float(good[int((1 - KEEP_GOOD) * len(good))])) if len(good) else 0.0
    return forest


def rate(docs: DataFrame, forest: Forest, carry: list[str], text_col: str = "text") -> DataFrame:
    """Struct ``row`` of the carried columns and struct ``out``: the base counts, base_failed, score and kept.

    Null and empty texts have no words, so they fail the base rule.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def fn(texts):
        res = _measure(texts)
        score = model.value.score(np.array(res["x"]).reshape(len(texts), -1))
        failed = [b["n_words"] < MIN_WORDS or 100 * b["n_repeat_words"] > MAX_REPEAT_PERCENT * b["n_words"] for b in res["base"]]
        return {"base": res["base"], "score": score.tolist(), "base_failed": failed, "kept": [not f and bool(s >= model.value.threshold) for f, s in zip(failed, score)]}

    return apply_texts(docs, text_col, fn, f"{_BASE_DDL}, base_failed boolean, score double, kept boolean", carry)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the base counts, base_failed, kept and the forest's score; repeated rows each get their row."""
    rated = rate(docs, train(docs, labels, id_col, text_col), [id_col], text_col)
    return rated.select(F.col(f"row.`{id_col}`").alias(id_col), "out.base.*", "out.base_failed", "out.kept", "out.score")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    return rate(docs, train(docs, labels, id_col, text_col), docs.columns, text_col).filter("out.kept").select("row.*")
