"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick after folding disguised letters."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import apply_texts, fold_of, sample_ids

#: Labelled documents that the lexicon and the weights are learned from, at most.
TRAIN_ROWS = 20_000
#: Lengths of word beginnings that may be terms.
PREFIXES = (4, 5, 6, 7)
#: A term stands in this many different contexts of toxic documents at least, and this many times likelier there.
MIN_SUPPORT = 4
MIN_RATIO = 12.0
#: A phrase with a term is an exception if it stands in this many clean documents and in no toxic one.
MIN_EXCEPTION = 3

#: Letters of other scripts and digits that stand for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}

_TABLE = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys("​‌‍﻿­"))
_SIGNS = re.compile(r"(?<=[^\W_])[$@!|](?=[^\W\d_])")
_SIGN = {"$": "s", "@": "a", "!": "i", "|": "l"}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, homoglyphs and digits as Latin letters, signs inside a word too, invisible characters gone."""
    text = text.lower()
    if not text.isascii() or any(d in text for d in "0134578"):
        text = text.translate(_TABLE)
    if "$" in text or "@" in text or "!" in text or "|" in text:
        text = _SIGNS.sub(lambda m: _SIGN[m[0]], text)
    return text


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall(fold(text.decode())) if text else []


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a star."""
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k]] if len(word) >= 3 else []


#: The link without anything learned: a constant, and nothing for hits.
NO_LINK = (-4.0, 1.0, 0.0, 0.0, 0.0)


class Lexicon:
    """Weights of terms and exception phrases in one Aho-Corasick automaton, and the link from hits to a probability."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coef=NO_LINK):
        self.weights, self.exceptions, self.coef = weights, exceptions, tuple(coef)
        self.automaton = ahocorasick.Automaton()
        for term, w in weights.items():
            self.automaton.add_word(" " + (term[:-1] if term.endswith("*") else term + " "), (len(term) - term.endswith("*"), w))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.coef)

    def measure(self, text: bytes | None) -> tuple[int, float, int, float]:
        """(words, weight of the hits, different words hit, greatest weight of one).

        A word counts with its heaviest term, and not inside an exception phrase. A word that repeats adds the
        logarithm of its count, so that a repeated line is no pile of evidence.
        """
        words = words_of(text)
        if not words or not len(self.automaton):
            return len(words), 0.0, 0, 0.0
        line = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        barred: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(line):
            if w:
                first = line.rfind(" ", 0, end) + 1 if line[end] != " " else end - size
                best[first] = max(w, best.get(first, 0.0))
            else:
                barred.append((end - size, end))
        if barred:  # ranges by their start, each with the furthest end so far
            barred.sort()
            begins, ends = [a for a, _ in barred], list(accumulate((b for _, b in barred), max))
            best = {p: w for p, w in best.items() if not ((i := bisect_right(begins, p)) and p < ends[i - 1])}
        counts: Counter = Counter()
        weight: dict[str, float] = {}
        for p, w in best.items():
            word = line[p : line.index(" ", p)]
            counts[word] += 1
            weight[word] = w
        return len(words), sum(w * (1 + float(np.log(counts[k]))) for k, w in weight.items()), len(weight), max(weight.values(), default=0.0)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return self.link(np.array([self.measure(t) for t in texts], dtype=float).reshape(-1, 4))

    def link(self, m: np.ndarray) -> np.ndarray:
        """Probability from hits and their weight per hundred words."""
        z = _inputs(m) @ np.array(self.coef)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _inputs(m: np.ndarray) -> np.ndarray:
    n, weight, hits, top = m[:, 0], m[:, 1], m[:, 2], m[:, 3]
    return np.stack([np.ones(len(m)), np.log1p(weight), np.log1p(100 * weight / np.maximum(n, 1)), np.log1p(np.maximum(hits - 1, 0)), top / 4], axis=1)


def _fit_link(m: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the effect of hits is not negative."""
    x, c = _inputs(m), np.array(NO_LINK)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (p - y) + 0.05 * np.array([0, *c[1:]])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[0.05] * (len(c) - 1)])
        c = c - 0.7 * np.linalg.solve(h, g)
        c[1:] = np.maximum(c[1:], 0)
    return tuple(float(v) for v in c)


def _term_counts(batches):
    """Document counts of terms, summed within a task: rows (term, y, n)."""
    sums: Counter = Counter()
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            for t in {t for w in set(words_of(text)) for t in terms_of(w)}:
                sums[t, y] += 1
        if len(sums) > 400_000:
            yield _as_batch(sums)
            sums = Counter()
    yield _as_batch(sums)


def _as_batch(sums):
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["term", "y", "n"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Lexicon:
    """Learn terms, exceptions and the link from at most ``rows`` labelled documents outside crc32 fold 2.

    Support is the number of different contexts (neighbour words) of a term, so copies of one document count once.
    Null labels are skipped; an id labelled twice takes its larger label; without toxic labels nothing is a term. Every
    term and every phrase that passes is kept; the bound on ``rows`` bounds them.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & (fold_of(id_col) != 2))
    ids = sample_ids(known, id_col, rows)
    picked = F.broadcast(known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).join(F.broadcast(ids), "id").groupBy("id").agg(F.max("y").alias("y")))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(picked, "id").select("id", "text", "y")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, [])
    by_term = sample.mapInArrow(_term_counts, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    ratio = ((F.col("a") + 0.5) / (pos + 1)) / ((F.col("b") + 0.5) / (neg + 1))
    likely = by_term.filter((F.col("a") >= MIN_SUPPORT) & (ratio >= MIN_RATIO))
    chosen = spark.sparkContext.broadcast(frozenset(r.term for r in likely.select("term").collect()))

    def contexts(texts):
        rows = []
        for t in texts:
            ws = ["", *words_of(t), ""]
            seen = {(term, ws[i - 1], ws[i + 1], ws[i]) for i in range(1, len(ws) - 1) for term in terms_of(ws[i]) if term in chosen.value}
            rows.append([dict(zip(("term", "before", "after", "word"), s)) for s in sorted(seen)])
        return {"c": rows}

    seen = apply_texts(sample, "text", contexts, "c array<struct<term:string,before:string,after:string,word:string>>", ["y"]).select("row.y", F.explode("out.c").alias("c")).select("y", "c.*")
    support = seen.groupBy("term", "y").agg(F.count_distinct("before", "after").alias("contexts"), F.count_distinct("word").alias("words")).collect()
    phrases = (
        seen.filter("term = word")
        .select("y", F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase"))
        .groupBy(F.trim("phrase").alias("phrase"))
        .agg(F.sum((F.col("y") == 0).cast("int")).alias("clean"), F.sum((F.col("y") == 1).cast("int")).alias("toxic"))
        .filter((F.col("clean") >= MIN_EXCEPTION) & (F.col("toxic") == 0) & F.col("phrase").contains(" "))
        .select("phrase")
        .collect()
    )
    a = {r.term: (r.contexts, r.words) for r in support if r.y == 1}
    b = {r.term: r.contexts for r in support if r.y == 0}
    weights: dict[str, float] = {}
    for term, (n, forms) in sorted(a.items(), key=lambda kv: (-kv[1][0], kv[0])):
        weight = float(np.log((n + 0.5) / (pos + 1)) - np.log((b.get(term, 0) + 0.5) / (neg + 1)))
        if n < MIN_SUPPORT or weight < np.log(MIN_RATIO):
            continue
        if term.endswith("*") and forms == 1:
            continue  # one word only: the word itself is the term
        weights[term] = weight
    touching = sorted(r.phrase for r in phrases if any(t in weights for w in r.phrase.split() for t in terms_of(w)))
    lexicon = Lexicon(weights, touching)
    model = spark.sparkContext.broadcast(lexicon)
    measured = apply_texts(sample, "text", lambda texts: {"m": [list(map(float, model.value.measure(t))) for t in texts]}, "m array<double>", ["id", "y"]).select("row.*", "out.m").toArrow().sort_by("id")
    return Lexicon(weights, lexicon.exceptions, _fit_link(np.array(measured["m"].to_pylist()), measured["y"].to_numpy().astype(float)))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document: held_out, score, predicted, and n_hits. Null and empty texts have no hits and the score of none.

    A null id has a null held_out. Repeated rows each get a row; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    def fn(texts):
        m = np.array([model.value.measure(t) for t in texts], dtype=float).reshape(-1, 4)
        return {"score": model.value.link(m).tolist(), "n_hits": m[:, 2].astype(int).tolist()}

    scored = apply_texts(docs, text_col, fn, "score double, n_hits long", [id_col])
    return scored.select(
        F.col(f"row.`{id_col}`").alias(id_col),
        (fold_of(f"row.`{id_col}`") == 2).alias("held_out"),
        "out.score",
        (F.col("out.score") >= threshold).cast("int").alias("predicted"),
        "out.n_hits",
    )
