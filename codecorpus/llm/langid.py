"""Language ID: expectation-maximisation of each document's language proportions from trigram likelihoods."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import apply_texts, fold_of, sample_ids

#: Documents with a known language that the trigram tables are counted from, at most.
TRAIN_ROWS = 20_000
#: Trigrams are hashed to this many buckets.
BUCKETS = 1 << 16
#: Steps of expectation-maximisation, and the penalty for one more language, as in the Bayesian information criterion.
STEPS = 12
PENALTY = 0.5

_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a text in lower case, runs of other characters than letters as one space."""
    codes = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


class LanguageModel:
    """Log-likelihood of every bucket in every language, and the mixture inference."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        p = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS) if len(names) else counts
        self.logp = np.log(p).T.astype(np.float64).copy()  # bucket, language

    def infer(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        """(language, its proportion, all chosen languages with their proportions); ``und`` without letters or without a model."""
        if not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, []
        count = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(count)
        if not len(at):
            return "und", 0.0, []
        n, lp = count[at].astype(float), self.logp[at]
        single = n @ lp
        everything = self._mixture(n, lp)[0]
        ranked = sorted(range(len(self.names)), key=lambda k: (-everything[k], -single[k], self.names[k]))
        ranked.remove(lead := int(np.argmax(single)))
        chosen, share = [lead], np.ones(1)
        cost = PENALTY * np.log(max(n.sum(), 2.0))
        best = single[lead] - cost
        for k in ranked:
            if everything[k] < 0.01:
                break
            pi, ll = self._mixture(n, lp[:, [*chosen, k]])
            if ll - cost * (len(chosen) + 1) <= best:
                break
            chosen, share, best = [*chosen, k], pi, ll - cost * (len(chosen) + 1)
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], self.names[chosen[i]]))
        found = [(self.names[chosen[i]], float(share[i])) for i in order]
        return found[0][0], found[0][1], found

    @staticmethod
    def _mixture(n: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood after STEPS steps."""
        top = lp.max(axis=1, keepdims=True)
        like = np.exp(lp - top)
        pi = np.full(lp.shape[1], 1 / lp.shape[1])
        for _ in range(STEPS):
            pi = pi * (like.T @ (n / (like @ pi))) / n.sum()
        return pi, float(n @ (np.log(like @ pi + 1e-300) + top[:, 0]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Count trigrams by language over at most ``rows`` documents with a language, outside crc32 fold 2.

    The counts are summed by Spark; what comes back is one number for each language and bucket.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & (fold_of(id_col) != 2))
    ids = sample_ids(known, id_col, rows)
    sample = known.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "id").select("text", "lang")

    def fn(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if text:
                    sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    sums[lang] += np.bincount(grams(text.decode()), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "k", "n"])

    got = sample.mapInArrow(fn, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    langs = got["lang"].to_pylist()
    names = sorted(set(langs))
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS))
    if names:
        counts[np.array([place[x] for x in langs]), got["k"].to_numpy()] = got["n"].to_numpy()
    return LanguageModel(names, counts)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: held_out, lang_pred, score (its proportion), and languages (all chosen, by proportion, as name:share).

    Null texts and texts without a letter are ``und`` with score 0. A null id has a null held_out. Repeated rows each get
    a row; languages of equal likelihood go by name; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))

    def fn(texts):
        res = [model.value.infer(t.decode() if t else "") for t in texts]
        return {"lang_pred": [r[0] for r in res], "score": [min(1.0, r[1]) for r in res], "languages": [",".join(f"{k}:{v:.3f}" for k, v in r[2]) for r in res]}

    found = apply_texts(docs, text_col, fn, "lang_pred string, score double, languages string", [id_col])
    return found.select(F.col(f"row.`{id_col}`").alias(id_col), (fold_of(f"row.`{id_col}`") == 2).alias("held_out"), "out.*")
