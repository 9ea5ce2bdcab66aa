"""Benchmark decontamination by suffix arrays over shards of the training documents."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import ALNUM_TABLE, alnum_words, apply_texts

#: Words of a window.
WINDOW = 13
#: UTF-8 bytes of benchmark text searched at once; a larger benchmark is searched in as many blocks as it needs.
BLOCK_BYTES = 2 << 20


class TestSuffixes:
    """The suffixes of one block of test items, by the window that they begin with, sorted, with the places (item, word) they come from.

    Words are numbered from 1 by their order, 0 is no word of the block. A suffix is the big-endian
    numbers of its words, so byte order is the order of suffixes and a shorter item is a prefix.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        # an item without an id is known by its number, so that each is one of its own
        split = [(n if item is None else item, alnum_words(text)) for n, (item, text) in enumerate(items)]
        self.window = window
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        found: dict[bytes, set[tuple[str | int, int]]] = {}
        for item, ws in split:
            ids = np.array([self.vocab[w] for w in ws], dtype=">u4")
            size = min(window, len(ws))
            for i in range(len(ws) - size + 1 if ws else 0):
                found.setdefault(ids[i : i + size].tobytes(), set()).add((item, i))
        self.keys = sorted(found)
        self.places = [sorted(found[k], key=lambda p: (isinstance(p[0], int), *p)) for k in self.keys]
        self.lengths = np.array([len(k) // 4 for k in self.keys], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if self.keys else window
        self.low = np.array(self.keys, dtype=f"S{4 * window}")
        self.high = np.array([k + b"\xff" * (4 * window - len(k)) for k in self.keys], dtype=f"S{4 * window}")


def shard_matches(texts: list[bytes | None], tests: TestSuffixes) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Number of words of each text, and (text, first word, length, test suffix) of every occurrence in this shard.

    The shard's suffix array holds the suffixes that can match: those that begin a run of at least the
    shortest suffix's length of words known to the tests. Every test suffix is then binary-searched in it.
    """
    get = tests.vocab.get
    counts = np.zeros(len(texts), dtype=np.int64)
    parts = []
    for i, text in enumerate(texts):
        if text:
            words = text.translate(ALNUM_TABLE).split()
            counts[i] = len(words)
            parts.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
        parts.append(np.zeros(tests.window, dtype=np.int64))  # no suffix runs into the next text
    if not tests.keys or not counts.any():
        return counts, []
    ids = np.concatenate(parts)
    gaps = np.flatnonzero(ids == 0)
    starts = np.flatnonzero(ids)
    starts = starts[gaps[np.searchsorted(gaps, starts)] - starts >= tests.shortest]
    if not len(starts):
        return counts, []
    suffixes = np.empty((len(starts), tests.window), dtype=">u4")
    live = np.ones(len(starts), dtype=bool)
    for k in range(tests.window):
        word = ids[starts + k]
        live &= word > 0
        suffixes[:, k] = np.where(live, word, 0)
    keys = suffixes.view(f"S{4 * tests.window}").ravel()
    order = np.argsort(keys, kind="stable")
    array = keys[order]
    lo = np.searchsorted(array, tests.low, "left")
    hi = np.searchsorted(array, tests.high, "right")
    first_word = np.concatenate(([0], np.cumsum(counts + tests.window)))
    out = []
    for s in np.flatnonzero(hi > lo):
        places = starts[order[lo[s] : hi[s]]]
        docs = np.searchsorted(first_word, places, "right") - 1
        out += [(int(d), int(p - first_word[d]), int(tests.lengths[s]), int(s)) for d, p in zip(docs, places)]
    return counts, out


def longest_matches(found: list[tuple[int, int, int]], tests: TestSuffixes) -> list[tuple[str | None, int, int, int]]:
    """Longest verbatim matches (item, first word in the text, first word in the item, words) from one text's occurrences.

    A suffix that begins with the window at a place matches on as long as the next suffixes of the same item do at the
    next places.
    """
    runs: dict[tuple, list[tuple[int, int]]] = {}
    for first, length, s in found:
        for item, at in tests.places[s]:
            runs.setdefault((item, first - at), []).append((first, first + length))
    out = []
    for (item, shift), spans in runs.items():
        spans.sort()
        start, end, before = *spans[0], spans[0][0]
        for a, b in spans[1:]:
            if a > before + 1:
                out.append((item, start, start - shift, end - start))
                start = a
            before, end = a, b
        out.append((item, start, start - shift, end - start))
    return sorted(out, key=lambda m: (m[1], isinstance(m[0], int), m[0], m[2]))


def _scan(tests):
    def fn(texts):
        t = tests.value
        counts, found = shard_matches(texts, t)
        here: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for doc, first, length, s in found:
            here[doc].append((first, length, s))
        merged = [_merge([(a, a + n) for a, n, _ in x]) for x in here]
        longest = [longest_matches(x, t) if x else [] for x in here]
        items = [[None if isinstance(i, int) else i for i in sorted({m[0] for m in x}, key=lambda i: (isinstance(i, int), i))] for x in longest]
        whole = [[{"item": None if isinstance(i, int) else i, "first": a, "item_first": b, "words": n} for i, a, b, n in x] for x in longest]
        return {"n_words": counts.tolist(), "first": [[a for a, _ in m] for m in merged], "last": [[b for _, b in m] for m in merged], "items": items, "matches": whole}

    return fn


def _merge(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most about BLOCK_BYTES; each is read for itself."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Verbatim matches of ``benchmark`` items in ``docs``: struct ``row`` of the carried columns and struct ``out``.

    ``out`` has n_words, the disjoint hit ranges ``first``/``last`` (last exclusive, in words), the sorted ids of the
    items that occur (a null for each item without id, last), and ``matches``, the longest verbatim matches with the item,
    the places in text and item, and the words. Null or empty texts have no words and no match; items without words
    match nothing; an empty benchmark matches nothing; repeated rows each get their result.
    The benchmark is the stated query set: it goes to the tasks in blocks of bounded size, one pass after the other.
    """
    fields = "n_words long, first array<int>, last array<int>, items array<string>, matches array<struct<item:string,first:int,item_first:int,words:int>>"
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text)
    out = None
    for block in blocks:
        tests = spark.sparkContext.broadcast(TestSuffixes([(r.item, bytes(r.text)) for r in block.toLocalIterator()], window))
        if out is None:
            kept = carry if len(blocks) == 1 or text_col in carry else [*carry, text_col]
            out = apply_texts(docs, text_col, _scan(tests), fields, kept)
        else:  # the next block reads the same rows and joins its ranges to theirs
            src = out.select("row", F.col("out").alias("done"), F.col(f"row.`{text_col}`").alias("text"))
            both = apply_texts(src, "text", _scan(tests), fields, ["row", "done"])
            pair = lambda at: F.zip_with(f"{at}.first", f"{at}.last", lambda a, b: F.struct(a.alias("first"), b.alias("last")))
            ranges = F.array_sort(F.concat(pair("row.done"), pair("out")))
            zero = F.array().cast("array<struct<first:int,last:int>>")
            joined = F.aggregate(
                ranges,
                zero,
                lambda acc, r: F.when(
                    (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= r["first"]),
                    F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], r["last"]).alias("last")))),
                ).otherwise(F.concat(acc, F.array(r))),
            )
            named, nameless = lambda c: F.array_compact(c), lambda c: F.filter(c, lambda i: i.isNull())
            items = F.concat(F.array_sort(F.array_union(named("row.done.items"), named("out.items"))), nameless("row.done.items"), nameless("out.items"))
            out = both.select(
                F.col("row.row").alias("row"),
                F.struct(F.col("out.n_words").alias("n_words"), joined["first"].alias("first"), joined["last"].alias("last"), items.alias("items"), F.concat("row.done.matches", "out.matches").alias("matches")).alias("out"),
            )
    return out


def _verdict():
    hit = F.aggregate(F.zip_with("out.last", "out.first", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return hit, (hit > 0) & (20 * hit >= F.col("out.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words of the longest verbatim match, 0
    if none) and longest_item (its item; of several the first).

    An item without an id counts in n_items and has no part in items_sha256.
    """
    hit, bad = _verdict()
    m = matches(docs, benchmark, [id_col], text_col)
    best = F.get(F.array_sort(F.transform("out.matches", lambda x: F.struct((-x["words"]).alias("less"), x["item"].alias("item"), x["words"].alias("words")))), F.lit(0))
    return m.select(
        F.col(f"row.`{id_col}`").alias(id_col),
        "out.n_words",
        hit.alias("n_hit"),
        F.size("out.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("out.items", ","), 256).alias("items_sha256"),
        bad.alias("contaminated"),
        F.coalesce(best["words"].cast("long"), F.lit(0).cast("long")).alias("longest_match"),
        best["item"].alias("longest_item"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were.

    Rows with null or empty texts stay, as do repeated ones; columns of any name go through; an empty table stays empty.
    """
    _, bad = _verdict()
    return matches(docs, benchmark, docs.columns, text_col).filter(~bad).select("row.*")


def brute_force(texts: dict, items: dict | list[tuple], window: int = WINDOW) -> dict:
    """The same verdicts by plain loops, for small tests: id -> (n_words, n_hit, item ids, a None for each item without one)."""
    pairs = list(items.items() if isinstance(items, dict) else items)
    out = {}
    for key, text in texts.items():
        words = alnum_words(text.encode()) if text else []
        hit, seen = set(), set()
        for at, (item, t) in enumerate(pairs):
            ws = alnum_words(t.encode()) if t else []
            size = min(window, len(ws))
            for j in range(len(ws) - size + 1 if ws else 0):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == ws[j : j + size]:
                        hit.update(range(i, i + size))
                        seen.add((True, "", at) if item is None else (False, str(item), 0))
        out[key] = (len(words), len(hit), [None if none else i for none, i, _ in sorted(seen)])
    return out


def sha(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
