"""How far the sources of a language diverge: smoothed term shares compared by count-level bitmaps.

Each (language, source) group has, for each count, a bitset of the terms that occur so often in it. A pair of groups has
as many terms with the counts (a, b) as popcount(bitset a AND bitset b) says; each such joint cell times the difference
of the two shares gives the pair's divergence. Count 0 has no stored bitset: it is the complement of the others.

Everything is exact integer arithmetic. Null text, language and source are ''; texts without terms still make their
group; rows that repeat an id are documents of their own; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.llm._text import BATCH_ROWS, _LOWER, chunks, stored

#: A term is kept in a language if this many of its documents have it.
MIN_DOCS = 30
#: Shares are integers of this scale, smoothed by so many counts for each kept term.
SCALE, SMOOTH = 1_000_000_000, 5
TOP_TERMS = 50
#: Words of 64 terms that one task compares at once, and groups of a language that meet in one tile.
SHARD_WORDS, TILE = 8, 64
#: Different (group, term) entries that a task counts before it hands them on.
HELD = 400_000

#: A-Z lower-cased, other ASCII but a-z a space: what is left are terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
TERM_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text; none for null."""
    return text.translate(TERM_TABLE).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each group, plus a null term for each group that occurs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(docs.sparkSession.conf.get(key)) > BATCH_ROWS:
        docs.sparkSession.conf.set(key, str(BATCH_ROWS))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))

    def run(batches):
        held: dict = defaultdict(lambda: (Counter(), Counter()))

        def rows():
            for (lang, source), (n, df) in held.items():
                terms = [*n, None]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(terms), pa.string()),
                    "source": pa.array([source] * len(terms), pa.string()),
                    "term": pa.array(terms, pa.binary()).cast(pa.string()),
                    "n": pa.array([*n.values(), 0], pa.int64()),
                    "docs": pa.array([*(df[t] for t in n), 0], pa.int64()),
                })
            held.clear()

        for batch in batches:
            for piece in chunks(batch, "text"):
                for lang, source, text in zip(*(piece.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    n, df = held[lang, source]
                    n.update(words := terms_of(text))
                    df.update(set(words))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from rows()
        yield from rows()

    counted = src.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, size, kept):
    """1 + floor(SCALE * (n + SMOOTH) / (size + SMOOTH * kept)), without overflow."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (wide(n) + F.lit(SMOOTH)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", top, wide(size) + wide(kept) * F.lit(SMOOTH)) + 1)


def _words(at):
    """One 64-bit set for each word of a shard, of the rows' bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(at) % 64).cast("int"))
    return [F.coalesce(F.bit_or(F.when(F.floor(F.col(at) / 64) == i, bit)), F.lit(0).cast("long")).alias(f"w{i}") for i in range(SHARD_WORDS)]


def _layout(part: pa.Table):
    """Of each source of a shard, its levels by word: bitsets and shares ``(source, masks[word, level], shares[word, level])``.

    The row of count 0 holds the shard's terms; what the other levels leave of them is its bitset.
    """
    names = part.column("source").to_pylist()
    count = part.column("n").to_numpy()
    share_ = part.column("p").to_numpy()
    words = np.stack([part.column(f"w{i}").to_numpy() for i in range(SHARD_WORDS)], axis=1).view(np.uint64)
    rows = defaultdict(list)
    for i, name in enumerate(names):
        rows[name].append(i)
    out = []
    for name, at in rows.items():
        at = np.array(at)
        masks, p = words[at], share_[at]
        zero = count[at] == 0
        masks[zero] &= ~np.bitwise_or.reduce(masks[~zero], axis=0) if (~zero).any() else ~np.uint64(0)
        used = masks != 0
        width = int(used.sum(axis=0).max())
        m = np.zeros((SHARD_WORDS, width), np.uint64)
        q = np.zeros((SHARD_WORDS, width), np.int64)
        for w in range(SHARD_WORDS):
            k = int(used[:, w].sum())
            m[w, :k], q[w, :k] = masks[used[:, w], w], p[used[:, w]]
        out.append((name, m, q))
    return out


def _tile(keys, part):
    """The divergence of each pair of groups of a tile within one shard of terms."""
    lang, _, low, high = (k.as_py() for k in keys)
    mine = dict(zip(part.column("source").to_pylist(), part.column("tile").to_pylist()))
    groups = _layout(part)
    a, b, value = [], [], []
    for i, (x, mx, px) in enumerate(groups):
        for y, my, py in groups[i + 1 :]:
            if low != high and mine[x] == mine[y]:
                continue  # they meet in a tile of their own
            cells = np.bitwise_count(mx[:, :, None] & my[:, None, :]).astype(np.int64)
            a.append(min(x, y))
            b.append(max(x, y))
            value.append(int((cells * np.abs(px[:, :, None] - py[:, None, :])).sum()))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


class Audit:
    """The stored tables of an audit: ``terms``, ``cells`` (a group's kept terms) and ``groups``."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        counts = stored(term_counts(docs), "term-counts")
        kept = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= min_docs)
        # frequent terms side by side, so that most shards have few levels; an id is a place in the sorted table
        kept = kept.orderBy("lang", F.desc("docs"), "term").withColumn("at", F.monotonically_increasing_id())
        size = SHARD_WORDS * 64
        self.terms = stored(kept.select("lang", "term", "total", F.floor(F.col("at") / size).alias("shard"), (F.col("at") % size).cast("int").alias("bit")), "kept-terms")
        self.cells = stored(counts.filter(F.col("term").isNotNull()).select("lang", "source", "term", "n").join(self.terms, ["lang", "term"]), "cells")
        sizes = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        langs = self.terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
        groups = counts.filter(F.col("term").isNull()).select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "kept", "lang_size"])
        many = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        groups = groups.join(many, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
        self.groups = stored(groups.withColumn("zero", share(F.lit(0), F.col("size"), F.col("kept"))), "groups")

    def levels(self) -> DataFrame:
        """The count-level bitmaps ``(lang, shard, source, tile, tiles, n, p, w0..w7)``; the row of count 0 holds all the shard's terms."""
        of = self.groups.select("lang", "source", "size", "kept", "tile", "tiles", "zero")
        high = self.cells.groupBy("lang", "shard", "source", "n").agg(*_words("bit")).join(of.drop("zero"), ["lang", "source"])
        high = high.withColumn("p", share(F.col("n"), F.col("size"), F.col("kept")))
        zero = self.terms.groupBy("lang", "shard").agg(*_words("bit")).join(of, "lang").withColumns({"n": F.lit(0).cast("long"), "p": F.col("zero")})
        cols = ["lang", "shard", "source", "tile", "tiles", "n", "p", *(f"w{i}" for i in range(SHARD_WORDS))]
        return high.select(cols).unionByName(zero.select(cols))

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value)`` of every two sources of a language, both ways."""
        tiled = self.levels().withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles")
        part = tiled.groupBy("lang", "shard", "low", "high").applyInArrow(_tile, "lang string, a string, b string, value long")
        value = part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        value = value.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")
        one = self.groups.select("lang", "source")
        every = one.join(one.withColumnRenamed("source", "item"), "lang").filter("source <> item")
        return every.join(value, ["lang", "source", "item"], "left").na.fill(0, ["value"])

    def top_terms(self, most: int = TOP_TERMS) -> DataFrame:
        """``(lang, source, item, value, rank)``: the terms with the largest share above the language's own, at most ``most`` a group."""
        of = self.groups.select("lang", "source", "size", "kept", "lang_size")
        p, q = share(F.col("n"), F.col("size"), F.col("kept")), share(F.col("total"), F.col("lang_size"), F.col("kept"))
        over = self.cells.join(of, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
        return _ranked(over).filter(F.col("rank") <= most)


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def report(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergences between sources (``pair``, all) and each group's 50 terms furthest above its language (``term``)."""
    found = Audit(docs)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    pairs = _ranked(found.pairs()).withColumn("part", F.lit("pair")).select(cols)
    return pairs.unionByName(found.top_terms().withColumn("part", F.lit("term")).select(cols))


def brute_force(rows: list[tuple], min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> set[tuple]:
    """The report's rows for a small list of ``(text, lang, source)``, by definition."""
    count, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.decode() for w in terms_of((text or "").encode())]
        count[lang, source].update(words)
        df[lang].update(set(words))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + SCALE * (c[t] + SMOOTH) // (size + SMOOTH * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])}
    return out
