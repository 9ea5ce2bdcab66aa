"""N-gram Jaccard join: exact set similarity by prefix lists, with set relations to skip work.

Documents with one and the same shingle set are one set. Sets meet in the lists of their prefix shingles. A list is
kept by blocks of set size: blocks that can't reach the similarity are never read together, and places in the two sets
that can't are skipped. In a long list, a set is first compared with one set of its block only, its hub; after those
answers are joined to components, a list is read again only for sets of different components and hubs. The answers of
sets of one hub are derived from what each differs in from it, so a group of near copies never meets in pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.llm._text import LOWER_TABLE, apply_texts, connected_components, stored

SHINGLE = 5
#: Similarity in per cent.
SIMILAR = 80
#: Lists up to this length are compared in full at once.
SHORT = 8
#: Meetings with a hub in long lists that make it worth a first try, besides the hub that a set meets most and the most
#: central one that it meets; other pairs come in the second round.
STAR = 3
#: One document in so many shows which shingles are frequent; they go last in every set's order. This steers only how
#: long the lists get: any order gives the same links. FREQUENT bounds how many shingles are sent to the tasks.
SHOW, SEEN, FREQUENT = 16, 4, 1_000_000
#: Size of the filter of ids that spares the second pass over texts.
ID_BITS = 16_777_213
#: Bytes of text whose words are hashed at once; short texts go together up to this, a longer one goes by pieces.
PIECE = 1 << 18

_R = np.random.default_rng(5)
_BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.frombuffer(LOWER_TABLE, dtype=np.uint8)
_P = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``data``, which ends with white space; made by pieces, as this takes some 35 bytes for each of text."""
    firsts, hashes, a = [], [], 0
    while a < len(data):
        b = _GAP.search(data, min(a + PIECE, len(data)) - 1).end()
        raw = np.frombuffer(data, dtype=np.uint8, count=b - a, offset=a)
        inside = ~_SPACE[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        first = np.flatnonzero(edge == 1)
        if len(first):
            lengths = np.flatnonzero(edge == -1) - first
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
            power = np.multiply.accumulate(np.full(int(lengths.max()), _P))
            words = np.add.reduceat(_BYTE[_LOWER[raw[inside]]] * power[place], starts)
            firsts.append(first + a)
            hashes.append(_scramble(words + lengths.astype(np.uint64)))
        a = b
    return (np.concatenate(firsts), np.concatenate(hashes)) if firsts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; a text of fewer words has one shingle, no words none."""
    group = np.cumsum([len(t or b"") for t in texts], dtype=np.int64) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)]
    return [s for a, b in zip(cuts, cuts[1:]) for s in _sets(texts[a:b], size)]


def _sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """shingle_sets of texts that are few or short enough to be held at once."""
    out = [np.zeros(0, dtype=np.int64)] * len(texts)
    live = [i for i, t in enumerate(texts) if t]
    first, words = _word_hashes(b"".join(texts[i] + b"\n" for i in live))
    if not len(words):
        return out
    ends = np.cumsum([len(texts[i]) + 1 for i in live])
    bounds = np.searchsorted(first, ends, "left")  # words before the end of each text
    rolled = np.zeros(len(words), dtype=np.uint64)
    for k in range(min(size, len(words))):
        rolled[: len(words) - k] = rolled[: len(words) - k] * _P + words[k:]
    rolled = _scramble(rolled).view(np.int64)
    a = 0
    for i, b in zip(live, bounds):
        n = b - a
        if n >= size:
            out[i] = np.unique(rolled[a : b - size + 1])
        elif n:
            h = np.full(1, n, dtype=np.uint64)
            for w in words[a:b]:
                h = h * _P + w
            out[i] = _scramble(h + np.uint64(1)).view(np.int64)
        a = b
    return out


def overlap_needed(n, m, similar: int = SIMILAR):
    """Least intersection of sets of n and m with 100 * intersection >= similar * union."""
    return -(-similar * (n + m) // (100 + similar))


#: A pair of similar sets must share one more of its first shingles for this many of the smaller set's.
STEP = 40


def matches_needed(n):
    """First shingles that a set of n shares with any similar set of n or more, at least."""
    return 1 + n // STEP


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    """First shingles of a set of n to look at, so that similar sets share matches_needed of them."""
    return min(n, n - -(-similar * n // 100) + matches_needed(n))


def _digest(s: np.ndarray) -> tuple[int, int]:
    h = _scramble(s.view(np.uint64) + _P)
    return int(np.bitwise_xor.reduce(h).view(np.int64)), int(np.add.reduce(_scramble(h * _P), dtype=np.uint64).view(np.int64))


def _prefixes(frequent, similar):
    def fn(texts):
        hot = frequent.value
        out = {k: [] for k in ("n", "d1", "d2", "prefix")}
        for s in shingle_sets(texts):
            n = len(s)
            d1, d2 = _digest(s) if n else (0, 0)
            p = prefix_length(n, similar) if n else 0
            if n and len(hot):
                at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                late = hot[at] == s
                s = np.concatenate([s[~late], s[late]])
            out["n"].append(n)
            out["d1"].append(d1)
            out["d2"].append(d2)
            out["prefix"].append(s[:p])
        return out

    return fn


def _candidates(similar):
    """Rows (token, n, rep, pos) in order of token, n, rep -> rows of lists of two or more sets.

    A short list gives its pairs (a, b, sizes, places; token null) that may be similar; a long one gives its rows (b null).
    """
    names = ["a", "b", "token", "n", "pos", "n_b", "pos_b"]

    def of_list(token, n, rep, pos, pairs, rows):
        if len(n) > SHORT:
            rows.append((rep, np.full(len(n), token), n, pos))
            return
        x, y = np.triu_indices(len(n), 1)
        most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x] - 1, n[y] - pos[y] - 1)
        ok = (100 * n[x] >= similar * n[y]) & (most >= overlap_needed(n[x], n[y], similar)) & (rep[x] != rep[y])
        x, y = x[ok], y[ok]
        swap = rep[x] > rep[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pairs.append((rep[x], rep[y], n[x], pos[x], n[y], pos[y]))

    def fn(batches):
        held: list = []
        for b in batches:
            cols = [b.column(k).to_numpy() for k in ("token", "n", "rep", "pos")]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            tokens = cols[0]
            if not len(tokens):
                continue
            cut = int(np.searchsorted(tokens, tokens[-1], "left"))  # the last list may go on
            if not cut and len(tokens) > 1 << 18:  # it is long: its rows go out as they come, but for a few that keep it long
                cut = len(tokens) - 2 * SHORT
            yield from flush([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held:
            yield from flush(held)

    def flush(cols):
        tokens, n, rep, pos = cols
        if not len(tokens):
            return
        first = np.concatenate(([0], np.flatnonzero(np.diff(tokens)) + 1))
        last = np.append(first[1:], len(tokens))
        pairs: list[tuple] = []
        rows: list[tuple] = []
        for a, b in zip(first[last - first > 1], last[last - first > 1]):
            of_list(tokens[a], n[a:b].astype(np.int64), rep[a:b], pos[a:b].astype(np.int64), pairs, rows)
        i32 = lambda v: pa.array(v.astype(np.int32))
        for part in (pairs[k : k + 20_000] for k in range(0, len(pairs), 20_000)):
            a, b, na, ia, nb, ib = map(np.concatenate, zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), i32(na), i32(ia), i32(nb), i32(ib)], names=names)
        for part in (rows[k : k + 5_000] for k in range(0, len(rows), 5_000)):
            a, token, na, ia = map(np.concatenate, zip(*part))
            none = pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(token), i32(na), i32(ia), none, none], names=names)

    return fn


def _id_filter(ids: DataFrame) -> np.ndarray:
    """One bit for each id modulo ID_BITS: 2 MB at any size of the data. Others pass too; a join decides."""
    bit = F.pmod(F.col("id"), F.lit(ID_BITS))
    words = ids.select(F.floor(bit / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(ID_BITS // 32 + 1, dtype=np.uint32)
    bits[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    return bits


def _compared(pairs: DataFrame, docs: DataFrame, similar: int) -> DataFrame:
    """``pairs`` (a, b, star) with similar, n_a, n_b, i (intersection); sets are made anew from the texts of the documents in pairs only.

    Where b stands for a (star) and they share a quarter of their union, ``more`` has the shingles that only a has, ``less`` those that only b has.
    """
    pairs = stored(pairs, "tries")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(ids))

    def fn(batches):
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            place = ids % ID_BITS
            rows = np.flatnonzero((bits.value[place // 32] >> (place % 32).astype(np.uint32)) & np.uint32(1))
            if len(rows):
                for k in range(0, len(rows), 256):
                    part = b.take(pa.array(rows[k : k + 256]))
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shingle_sets(part.column("text").to_pylist()), pa.list_(pa.int64()))], names=["id", "tokens"])

    sets = docs.filter("id is not null").select("id", "text").mapInArrow(fn, "id long, tokens array<long>")
    half = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = half.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    made = both.select("a", "b", "star", F.size(F.array_intersect("ta", "tb")).alias("i"), F.size("ta").alias("n_a"), F.size("tb").alias("n_b"), "ta", "tb")
    union = F.col("n_a") + F.col("n_b") - F.col("i")
    like = F.col("star") & (4 * F.col("i") >= union)
    more, less = F.when(like, F.array_except("ta", "tb")), F.when(like, F.array_except("tb", "ta"))
    return stored(made.select("a", "b", "star", "i", "n_a", "n_b", (100 * F.col("i") >= similar * union).alias("similar"), more.alias("more"), less.alias("less")), "compared")


def _fit(n, m, e, f, similar: int):
    """Whether sets of n and m, of which only e and f shingles can be shared, may be similar."""
    small, large = F.least(n, m).cast("long"), F.greatest(n, m).cast("long")
    return (100 * small >= similar * large) & ((100 + similar) * F.least(e, f).cast("long") >= similar * (small + large))


def _counted(rows: DataFrame) -> DataFrame:
    """(a, b, n, k): how often each pair met; n is its smaller size."""
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").groupBy("a", "b", "n").agg(F.count("*").alias("k"))


def _starred(lists: DataFrame, similar: int) -> DataFrame:
    """Meetings (a, b, n, fit, central) of each set of a long list with one set of about its size, the most central one, and whether they may be similar.

    Central is a set that meets most others, summed over its lists: the original of near copies, or the least
    changed. It stands for its like: what it is similar to is answered by it and needn't meet the rest.
    """
    rows = lists.withColumn("band", _band("n", similar))
    lengths = rows.groupBy("token", "band").agg(F.count("*").alias("length"))
    central = rows.select("token", "band", "rep").join(lengths, ["token", "band"]).groupBy("rep").agg(F.sum("length").alias("met"))
    rows = stored(rows.join(central, "rep"), "central")
    best = rows.groupBy("token", "band").agg(F.max(F.struct("met", F.xxhash64("rep").alias("h"), "rep", "n", "e")).alias("p"))
    met = rows.join(best, ["token", "band"]).filter(F.col("rep") != F.col("p.rep"))
    return met.select(F.col("rep").alias("a"), F.col("p.rep").alias("b"), F.least("n", "p.n").alias("n"), _fit(F.col("n"), F.col("p.n"), F.col("e"), F.col("p.e"), similar).alias("fit"), F.col("p.met").alias("central"))


def _band(n, similar: int):
    """Block of a size: similar sets are in the same block or in neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / similar))).cast("int")


def _across(lists: DataFrame, comp: DataFrame, stars: DataFrame, similar: int) -> DataFrame:
    """Meetings (a, b, n) in long lists of sets of different components and hubs.

    A list is read by blocks of size: a row stands in its own block and in the next one, so rows of other sizes never
    meet. A block whose sets all have one component, or one hub, is left out: _derived has all pairs of a hub. In the
    others each set outside the block's largest such group meets the rest, where sizes and places let two be similar.
    """
    rows = lists.join(comp, lists["rep"] == comp["node"], "left").select("token", "n", "pos", "e", "rep", F.coalesce("component", "rep").alias("comp"))
    rows = rows.join(stars.select("rep", "hub"), "rep", "left").withColumns({"band": _band("n", similar), "hub": F.coalesce("hub", "rep")})
    rows = stored(rows.withColumn("block", F.explode(F.array(F.col("band"), F.col("band") + 1))), "lists")
    by, c = ["token", "block"], F.col
    groups = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("label")) for k in ("comp", "hub")])).alias("g"))
    groups = groups.groupBy(*by, "g").agg(F.count("*").alias("k"))
    mixed = groups.groupBy(*by).agg(F.max(F.struct("k", "g"))["g"].alias("top"), F.count_if(c("g.kind") == "comp").alias("comps"), F.count_if(c("g.kind") == "hub").alias("hubs")).filter("comps > 1 and hubs > 1")
    rows = rows.join(mixed.select(*by, "top"), by).withColumn("in_top", F.when(c("top.kind") == "comp", c("comp")).otherwise(c("hub")) == c("top.label"))
    own = ["n", "pos", "e", "rep", "comp", "hub", "band"]
    x = rows.filter("not in_top").select(*by, *[c(k).alias(f"x_{k}") for k in own])
    y = rows.select(*by, "in_top", *[c(k).alias(f"y_{k}") for k in own])
    once = (c("x_comp") != c("y_comp")) & (c("x_hub") != c("y_hub")) & (c("in_top") | (c("x_rep") < c("y_rep"))) & (c("block") == F.greatest("x_band", "y_band"))
    most = F.least("x_pos", "y_pos") + 1 + F.least(c("x_n") - c("x_pos"), c("y_n") - c("y_pos")) - 1
    met = x.join(y, by).filter(once & _fit(c("x_n"), c("y_n"), F.least("x_e", most), F.least("y_e", most), similar))
    return met.select(c("x_rep").alias("a"), c("y_rep").alias("b"), F.least("x_n", "y_n").alias("n"))


def _derived(stars: DataFrame, comp: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) of sets of different components that one set, their hub, stands for, from their answers with it alone.

    With hub size h, a = hub - less + more, w = 100 |less| + similar |more|, and k shared differences (both lack it, or
    both have it beside the hub), a and b are similar exactly where (100 + similar) k >= w_a + w_b - (100 - similar) h;
    a is similar to the hub exactly where w_a <= (100 - similar) h. So a pair of different components has a set that
    isn't, and must share differences: lists of these, rarest first, are read only as far as the rest of a set's own
    could still do. What a whole group differs in from its hub comes last and is hardly ever read.
    """
    c, full = F.col, 100 + similar
    w = 100 * F.size("less") + similar * F.size("more")
    s = stars.filter(F.size("less") + F.size("more") > 0).select("rep", "hub", "more", "less", w.cast("long").alias("w"), ((100 - similar) * c("n_hub")).cast("long").alias("room"))
    s = stored(s.join(comp, s["rep"] == comp["node"], "left").select(*s.columns, F.coalesce("component", "rep").alias("comp")), "differences")
    signed = F.concat(F.transform("less", lambda t: F.struct(F.lit(False).alias("has"), t.alias("token"))), F.transform("more", lambda t: F.struct(F.lit(True).alias("has"), t.alias("token"))))
    rows = s.select("hub", "rep", "comp", "w", "room", F.explode(signed).alias("d")).select("hub", "d.has", "d.token", "rep", "comp", "w", "room")
    by = ["hub", "has", "token"]
    known = rows.groupBy(*by).agg(F.count("*").alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select(*by, "k")
    mine = W.partitionBy("rep").orderBy(F.desc("k"), "has", "token")  # from the last one on: how many are left to share
    rows = rows.join(known, by).withColumn("left", F.row_number().over(mine))
    out = c("w") > c("room")
    rows = stored(rows.filter(full * c("left") >= F.when(out, c("w") - c("room")).otherwise(c("w") + 1)).withColumn("out", out), "difference-lists")
    x = rows.filter("out").select(*by, "room", *[c(k).alias(f"x_{k}") for k in ("rep", "comp", "w", "left")])
    y = rows.select(*by, *[c(k).alias(f"y_{k}") for k in ("rep", "comp", "w", "left", "out")])
    enough = full * F.least("x_left", "y_left") >= c("x_w") + c("y_w") - c("room")
    met = x.join(y, by).filter((c("x_comp") != c("y_comp")) & (~c("y_out") | (c("x_rep") < c("y_rep"))) & enough)
    met = met.select(c("x_rep").alias("a"), c("y_rep").alias("b")).distinct()
    end = lambda k: s.select(c("rep").alias(k), *[c(v).alias(f"{k}_{v}") for v in ("more", "less", "w")])
    both = met.join(end("a"), "a").join(end("b").join(s.select(c("rep").alias("b"), "room"), "b"), "b")
    shared = F.size(F.array_intersect("a_more", "b_more")) + F.size(F.array_intersect("a_less", "b_less"))
    return both.filter(full * shared >= c("a_w") + c("b_w") - c("room")).select("a", "b")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest id reachable by links, its own included.

    Ids are integers. Null or empty texts have no shingles and link with nothing. Rows with a null id are never
    linked and have a null component_id. Rows that repeat an id are one document; where their texts differ, each row
    keeps its own n_shingles and the component of all. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    shown = texts.filter(F.pmod(F.xxhash64("id"), F.lit(SHOW)) == 0)
    sets = apply_texts(shown, "text", lambda t: {"s": shingle_sets(t)}, "s array<long>", ["id"])
    hot = sets.select(F.explode("out.s").alias("token")).groupBy("token").count().filter(F.col("count") >= SEEN).orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(hot["token"].to_numpy()))
    made = apply_texts(texts, "text", _prefixes(frequent, similar), "n int, d1 long, d2 long, prefix array<long>", ["id"])
    made = stored(made.select("row.id", "out.*"), "prefixes")
    own = ["n", "d1", "d2"]
    sets_of = made.filter("n > 0 and id is not null")
    # documents with the set of another are links at once, and only the first one goes on; what is stored here lets the
    # join be dealt by itself, so that a large group of copies can be split
    reps = stored(sets_of.groupBy(*own).agg(F.min("id").alias("rep"), F.count("*").alias("k")).filter("k > 1").select(*own, "rep"), "copied-sets")
    same = stored(sets_of.select("id", *own).join(reps, own).filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "same")
    lone = sets_of.select("id", "n", "prefix").join(same.select(F.col("a").alias("id")), "id", "left_anti")
    rows = lone.select(F.col("id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "token"))
    sorted_rows = rows.select("token", "n", "rep", "pos").repartition("token").sortWithinPartitions("token", "n", "rep")
    found = stored(sorted_rows.mapInArrow(_candidates(similar), "a long, b long, token long, n int, pos int, n_b int, pos_b int"), "candidates")
    pairs = found.filter("b is not null").groupBy("a", "b", "n", "n_b").agg(F.count("*").alias("k"), F.min("pos").alias("pos"), F.min("pos_b").alias("pos_b"))
    pairs = stored(pairs, "met")
    # the shingles before the first one that a set shares with any other are its own: the rest, e, is all it can share
    shared = pairs.select("a", "n", "pos").unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n"), F.col("pos_b").alias("pos"))).unionByName(found.filter("b is null").select("a", "n", "pos"))
    able = shared.groupBy(F.col("a").alias("rep"), "n").agg((F.col("n") - F.min("pos")).alias("e")).filter(100 * F.col("e") >= similar * F.col("n"))
    able = stored(able.select("rep", "e"), "able")
    lists = found.filter("b is null").join(able, F.col("a") == F.col("rep")).select("token", "rep", "n", "pos", "e")
    lists = stored(lists, "long-lists")
    needed = 1 + F.floor(F.col("n") / STEP)
    ends = pairs.join(able.select(F.col("rep").alias("a"), F.col("e").alias("e_a")), "a").join(able.select(F.col("rep").alias("b"), F.col("e").alias("e_b")), "b")
    short = ends.filter(_fit(F.col("n"), F.col("n_b"), F.col("e_a"), F.col("e_b"), similar)).select("a", "b", F.least("n", "n_b").alias("n"), "k")
    short = stored(short, "short")
    star = _starred(lists, similar).groupBy("a", "b", "n").agg(F.count_if("fit").alias("k"), F.count("*").alias("met"), F.max("central").alias("central"))
    leads = lambda by: F.row_number().over(W.partitionBy("a").orderBy(F.desc(by), "b")) == 1
    star = star.withColumn("first", leads("met") | leads("central")).filter((F.col("first") & (F.col("met") >= STAR)) | (F.col("k") >= F.least(F.lit(STAR), needed)))
    tries = short.filter(F.col("k") >= needed).select("a", "b", F.lit(False).alias("star")).unionByName(star.select("a", "b", F.lit(True).alias("star")))
    compared = _compared(tries.groupBy("a", "b").agg(F.max("star").alias("star")), texts, similar)
    tried = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = compared.filter("similar").select("a", "b")
    first = stored(connected_components(links), "components")
    # the set that stands for each: the one that stands for most
    stars = compared.filter("more is not null")
    stars = stars.join(stars.groupBy("b").agg(F.count("*").alias("like")), "b").groupBy(F.col("a").alias("rep"))
    stars = stars.agg(F.max_by(F.struct(F.col("b").alias("hub"), F.col("n_b").alias("n_hub"), "more", "less"), F.struct("like", "i", "b")).alias("s")).select("rep", "s.*")
    none = F.array().cast("array<bigint>")
    hubs = stars.select(F.col("hub").alias("rep"), "n_hub").distinct().join(stars.select("rep"), "rep", "left_anti")
    stars = stored(stars.unionByName(hubs.select("rep", F.col("rep").alias("hub"), "n_hub", none.alias("more"), none.alias("less"))), "stars")
    links = links.unionByName(stored(_derived(stars, first, similar), "derived"))
    # what is left: sets of different components and hubs that met in long lists, often enough with the short ones
    more = _counted(_across(lists, first, stars, similar))
    more = more.join(short.select("a", "b", F.col("k").alias("s")), ["a", "b"], "left").filter(F.col("k") + F.coalesce("s", F.lit(0)) >= needed)
    more = stored(more.select("a", "b").join(tried, ["a", "b"], "left_anti").withColumn("star", F.lit(False)), "more")
    if not more.isEmpty():
        links = links.unionByName(_compared(more, texts, similar).filter("similar").select("a", "b"))
    comp = connected_components(links.unionByName(same))
    out = made.select("id", "n").join(comp, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, one for each id; rows with a null id stay. Columns as they were."""
    firsts = components(docs, id_col, text_col).filter(f"`{id_col}` = component_id").select(F.col(id_col).alias("kept_id")).distinct()
    keep = docs.join(firsts, docs[id_col].cast("long") == firsts["kept_id"], "left_semi").dropDuplicates([id_col])
    return keep.unionByName(docs.filter(F.col(id_col).isNull()))


def brute_force(texts: dict, similar: int = SIMILAR) -> dict:
    """id -> (n_shingles, component) by plain loops, for small tests."""
    sets = {}
    for k, t in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[k] = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} if len(words) >= SHINGLE else ({tuple(words)} if words else set())
    comp = {k: k for k in texts}
    ids = sorted(texts)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {k: (len(sets[k]), comp[k]) for k in texts}
