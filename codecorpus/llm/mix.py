"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.llm._text import stored

#: Weights of the sources in code-point order, repeating; nulls come last.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all words, and the most often that a source may be taken.
SHARE, CAP = 1.5, 2.0
#: Blocks of a source: its documents by a seeded hash. A source's cut runs through one block only, and within that
#: through one of as many parts.
BLOCKS = 4096
SHARDS = 16
SEED = 20


def size_of(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def _source_key(source):
    """The source as a join key in which null is a source of its own."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _block(id_col, size, seed: int):
    return F.pmod(F.xxhash64(id_col, size, F.lit(seed)), F.lit(BLOCKS)).cast("int")


def _part(id_col, size, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed + 4), id_col, size), F.lit(BLOCKS)).cast("int")


def targets(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row for each source key of ``sized(key, source, size)``: source_size and target.

    Sources share ``share`` of all words by weight; a target stops at ``cap`` times its source's size and the excess
    is shared again. Written as one level: with sources in order of cap / weight, those before the level are at
    their cap, and the others get level * weight. The windows run over one row for each source.
    """
    per = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = per.withColumn("weight", w).withColumn("top", cap * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    order = W.orderBy("ratio", "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level)
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(whole)["level"])
    return found.select("key", "source", "source_size", F.coalesce(F.least("top", F.col("level") * F.col("weight")), F.col("top")).alias("target"))


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of the part of a block that a source's cut runs through: in hash order, each that still fits."""
    pdf = pdf.sort_values(["h", "size", "id"], na_position="last", kind="stable")
    left, take = float(pdf["rest"].iloc[0]), []
    for words in pdf["words"].to_numpy():
        fits = 0 < words <= left
        take.append(fits)
        left -= words if fits else 0
    return pdf.loc[take, ["key", "block", "id", "size"]]


def split_tree(units: list[int], shards: int, seed: int) -> np.ndarray:
    """Units of each source for each shard: halves of the shards get a multivariate-hypergeometric draw of the units, and so on down."""
    r = np.random.default_rng(seed)
    out = np.zeros((shards, len(units)), dtype=np.int64)

    def share(counts, first, n):
        if n == 1:
            out[first] = counts
            return
        left = n // 2
        part = r.multivariate_hypergeometric(counts, int(counts.sum()) * left // n, method="marginals") if len(counts) and counts.sum() else counts
        share(part, first, left)
        share(counts - part, first + left, n - left)

    share(np.asarray(units, dtype=np.int64), 0, shards)
    return out


def _ranges(shards: int, seed: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        counts = split_tree(pdf["units"].tolist(), shards, seed)
        ends = counts.cumsum(axis=0)
        return pd.DataFrame({"key": np.repeat(pdf["key"].to_numpy(), shards), "shard": np.tile(np.arange(shards, dtype=np.int32), len(pdf)), "low": (ends - counts).T.ravel(), "high": ends.T.ravel()})

    return fn


class Mix:
    """The decisions of a mix over ``docs``: which documents are taken how often, and into which shard."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, shards: int = SHARDS, seed: int = SEED):
        self.docs, self.id_col, self.text_col, self.source_col, self.seed = docs, id_col, text_col, source_col, seed
        source = F.col(source_col)
        rows = docs.select(F.col(id_col).alias("id"), source.alias("source"), _source_key(source).alias("key"), size_of(F.col(text_col)).alias("size"))
        self.sized = stored(rows.withColumn("block", _block("id", F.col("size"), seed)), "mix-sizes")
        self.targets = stored(targets(self.sized, share, cap, weights), "mix-targets")
        blocks = self.sized.groupBy("key", "block").agg(F.sum("size").alias("words"))
        plan = self.targets.select(
            "key",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("base"),
            (F.col("target") - F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0) * F.col("source_size")).alias("extra"),
        )
        upto = F.sum("words").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
        state = blocks.withColumn("upto", upto).join(plan, "key")
        rest = F.col("extra") - (F.col("upto") - F.col("words"))
        state = state.select("key", "block", "base", F.when(F.col("upto") <= F.col("extra"), 1).otherwise(0).alias("full"), F.when((rest > 0) & (F.col("upto") > F.col("extra")), rest).alias("rest"))
        blocks = stored(state, "mix-edges")
        edge = self.sized.join(blocks.filter("rest is not null").select("key", "block", "rest"), ["key", "block"]).withColumn("part", _part("id", F.col("size"), seed))
        parts = edge.groupBy("key", "block", "rest", "part").agg(F.sum("size").alias("words"))
        parts = parts.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, 0))).filter("upto > rest")
        cut = parts.groupBy("key", "block").agg(F.min(F.struct("part", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("cut"))
        self.blocks = stored(blocks.join(cut.select("key", "block", F.col("cut.part").alias("cut_part"), F.col("cut.left").alias("left")), ["key", "block"], "left"), "mix-blocks")
        edge = edge.drop("rest").join(self.blocks.select("key", "block", F.col("cut_part").alias("part"), F.col("left").alias("rest")), ["key", "block", "part"])
        edge = edge.groupBy("key", "block", "id", "size").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("h", F.xxhash64("id", F.lit(seed + 1)))
        self.cut = stored(edge.groupBy("key").applyInPandas(_cut, "key string, block int, id long, size long"), "mix-cut")
        # every taken copy of a block is a unit; the tree says how many of a source's units each shard gets
        copies = self.blocks.withColumn("n", F.col("base") + F.when((F.col("full") == 1) | F.col("rest").isNotNull(), 1).otherwise(0)).filter("n > 0")
        units = copies.select("key", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
        units = units.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("block", "copy", F.lit(seed + 2)), "block", "copy")) - 1)
        ranges = units.groupBy("key").agg(F.count("*").alias("units")).groupBy(F.lit(1).alias("one")).applyInPandas(_ranges(shards, seed), "key string, shard int, low long, high long")
        self.units = units.join(ranges, "key").filter("rank >= low and rank < high").select("key", "block", "copy", "shard")

    def _extra(self, rows: DataFrame) -> DataFrame:
        """``rows(key, block, id, size, ..)`` with ``copies``, how often each is taken."""
        rows = rows.join(self.blocks.select("key", "block", "base", "full", "cut_part"), ["key", "block"], "left")
        cut = self.cut.select(F.col("key").alias("ck"), F.col("block").alias("cb"), F.col("id").alias("ci"), F.col("size").alias("cs"))
        on = (rows["key"] == cut["ck"]) & (rows["block"] == cut["cb"]) & rows["id"].eqNullSafe(cut["ci"]) & (rows["size"] == cut["cs"])
        rows = rows.join(cut, on, "left")
        before = F.coalesce(_part("id", F.col("size"), self.seed) < F.col("cut_part"), F.lit(False))
        copies = F.col("base") + F.col("full") + (before | F.col("ck").isNotNull()).cast("int")
        return rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).drop("ck", "cb", "ci", "cs")

    def report(self) -> DataFrame:
        """Per document: size, source_size, target, taken, copies, and shards, those of its copies in order: of what the tree has dealt."""
        got = self._extra(self.sized).join(self.targets.select("key", "source_size", "target"), "key").join(self._dealt(), ["key", "block"], "left")
        dealt = F.coalesce(F.slice("units", 1, F.col("copies")), F.array().cast("array<struct<copy:int,shard:int>>"))
        shards = F.array_join(F.transform(dealt, lambda u: u["shard"].cast("string")), ",")
        copies = F.size(dealt)
        return got.select(F.col("id").alias(self.id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), shards.alias("shards"))

    def _dealt(self) -> DataFrame:
        """The units (copy, shard) of each block, in order. Copies 0.. base-1 take whole blocks; the last only the documents that are in it."""
        return self.units.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("units"))

    def rows(self) -> DataFrame:
        """The mix: each taken document once for each copy, its columns as they were, with copy, shard and order_key.

        A shard's rows are in random order when sorted by order_key (a seeded hash), within the shard only. Where the
        documents have a column of such a name, theirs keeps it and the mix's is called mix_copy and so on.
        """
        d = self.docs.select(F.struct(*[F.col(c) for c in self.docs.columns]).alias("row"))
        field = lambda c: F.col(f"row.`{c}`")
        rows = d.select("row", field(self.id_col).alias("id"), _source_key(field(self.source_col)).alias("key"), size_of(field(self.text_col)).alias("size"))
        rows = self._extra(rows.withColumn("block", _block("id", F.col("size"), self.seed)))
        taken = rows.filter("copies > 0").join(self._dealt(), ["key", "block"])
        out = taken.select("row", "id", F.explode(F.slice("units", 1, F.col("copies"))).alias("unit"))
        own = lambda c: f"mix_{c}" if c in self.docs.columns else c
        return out.select("row.*", F.col("unit.copy").alias(own("copy")), F.col("unit.shard").alias(own("shard")), F.xxhash64("id", "unit.copy", F.lit(self.seed + 3)).alias(own("order_key")))


def mix(docs: DataFrame, **options) -> Mix:
    """Decide a mix of ``docs`` (see Mix).

    Null texts and texts without words have size 0 and are never taken; null sources are one source, last in order; rows that repeat an id
    and size are taken together or not at all; an empty table gives an empty mix. Reruns agree.
    """
    return Mix(docs, **options)
