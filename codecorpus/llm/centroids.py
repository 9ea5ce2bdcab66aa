"""Centroid clustering over a vector-approximation file: exact Lloyd rounds that open few full vectors.

The first round reads every vector. Then the table is written once with each vector's cells (BITS bits a dimension, packed)
beside the full vector. In a later round, tables of what a cell can add to the distance give an interval of distances
for each centroid. Where one interval lies before all others the cells alone decide; only vectors whose intervals
overlap, and those whose cluster has changed, are fetched in full. Sums follow from the changes: a vector leaves its old
cluster's sum and joins its new one's.

The table lies in blocks of like cluster and like distance to the next one, so a round reads the cells of all rows
(one narrow column) and opens the full vectors only of blocks in which a row needs them. What comes to the driver is a
row for each cluster or block.

A vector is kept if it has exactly ``dims`` components, none null or non-finite; component x becomes floor(1024 * x). A
component beyond +-2^26 is an error, since its distances don't fit a long. Vectors that repeat an id or another vector
count each; a null id is never one of the first centroids; with fewer ids than centroids there are as many clusters as ids
(none: no rows); empty clusters keep their centroid; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import stored

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Bits of a cell, steps of the distance to the next centroid that make a block, and the largest component.
BITS, STEPS, LIMIT = 8, 8, 1 << 26


def floored(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, full)`` of the vectors that are kept, as integers."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(math.inf), F.lit(False)) & ~F.isnan(v.cast("double")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fits = F.forall(whole, lambda v: v.between(-LIMIT, LIMIT))
    kept = vectors.filter((F.size(x) == dims) & finite).select(F.col(id_col).alias("vec_id"), whole.alias("full"), fits.alias("fits"))
    bad = F.raise_error(F.lit(f"a component of a vector is beyond {LIMIT}")).cast("array<int>")
    return kept.select("vec_id", F.when(F.col("fits"), F.col("full").cast("array<int>")).otherwise(bad).alias("full"))


def first_centroids(full: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``; equal ids by their components."""
    of = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = full.filter(F.col("vec_id").isNotNull()).select(of.alias("h"), "full").orderBy("h", "full").limit(clusters).collect()
    return [list(r.full) for r in rows]


def _matrix(column) -> np.ndarray:
    """Rows of a list column without nulls, as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.int64)


class Marks:
    """Where cells begin: ``at[d, j]`` is the least value of cell j of dimension d; cell j ends before ``at[d, j + 1]``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.bits = bits
        steps = np.arange((1 << bits) + 1, dtype=np.int64)
        self.at = low[:, None] + steps * (high - low + 1)[:, None] // (1 << bits)

    def pack(self, full: np.ndarray) -> list[bytes]:
        cells = np.stack([np.searchsorted(self.at[d], full[:, d], side="right") - 1 for d in range(full.shape[1])], axis=1).astype(np.uint8)
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [r.tobytes() for r in np.packbits(bits.reshape(len(full), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        dims = len(self.at)
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(rows, axis=1)[:, : dims * self.bits].reshape(len(packed), dims, self.bits)
        return bits @ (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)

    def decide(self, cells: np.ndarray, *sets: np.ndarray) -> list[np.ndarray]:
        """For each set of centroids, the nearest one of each row as far as its cells tell; -1 where intervals overlap.

        Distances are compared less the vector's own distance to a point amid the centroids, which is the same for all:
        of a component y and a centroid's e, both seen from there, e * e - 2 * e * y is left. Its ends over a cell are
        looked up; intervals are narrow where the centroids lie close together.
        """
        first, last = self.at[:, :-1], np.maximum(self.at[:, 1:] - 1, self.at[:, :-1])
        ends = []
        for centroids in sets:
            amid = centroids.sum(axis=0) // len(centroids)
            e = (centroids - amid)[None]
            x, y = (e * e - 2 * e * (to - amid[:, None]).T[:, None, :] for to in (first, last))
            ends += [np.minimum(x, y), np.maximum(x, y)]
        table = np.concatenate(ends, axis=1)  # [cell, end and centroid, dimension]
        total = np.zeros((len(cells), table.shape[1]), np.int64)
        for d in range(cells.shape[1]):
            total += np.ascontiguousarray(table[:, :, d])[cells[:, d]]
        out, rows, start = [], np.arange(len(cells)), 0
        for centroids in sets:
            k = len(centroids)
            least, most = total[:, start : start + k], total[:, start + k : start + 2 * k]
            start += 2 * k
            best = most.argmin(axis=1)
            top = most[rows, best][:, None]
            # of equal distances the smaller number wins, so a larger one may touch the interval's end
            beyond = np.where(np.arange(k)[None, :] > best[:, None], least >= top, least > top)
            beyond[rows, best] = True
            out.append(np.where(beyond.all(axis=1), best, -1))
        return out


def distances(full: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances ``[row, centroid]``."""
    return np.stack([((full - c) ** 2).sum(axis=1) for c in centroids], axis=1)


PARTS = "cluster long, part array<long>"


def _move(total: np.ndarray, x: np.ndarray, was: np.ndarray | None, now: np.ndarray) -> None:
    """Take the vectors from their old clusters' sums and counts, and add them to the new ones'."""
    x = np.hstack([x, np.ones((len(x), 1), np.int64)])
    np.add.at(total, now, x)
    if was is not None:
        np.subtract.at(total, was, x)


def _parts(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"cluster": np.arange(len(total)), "part": pa.array(list(total), pa.list_(pa.int64()))})


def _summed(parts: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The tasks' partial sums, added as decimals: a row for each cluster and dimension comes back."""
    out = np.zeros((len(centroids), centroids.shape[1] + 1), object)
    for r in parts.select("cluster", F.posexplode("part").alias("d", "v")).groupBy("cluster", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r.cluster, r.d] = int(r.v)
    return out


def first_sums(full: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """``[cluster, sums and count]`` of the first round, which needs every vector."""

    def run(batches):
        total = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("full"))
                _move(total, x, None, distances(x, centroids).argmin(axis=1))
        yield _parts(total)

    return _summed(full.select("full").mapInArrow(run, PARTS), centroids)


class VaFile:
    """The stored approximation file of ``vectors``, laid out around ``centroids``."""

    def __init__(self, full: DataFrame, centroids: np.ndarray, bits: int = BITS):
        def ends(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("full"))
                    yield pa.RecordBatch.from_pydict({"d": np.arange(x.shape[1]), "low": x.min(axis=0), "high": x.max(axis=0)})

        found = full.select("full").mapInArrow(ends, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
        self.marks = marks = Marks(np.array([r.low for r in found], np.int64), np.array([r.high for r in found], np.int64), bits)

        def lay(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("full"))
                    d = np.sqrt(distances(x, centroids).astype(np.float64))
                    two = np.partition(d, 1, axis=1) if d.shape[1] > 1 else np.hstack([d, d + 1])
                    near = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1)
                    step = np.clip(STEPS + np.floor(np.log2(np.maximum(near, 1e-9))).astype(np.int64), 0, STEPS - 1)  # a step is twice as far as the one before
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("full"), pa.array(marks.pack(x), pa.binary()), pa.array(d.argmin(axis=1) * STEPS + step, pa.int64())], names=["vec_id", "full", "cells", "block"])

        laid = full.mapInArrow(lay, f"vec_id {full.schema['vec_id'].dataType.simpleString()}, full array<int>, cells binary, block long")
        # a large block may be split over files and tasks
        self.rows = stored(laid.hint("rebalance", "block"), "va-file", "block")

    def changes(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """``[cluster, sums and count]``: what each cluster gains, and loses, as the centroids move from ``old`` to ``new``."""
        marks = self.marks

        def states(batch):
            was, now = marks.decide(marks.unpack(batch.column("cells").to_pylist()), old, new)
            return was, now, np.flatnonzero((was < 0) | (now < 0) | (was != now))

        def ask(batches):
            for batch in batches:
                need = states(batch)[2]
                yield pa.RecordBatch.from_pydict({"block": np.unique(np.asarray(batch.column("block"))[need]).astype(np.int64)})

        def change(batches):
            total = np.zeros((len(new), new.shape[1] + 1), np.int64)
            for batch in batches:
                was, now, at = states(batch)
                if len(at):
                    x = _matrix(batch.column("full").take(pa.array(at)))
                    now = np.where(now[at] < 0, distances(x, new).argmin(axis=1), now[at])
                    was = np.where(was[at] < 0, distances(x, old).argmin(axis=1), was[at])
                    _move(total, x, was, now)
            yield _parts(total)

        blocks = [r.block for r in self.rows.select("block", "cells").mapInArrow(ask, "block long").distinct().collect()]
        if not blocks:
            return np.zeros((len(new), new.shape[1] + 1), object)
        return _summed(self.rows.filter(F.col("block").isin(blocks)).select("cells", "full").mapInArrow(change, PARTS), new)

    def final(self, centroids: np.ndarray) -> DataFrame:
        """``(vec_id, cluster, distance)`` of every vector: the cells decide where they can, and the distance is the vector's own."""
        marks = self.marks

        def near(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                (now,) = marks.decide(marks.unpack(batch.column("cells").to_pylist()), centroids)
                x = _matrix(batch.column("full"))
                open_ = now < 0
                now[open_] = distances(x[open_], centroids).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(now, pa.int32()), pa.array(((x - centroids[now]) ** 2).sum(axis=1), pa.int64())], names=["vec_id", "cluster", "distance"])

        return self.rows.select("vec_id", "cells", "full").mapInArrow(near, f"vec_id {self.rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of each kept vector, and the final centroids."""
    full = floored(vectors, id_col, vector, dims, scale)
    start = first_centroids(full, clusters, seed)
    if not start:
        return full.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    now = np.array(start, np.int64)
    mean = lambda sums, last: np.array([s[:-1] // s[-1] if s[-1] else c for s, c in zip(sums, last)], np.int64)
    sums = first_sums(full, now) if rounds else None
    old, now = now, mean(sums, now) if rounds else now
    file = VaFile(full, now)
    for _ in range(rounds - 1):
        if (old == now).all():
            break  # further rounds change nothing
        sums = sums + file.changes(old, now)
        old, now = now, mean(sums, now)
    return file.final(now), now.tolist()


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector."""
    found, centroids = cluster(vectors)
    found = stored(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row for each cluster: at most CLUSTERS
    per = {r.cluster: r.cluster_inertia for r in sums.collect()}
    rows = [(c, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in per]
    of = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute_force(vectors: list[tuple], clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> list[tuple]:
    """The report of a small list of ``(vec_id, components)``, with Python's integers."""
    kept = [(i, [math.floor(SCALE * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{SEED}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in order[:clusters]]
    if not now:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(now))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(now)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                now[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    per = [sum(d for d, c in last if c == k) for k in range(len(now))]
    return [(i, c, d, per[c], sum(per), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, last)]
