"""A durable index of parsed files: immutable segments, a manifest that is written last, tombstones, compaction.

A segment holds what one batch changed: ``keys`` (repo, path) of every file that it touches, and ``rows`` of those that are still there. The
manifest of a batch names the segments that count, oldest first; a row counts if no later segment has its file. A batch that
fails before its manifest is written leaves the state as it was, and one that runs again writes the same files. Readers
and writers see whole batches only: a manifest counts once its folder is committed.

A batch writes its own files' rows. Every COMPACT segments the live rows are written as one, and segments and manifests that the last
KEEP manifests (two at least: a batch may run again) don't name are deleted.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT, KEEP = 16, 8
FILE = ["repo", "path"]


class FileIndex:
    """The index in folder ``path`` for one version of the analyzer; what another version wrote is ignored, and replaced by the next batch."""

    def __init__(self, spark: SparkSession, path: str, analyzer_version: str = "1"):
        self.spark, self.path, self.version = spark, path.rstrip("/"), analyzer_version

    def _folder(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _numbers(self, name: str, committed: bool) -> list[int]:
        """Names below a folder, which are numbers; only those of committed writes if asked."""
        fs, where = self._folder(name)
        if not fs.exists(where):
            return []
        found = sorted((int(s.getPath().getName()) for s in fs.listStatus(where)), reverse=True)
        if not committed:
            return found
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{n}/_SUCCESS"))
        return [n for n in found if done(n)]

    def manifest(self, before: int | None = None) -> dict | None:
        """The last manifest (before a batch): number, version and segments; None without one of this version."""
        for n in self._numbers("manifests", committed=False):
            if before is not None and n >= before:
                continue
            fs, _ = self._folder("manifests")
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n}/_SUCCESS")):
                found = json.loads(self.spark.read.text(f"{self.path}/manifests/{n}").first()[0])
                return found if found["version"] == self.version else None
        return None

    def rows(self, before: int | None = None, roots: DataFrame | None = None) -> DataFrame | None:
        """The live rows; with ``roots`` (repo, root) only those that were read from that root. None where there is no index."""
        manifest = self.manifest(before)
        if manifest is None:
            return None
        read = lambda n, part: self.spark.read.parquet(f"{self.path}/segments/{n}/{part}")
        first, *later = manifest["segments"]
        out = read(first, "rows")
        if later:
            # keys of later batches are few next to the first segment; Spark broadcasts them if they are
            touched = reduce(DataFrame.unionByName, [read(n, "keys").select(*FILE, F.lit(n).alias("last")) for n in later]).groupBy(*FILE).agg(F.max("last").alias("last"))
            fresh = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(n, "rows").withColumn("segment", F.lit(n)) for n in later])
            fresh = fresh.join(touched, FILE).filter("segment = last").drop("segment", "last")
            out = out.join(touched.select(*FILE), FILE, "left_anti").unionByName(fresh, allowMissingColumns=True)
        return out if roots is None else out.join(roots.select("repo", "root").distinct(), ["repo", "root"], "left_semi")

    def commit(self, number: int, rows: DataFrame, touched: DataFrame, replace: bool = False) -> None:
        """Batch ``number``: every file of ``touched`` (repo, path) now has ``rows``, or none. With ``replace`` nothing else is left."""
        old = None if replace else self.manifest(number)
        rows.write.mode("overwrite").parquet(f"{self.path}/segments/{number}/rows")
        touched.select(*FILE).distinct().write.mode("overwrite").parquet(f"{self.path}/segments/{number}/keys")
        self._publish(number, [*(old["segments"] if old else []), number])
        if len(old["segments"] if old else []) + 1 >= COMPACT:
            self.compact(number)

    def compact(self, number: int) -> None:
        """Write the live rows after batch ``number`` as one segment, let its manifest name that alone, and delete what isn't named any more."""
        live = self.rows(number + 1)
        place = -number - 1  # beside the batches' own segments, so the manifest before this one stays whole
        live.write.mode("overwrite").parquet(f"{self.path}/segments/{place}/rows")
        self.spark.read.parquet(f"{self.path}/segments/{place}/rows").select(*FILE).distinct().write.mode("overwrite").parquet(f"{self.path}/segments/{place}/keys")
        self._publish(number, [place])
        self._clean()

    def _publish(self, number: int, segments: list[int]) -> None:
        text = json.dumps({"number": number, "version": self.version, "segments": segments})
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{number}")

    def _clean(self) -> None:
        fs, _ = self._folder("segments")
        numbers = self._numbers("manifests", committed=True)
        named = {s for n in numbers[: max(KEEP, 2)] for s in json.loads(self.spark.read.text(f"{self.path}/manifests/{n}").first()[0])["segments"]}
        newest = numbers[0] if numbers else -1
        old = [f"manifests/{n}" for n in numbers[max(KEEP, 2) :]]
        old += [f"segments/{s}" for s in self._numbers("segments", committed=False) if s not in named and (s if s >= 0 else -s - 1) <= newest]
        for name in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
