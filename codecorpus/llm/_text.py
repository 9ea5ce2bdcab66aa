"""Shared helpers: texts through Arrow batches, stored intermediate tables, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text handed to a function at once; a longer text comes alone.
CHUNK_BYTES = 4 << 20
#: Rows of an Arrow batch: with texts of some kilobytes, a task's Python worker then holds a few megabytes at a time.
BATCH_ROWS = 1_000

#: Byte tables for bytes.translate: words between white space, and words of letters, digits and non-ASCII.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER_TABLE = _LOWER
ALNUM_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; none for null."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    return text.translate(ALNUM_TABLE).split() if text else []


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about CHUNK_BYTES of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    if not len(sizes):
        return
    part = np.cumsum(sizes, dtype=np.int64) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def apply_texts(df: DataFrame, text: str, fn: Callable[[list[bytes | None]], dict], fields: str, carry: list[str]) -> DataFrame:
    """Run ``fn`` over the whole texts of ``df``; returns the ``carry`` columns as struct ``row`` and the results as struct ``out``.

    ``fn`` takes a list of UTF-8 texts (None for null) and returns one list for each field of the DDL ``fields``.
    Columns travel inside a struct, so no extra column can clash with a result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    src = df.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(text).cast("binary").alias("text"))
    out_type = T.StructType.fromDDL(fields)
    schema = T.StructType([src.schema["row"], T.StructField("out", out_type)])
    out_fields = list(to_arrow_schema(out_type))

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, "text"):
                res = fn(piece.column("text").to_pylist())
                arrays = [pa.array(res[f.name], type=f.type, from_pandas=False) for f in out_fields]
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.StructArray.from_arrays(arrays, fields=out_fields)], names=["row", "out"])

    return src.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where a session of one machine names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by the columns ``by``, and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(id_col: str):
    """crc32 of the id as text, modulo 4; rows with 2 are held out. Null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def sample_ids(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct ids, those with the smallest xxhash64: the same for every layout of the rows."""
    ids = df.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).distinct()
    ids = ids.select("id", (F.xxhash64("id").bitwiseAND(F.lit((1 << 62) - 1))).alias("h"))
    total = ids.count()
    if total > 2 * bound:
        ids = ids.filter(F.col("h") < F.lit(int((1 << 62) * min(1.0, 1.2 * bound / total))))
    return ids.orderBy("h", "id").limit(bound).select("id")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected ``edges(a, b)`` as ``(node, component)``, the smallest node being the component.

    Alternates large-star and small-star steps; every step is an aggregation and a join, and its result is stored.
    Nodes without an edge to another node are absent.
    """
    cur = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = None
    while True:
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == mark or not now.n:
            break
        mark = (now.n, now.s)
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        cur = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "edges")
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
