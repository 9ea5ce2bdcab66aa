"""Substring de-duplication: content-defined chunks by a gear rolling hash, and the chunks that occur more than once."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codecorpus.llm._text import chunks, stored

#: Bits of a gear hash, and so the bytes that it depends on: two places of a passage are cut alike from there on.
GEAR_WINDOW = 16
#: A chunk ends where the top bits of the hash are 0, after LEAST bytes and before MOST; the rest of a text shorter than LEAST stays with the chunk before it.
TOP_BITS, LEAST, MOST = 4, 16, 256

#: Bits of a digest that the filter goes by which says whose texts are compared.
SLOT_BITS = 26

_R = random.Random(2)
#: One number for each byte; 0 for NUL, so that what stands before a text doesn't count.
GEAR = np.array([0, *[_R.getrandbits(GEAR_WINDOW) for _ in range(255)]], dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] modulo 2^16 after each byte, by doubling the window that it covers."""
    h = GEAR[data]
    width = 1
    while width < GEAR_WINDOW:
        h[width:] += h[:-width] << np.uint16(width)
        width *= 2
    return h


def cut(texts: list[bytes | None], digest_bytes: int = 12) -> dict[str, list]:
    """The chunks of whole texts, one after the other: text (its place), k, start, end (code points), size, n, digest and body.

    The first chunk of a text has size, its code points, and n, its number of chunks; a text without any has one row
    of nulls. Chunks end between characters, so that the same passage has the same chunks wherever the first end in
    it is found.
    """
    out: dict[str, list] = {c: [] for c in ("text", "k", "start", "end", "size", "n", "digest", "body")}
    gap = b"\0" * GEAR_WINDOW
    data = np.frombuffer(gap.join([b"", *[t or b"" for t in texts], b""]), dtype=np.uint8)
    ends = np.flatnonzero(gear_hashes(data) >> np.uint16(GEAR_WINDOW - TOP_BITS) == 0) + 1
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    base = 0
    for i, t in enumerate(texts):
        base += GEAR_WINDOW
        size = len(t) if t else 0
        bounds = [0] if size else []
        for e in (ends[np.searchsorted(ends, base + 1) : np.searchsorted(ends, base + size)] - base).tolist() + [size] if size else []:
            while e - bounds[-1] > MOST:
                bounds.append(_whole(t, bounds[-1] + MOST))
            e = _whole(t, e)
            if e - bounds[-1] >= LEAST:
                bounds.append(e)
        if size and bounds[-1] != size:
            if len(bounds) > 1:
                bounds[-1] = size
            else:
                bounds.append(size)
        at = (chars[base + np.array(bounds, dtype=np.int64)] - chars[base]).tolist() if size else []
        n = max(1, len(bounds) - 1)
        out["text"] += [i] * n
        out["k"] += range(n)
        out["size"] += [at[-1] if size else 0, *[0] * (n - 1)]
        out["n"] += [n if size else 0, *[0] * (n - 1)]
        out["start"] += at[:-1] if size else [None]
        out["end"] += at[1:] if size else [None]
        bodies = [t[a:b] for a, b in zip(bounds, bounds[1:])] if size else [None]
        out["body"] += bodies
        out["digest"] += [hashlib.blake2b(b, digest_size=digest_bytes).digest() if b is not None else None for b in bodies]
        base += size
    return out


def _whole(text: bytes, at: int) -> int:
    """``at``, or the end of the character that it stands in."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _over_texts(docs: DataFrame, id_col: str, text_col: str, fields: str, fn) -> DataFrame:
    """``fn`` over the whole texts: its lists of the DDL ``fields``, with uid and id by the place in its list ``text``."""
    src = docs.select(F.struct(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id")).alias("row"), F.col(text_col).cast("binary").alias("text"))
    added = T.StructType.fromDDL(fields)
    arrow = list(to_arrow_schema(added))

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, "text"):
                got = fn(piece.column("text").to_pylist())
                row = piece.column("row").take(pa.array(got["text"], pa.int64()))
                yield pa.RecordBatch.from_arrays([row, *[pa.array(got[f.name], f.type) for f in arrow]], names=["row", *[f.name for f in arrow]])

    return src.mapInArrow(run, T.StructType([src.schema["row"], *added])).select("row.uid", "row.id", *added.names)


def _slots(digests: list[bytes]) -> np.ndarray:
    """The first SLOT_BITS bits of each digest."""
    return np.frombuffer(b"".join(d[:4].ljust(4, b"\0") for d in digests), dtype=">u4").astype(np.int64) >> (32 - SLOT_BITS)


def _bits(digests: DataFrame) -> np.ndarray:
    """A filter of ``digests``: a bit for each value of _slots, 8 MB however many there are."""
    slot = F.shiftright(F.conv(F.rpad(F.hex(F.substring("digest", 1, 4)), 8, "0"), 16, 10).cast("long"), 32 - SLOT_BITS)
    words = digests.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("bits")).toArrow()
    out = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _in_filter(rows: DataFrame, bits) -> DataFrame:
    """The ``rows`` whose digest the filter has: all that repeat, and few others."""

    def keep(batches):
        for batch in batches:
            slot = _slots(batch.column("digest").to_pylist())
            yield batch.filter(pa.array((bits.value[slot >> 6] >> (slot & 63)) & 1 == 1))

    return rows.mapInArrow(keep, rows.schema)


def _clashes(docs: DataFrame, bits, id_col: str, text_col: str, digest_bytes: int) -> bool:
    """Whether a digest that repeats is that of different texts: the texts of the chunks in question meet and are compared."""

    def bodies(texts):
        got = cut(texts, digest_bytes)
        found = [(d, b) for d, b in zip(got["digest"], got["body"]) if d is not None]
        slot = _slots([d for d, _ in found])
        kept = np.flatnonzero((bits.value[slot >> 6] >> (slot & 63)) & 1)
        return {"text": [0] * len(kept), "digest": [found[k][0] for k in kept], "body": [found[k][1] for k in kept]}

    texts = _over_texts(docs, id_col, text_col, "digest binary, body binary", bodies).select("digest", "body").distinct()
    return not texts.groupBy("digest").count().filter("count > 1").isEmpty()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 12) -> tuple[DataFrame, DataFrame]:
    """The stored chunks, and the occurrences (uid, id, start, end, later) of those that stand in more than one place.

    Digests are counted before anything is joined, and the texts of those that repeat are compared: if one digest has
    different texts, all is done again with digests twice as long. ``later`` is false for one occurrence of a chunk:
    that of the smallest id (nulls last), and the first one in it.
    """
    fields = "k int, start long, end long, size long, n long, digest binary"
    while True:
        width = digest_bytes
        found = stored(_over_texts(docs, id_col, text_col, fields, lambda texts: cut(texts, width)), "chunks")
        real = found.filter("digest is not null").select("uid", "id", "start", "end", "digest")
        again = stored(real.groupBy("digest").agg(F.count("*").alias("times")).filter("times > 1").select("digest"), "chunk-repeats")
        bits = docs.sparkSession.sparkContext.broadcast(_bits(again))
        if not _clashes(docs, bits, id_col, text_col, width):
            break
        if width >= 64:
            raise ValueError("different texts have one BLAKE2b digest of 64 bytes")
        digest_bytes = 2 * width
    here = stored(_in_filter(real, bits).join(again, "digest"), "chunk-places")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "uid", "start")
    first = stored(here.groupBy("digest").agg(F.min(place).alias("first")), "chunk-firsts")  # so a very common chunk's places can be split in the join
    later = (F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start"))
    return found, here.join(first, "digest").select("uid", "id", "start", "end", later.alias("later"))


def _ranges(parts):
    """Sorted, touching parts as one range each, written start:end."""
    begin = F.filter(parts, lambda p, i: (i == 0) | (F.get(parts, i - 1)["end"] != p["start"]))
    close = F.filter(parts, lambda p, i: (i == F.size(parts) - 1) | (F.get(parts, i + 1)["start"] != p["end"]))
    return F.array_join(F.zip_with(begin, close, lambda a, b: F.concat_ws(":", a["start"].cast("string"), b["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 12) -> DataFrame:
    """Per document: n_chars, n_chunks, n_repeated (code points in chunks that stand elsewhere too), n_later (those that an
    earlier place has), and spans, the ranges of the latter (end exclusive, code points), which a de-duplicated text leaves out.

    Null and empty texts have no chunks. Rows that repeat an id each get a row.
    """
    found, seen = repeats(docs, id_col, text_col, digest_bytes)
    part = "struct<start:bigint,end:bigint>"
    heads = found.filter("k = 0").select("uid", "id", "size", "n", F.lit(0).cast("long").alias("repeated"), F.lit(None).cast(part).alias("part"))
    zero = F.lit(0).cast("long")
    parts = seen.select("uid", "id", zero.alias("size"), zero.alias("n"), (F.col("end") - F.col("start")).alias("repeated"), F.when(F.col("later"), F.struct("start", "end")).alias("part"))
    got = heads.unionByName(parts).groupBy("uid", "id").agg(F.sum("size").alias("n_chars"), F.sum("n").alias("n_chunks"), F.sum("repeated").alias("n_repeated"), F.array_sort(F.collect_list("part")).alias("parts"))
    later = F.aggregate("parts", zero, lambda x, p: x + p["end"] - p["start"])
    return got.select(F.col("id").alias(id_col), "n_chars", "n_chunks", "n_repeated", later.alias("n_later"), _ranges(F.col("parts")).alias("spans"))


def brute_force(texts: dict) -> dict:
    """The same by plain loops, for small tests: id -> (n_chars, n_chunks, n_repeated, places of later chunks)."""
    places: dict[bytes, list] = {}
    sizes = {}
    for key in sorted(texts):
        data = (texts[key] or "").encode()
        bounds, h, due = [0], 0, False
        for i, byte in enumerate(data):
            if i - bounds[-1] >= MOST and byte & 0xC0 != 0x80:
                bounds.append(i)
            if due and byte & 0xC0 != 0x80:
                if i - bounds[-1] >= LEAST:
                    bounds.append(i)
                due = False
            h = (2 * h + int(GEAR[byte])) % 2**GEAR_WINDOW
            due = due or h < 2 ** (GEAR_WINDOW - TOP_BITS)
        if data:
            if len(data) - bounds[-1] >= LEAST or len(bounds) == 1:
                bounds.append(len(data))
            else:
                bounds[-1] = len(data)
        at = [len(data[:b].decode()) for b in bounds]
        sizes[key] = (len(data.decode()), len(bounds) - 1)
        for a, b, s, e in zip(bounds, bounds[1:], at, at[1:]):
            places.setdefault(data[a:b], []).append((key, s, e))
    again = [p for p in places.values() if len(p) > 1]
    out = {}
    for key, (n, k) in sizes.items():
        all_here = [(s, e) for p in again for d, s, e in p if d == key]
        out[key] = (n, k, sum(e - s for s, e in all_here), sorted((s, e) for p in again for d, s, e in p[1:] if d == key))
    return out
