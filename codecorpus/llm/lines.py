"""Repeated lines: two Bloom filters find suspects, only those shuffle, and all but the last occurrence's lines go.

1. Each task sends the 64-bit hashes of its long lines, one each, to the region of the hash. A region's task streams
   through them with two filters: a hash whose bits are all in the first one has been seen, and goes to the second.
   The first filter is spread over the regions' tasks and grows with the input; it is never gathered.
2. The second filter holds suspects only. Its size follows their number, up to MOST_BITS; it is broadcast. If there
   are more suspects than it can tell apart, more lines shuffle in step 3, and the result is the same.
3. Suspected lines shuffle as (128-bit digest, doc_id), where documents are counted exactly and a keeper is chosen.
4. Decisions go to the texts as a broadcast where they are at most MOST_KEYS, else by a join on the document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Null and empty texts are one empty
line; rows that repeat an id are one document; a null id is no document: it neither counts nor keeps, but loses lines;
an empty table gives no rows; further columns go through ``dedup`` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codecorpus.llm._text import apply_texts, chunks, stored

#: Keys of so many code points that so many documents share lose their lines.
MIN_CHARS, MIN_DOCS = 40, 5
#: Regions of the first filter at least, bytes of text for each further one, and bits for each line that may be in it.
REGIONS, REGION_BYTES, BITS_A_LINE = 512, 64 << 20, 8
#: The second filter's bits for each suspect, and its largest size (32 MB).
BITS_A_SUSPECT, MOST_BITS = 12, 1 << 28
#: Decisions that are broadcast at most (a dictionary of some 90 MB in a worker).
MOST_KEYS = 500_000
#: Hashes that a task holds before it hands them on.
HELD = 1 << 20

SPACE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a UTF-8 line; None where it is too short."""
    key = line.strip(SPACE)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """A text's lines, and the digest of each long enough one."""
    lines = (text or b"").split(b"\n")
    return lines, [None if (k := key_of(line, min_chars)) is None else digest(k) for line in lines]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8")[::2] if digests else np.zeros(0, np.uint64)


def _slots(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash, its word among ``words`` and its three bits there. 2^20 regions of 2^26 words tell hashes apart.

    ``words`` is a power of two, so a filter of fewer words is a larger one folded onto itself.
    """
    one, low = np.uint64(1), np.uint64(63)
    word = ((hashes >> np.uint64(18)) & np.uint64(words - 1)).astype(np.int64)
    return word, (one << (hashes & low)) | (one << ((hashes >> np.uint64(6)) & low)) | (one << ((hashes >> np.uint64(12)) & low))


def _power(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, int(n) - 1).bit_length()


def _suspects(docs: DataFrame, min_chars: int, regions: int, words: int) -> DataFrame:
    """``(word, mask)``: the set bits of all regions' second filters of ``words`` words, as if they were one filter.

    A region is chosen by the bits above those that choose its word, so that ``word`` is where one filter of
    ``regions * words`` words has the bits.
    """
    shift = np.uint64(18 + (words - 1).bit_length())

    def local(batches) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def rows():
            h, n = np.unique(_hashes(held), return_counts=True)
            held.clear()
            at = ((h >> shift) & np.uint64(regions - 1)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            h, n = h[order], n[order]
            ids, start = np.unique(at[order], return_index=True)
            pieces = list(zip(ids.tolist(), start.tolist(), [*start[1:].tolist(), len(h)]))
            if pieces:
                yield pa.RecordBatch.from_pydict({
                    "region": pa.array([p[0] for p in pieces], pa.int64()),
                    "hashes": pa.array([h[a:b].tobytes() for _, a, b in pieces], pa.binary()),
                    "again": pa.array([h[a:b][n[a:b] > 1].tobytes() for _, a, b in pieces], pa.binary()),
                })

        for batch in batches:
            for text in batch.column("text"):
                held.extend({d for d in _digests(text.as_py(), min_chars)[1] if d})
                if len(held) > HELD:
                    yield from rows()
        yield from rows()

    def fold(batches) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Seen] = {}
        for batch in batches:
            for region, hashes, again in zip(*(batch.column(c).to_pylist() for c in ("region", "hashes", "again"))):
                two = seen.setdefault(region, Seen(words))
                two.add(np.frombuffer(hashes, np.uint64))
                two.add(np.frombuffer(again, np.uint64))
        for region, two in seen.items():
            at = np.flatnonzero(two.twice)
            yield pa.RecordBatch.from_pydict({"word": at + region * words, "mask": two.twice[at].view(np.int64)})

    sent = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(local, "region long, hashes binary, again binary")
    return sent.repartition(F.col("region")).mapInArrow(fold, "word long, mask long")


class Seen:
    """The two filters of a region: hashes seen, and hashes seen again."""

    def __init__(self, words: int):
        self.once = np.zeros(words, np.uint64)
        self.twice = np.zeros(words, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        """Those of the distinct ``hashes`` whose bits the first filter has go to the second one."""
        word, mask = _slots(hashes, len(self.once))
        again = (self.once[word] & mask) == mask
        np.bitwise_or.at(self.twice, word[again], mask[again])
        np.bitwise_or.at(self.once, word, mask)


def _second_filter(suspects: DataFrame, size: int) -> np.ndarray:
    """The suspects' bits, of a filter of ``size`` words, folded to a size for their number; blocks are merged by tasks and only they come back."""
    bits = suspects.agg(F.sum(F.bit_count("mask"))).first()[0] or 0
    words = min(size, max(1, min(MOST_BITS, max(1 << 16, _power(BITS_A_SUSPECT * bits // 3))) // 64))
    block = min(1 << 10, words)

    def merge(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            word, mask = batch.column("word").to_numpy(), batch.column("mask").to_numpy().view(np.uint64)
            at = word // block
            for b in np.unique(at).tolist():
                np.bitwise_or.at(held.setdefault(b, np.zeros(block, np.uint64)), word[at == b] % block, mask[at == b])
        for b, x in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int64()), "words": pa.array([x.tobytes()], pa.binary())})

    folded = suspects.select(F.col("word").bitwiseAND(F.lit(words - 1)).alias("word"), "mask").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(words, np.uint64)
    for row in folded.repartition(F.floor(F.col("word") / block)).mapInArrow(merge, "block long, words binary").collect():
        out[row.block * block : (row.block + 1) * block] |= np.frombuffer(bytes(row.words), np.uint64)
    return out


class Repeats:
    """What goes: the stored table ``decisions(key, keeper)`` of ``docs``: digests of repeated lines and the document that keeps them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.docs, self.id_col, self.min_chars = docs, id_col, min_chars
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        regions = _power(min(1 << 20, max(REGIONS, size // REGION_BYTES)))
        words = _power(min(1 << 26, BITS_A_LINE * (size // (min_chars + 1)) // regions // 64 + 1))
        self.filter = docs.sparkSession.sparkContext.broadcast(_second_filter(stored(_suspects(docs, min_chars, regions, words), "suspects"), regions * words))
        # documents are counted by (key, document) first, so that a very common line is spread; nulls don't count
        of = self._asked().groupBy("key").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keeper"))
        self.decisions = stored(of.filter(F.col("n") >= min_docs).select("key", "keeper"), "repeated-lines")

    def _asked(self) -> DataFrame:
        """``(doc, key)`` of every line that the second filter suspects, once a row of the table."""
        held, min_chars = self.filter, self.min_chars

        def ask(texts):
            keys, has = [], held.value
            for text in texts:
                own = sorted({d for d in _digests(text, min_chars)[1] if d})
                word, mask = _slots(_hashes(own), len(has))
                keys.append([own[i] for i in np.flatnonzero((has[word] & mask) == mask)])
            return {"keys": keys}

        found = apply_texts(self.docs, "text", ask, "keys array<binary>", [self.id_col])
        return found.select(F.col("row")[self.id_col].alias("doc"), F.explode("out.keys").alias("key"))

    def kept(self, carry: list[str], most_keys: int = MOST_KEYS) -> DataFrame:
        """Each row's ``carry`` columns as struct ``row``, and as struct ``out`` what stays and the numbers of lines."""
        min_chars, id_col = self.min_chars, self.id_col
        fields = "kept binary, n_lines long, n_dropped long"

        def without(text, drops):
            lines, keys = _digests(text, min_chars)
            kept = [line for line, k in zip(lines, keys) if k is None or not drops(k)]
            return b"\n".join(kept), len(lines), len(lines) - len(kept)

        if self.decisions.count() <= most_keys:
            found = self.decisions.toArrow()
            known = self.docs.sparkSession.sparkContext.broadcast(dict(zip(found.column("key").to_pylist(), found.column("keeper").to_pylist())))

            def decide(texts, docs):
                keeper = known.value
                return [without(text, lambda k, doc=doc: k in keeper and keeper[k] != doc) for text, doc in zip(texts, docs)]

            return _apply_with(self.docs, id_col, decide, fields, carry)

        # everybody but the keeper is told to drop, also rows without an id
        told = self._asked().distinct().join(self.decisions, "key").filter(~F.col("doc").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc").alias("told")).agg(F.collect_list("key").alias("going"))
        source = self.docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(id_col).alias("doc"), "text")
        source = source.join(told, F.col("doc").eqNullSafe(F.col("told")), "left")
        out = _apply_with(source, "going", lambda texts, lists: [without(t, set(g or ()).__contains__) for t, g in zip(texts, lists)], fields, ["row"])
        return out.select("row.row", "out")


def _apply_with(df: DataFrame, column: str, fn, fields: str, carry: list[str]) -> DataFrame:
    """As apply_texts, for a function of the texts and one more column."""
    src = df.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(column).alias("with"), F.col("text").cast("binary").alias("text"))
    out_type = T.StructType.fromDDL(fields)
    names = list(to_arrow_schema(out_type))

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, "text"):
                found = fn(piece.column("text").to_pylist(), piece.column("with").to_pylist())
                arrays = [pa.array([r[i] for r in found], type=f.type) for i, f in enumerate(names)]
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.StructArray.from_arrays(arrays, fields=names)], names=["row", "out"])

    return src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("out", out_type)]))


def dedup(docs: DataFrame, id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with what stays of each text; null texts stay null."""
    found = Repeats(docs, id_col, min_chars, min_docs).kept(docs.columns)
    text = F.when(F.col("row.text").isNotNull(), F.col("out.kept").cast("string")).alias("text")
    return found.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each row."""
    found = Repeats(docs).kept(["doc_id"])
    return found.select("row.doc_id", "out.n_lines", "out.n_dropped", F.sha2("out.kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> list[tuple]:
    """The report of a small list of ``(doc_id, text)``, by definition."""
    white = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[line.strip(white).translate(lower) for line in (t or "").split("\n")] for _, t in rows]
    where: dict[str, set] = {}
    for (doc, _), own in zip(rows, keys):
        for k in own:
            if len(k) >= min_chars and doc is not None:
                where.setdefault(k, set()).add(doc)
    out = []
    for (doc, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [line for line, k in zip(lines, own) if len(where.get(k, ())) < min_docs or doc is not None and max(where[k]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
