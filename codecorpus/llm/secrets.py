"""Secret scans: base patterns, and a character convolution network over every further candidate with its context."""

from __future__ import annotations

import copy
import random
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import apply_texts, stored

#: Windows of the documents' findings that one shard learns from, about; there are as many shards as that takes.
SHARD = 1_000
#: Rounds over all findings; after each the shards' networks are averaged.
EPOCHS = 8
#: Made findings of formats that the base patterns don't name, and made look-alikes.
MADE = 1_200
#: Share of the true findings held back for calibration that the threshold must find.
RECALL = 0.95
#: Margins count in steps of 1 / STEPS, from -REACH to REACH, so that findings can be counted by margin.
STEPS, REACH = 256, 64
#: Averages of parameters are sums of whole multiples of 1 / FIXED: the same in whatever order they are added.
FIXED = 1 << 44

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate is a run of 12 or more of the characters of credentials that has a letter and a digit, or of 20 or more
#: letters whose case changes several times.
_CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]|(?=(?:[A-Z]*[a-z]+[A-Z]){4})[A-Za-z]{20,}(?![A-Za-z0-9+/_=-]))",
    re.A,
)
#: Candidates that are known to be no secrets: parts of e-mail addresses, names of hosts and files, dates, versions, UUIDs.
_HARMLESS = re.compile(
    r"[a-z][\w-]*(?:\.[\w-]+)*\.(?:com|org|net|io|dev|de|fr|es|edu|gov|html?|txt|py|rs|tsx?|jsx?|json|ya?ml|png|jpe?g|svg|pdf|md|css)|"
    r"\d{4}-\d\d-\d\d[T-].*|[a-z][\w-]*?-?v?\d+\.\d+(?:\.\d+)*|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}",
    re.I | re.A,
)

#: Characters on either side of a candidate, and of the candidate (a longer one has several windows), that the network sees.
SIDE, BODY = 16, 48
_CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-@:\"' \n"
_CODE = {c: i + 2 for i, c in enumerate(_CLASSES)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns in code points, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _ranges(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans, sorted by their starts, as disjoint ranges; adjoining ones are one."""
    out = []
    for s, e, _ in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _inside(start: int, end: int, ranges: list[tuple]) -> bool:
    """Whether a place lies in one of the ranges, or in several adjoining ones together; they are sorted and don't overlap."""
    i = bisect_right(ranges, start, key=lambda r: r[0]) - 1
    at = start
    while 0 <= i < len(ranges) and ranges[i][0] <= at < end:
        at = ranges[i][1]
        i += 1
    return at >= end


def _touches(start: int, end: int, ranges: list[tuple]) -> bool:
    """Whether a place has a character in common with one of the disjoint ranges."""
    i = bisect_left(ranges, end, key=lambda r: r[0])
    return i > 0 and ranges[i - 1][1] > start


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Every further candidate: one that lies in no span, nor in several together, that are there already."""
    ranges = _ranges(taken)
    return [(a, b) for a, b in (m.span() for m in _CANDIDATE.finditer(text)) if not _inside(a, b, ranges)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of the context and the candidate, at fixed places; 0 is padding, 1 any other character.

    Of a longer candidate it is the first window.
    """
    end = min(end, start + BODY)
    body = text[start:end]
    row = text[max(0, start - SIDE) : start].rjust(SIDE, "\0") + body.ljust(BODY, "\0") + text[end : end + SIDE].ljust(SIDE, "\0")
    return np.array([0 if c == "\0" else _CODE.get(c, 1) for c in row], dtype=np.int16)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that the network sees: all of it, or windows of BODY that overlap by half, the last at its end."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in [*range(start, end - BODY, BODY // 2), end - BODY]]


def cells(margin: np.ndarray) -> np.ndarray:
    """Margins in whole steps."""
    return np.rint(np.clip(margin, -REACH, REACH) * STEPS).astype(np.int64)


class CharNet:
    """Embedding, one convolution of width 5, maximum and mean over the places, one linear unit; plain numpy."""

    def __init__(self, seed: int = 7, embed: int = 12, filters: int = 24, width: int = 5):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "e": r.normal(0, 0.3, (len(_CLASSES) + 2, embed)),
            "w": r.normal(0, (2 / (width * embed)) ** 0.5, (width * embed, filters)),
            "b": np.zeros(filters),
            "v": r.normal(0, 0.2, 2 * filters),
            "c": np.zeros(1),
        }
        self.m, self.s, self.t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x):
        e = self.p["e"][x]
        n, length, d = e.shape
        view = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.width + 1, -1)
        z = view @ self.p["w"] + self.p["b"]
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return view, z, top, pooled, pooled @ self.p["v"] + self.p["c"][0]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability that a candidate is a secret."""
        return self._calibrated(self.margin(x))

    def _calibrated(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * cells(margin) / STEPS + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> None:
        """Adam on logistic loss, classes weighted to equal shares; goes on from what was learned before."""
        r = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                xb = x[rows]
                view, z, top, pooled, out = self._forward(xb)
                d = weight[rows] * (1 / (1 + np.exp(-out)) - y[rows]) / len(rows)
                filters = z.shape[2]
                da = np.repeat((d[:, None] * self.p["v"][filters:] / z.shape[1])[:, None], z.shape[1], axis=1)
                n, f = np.meshgrid(np.arange(len(rows)), np.arange(filters), indexing="ij")
                da[n, top, f] += d[:, None] * self.p["v"][:filters]
                dz = da * (z > 0)
                grad = {"v": pooled.T @ d, "c": np.array([d.sum()]), "b": dz.sum((0, 1)), "w": np.tensordot(view, dz, ([0, 1], [0, 1]))}
                de = (dz @ self.p["w"].T).reshape(*dz.shape[:2], self.width, -1)
                at = np.zeros((*xb.shape, de.shape[-1]))
                for k in range(self.width):
                    at[:, k : k + dz.shape[1]] += de[:, :, k]
                ge = np.zeros_like(self.p["e"])
                np.add.at(ge, xb, at)
                grad["e"] = ge
                self.t += 1
                for k, g in grad.items():
                    self.m[k] = 0.9 * self.m[k] + 0.1 * g
                    self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
                    self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)

    def state(self) -> np.ndarray:
        """Parameters and both moments as one vector."""
        return np.concatenate([part[k].ravel() for part in (self.p, self.m, self.s) for k in self.p])

    def take(self, state: np.ndarray, t: int) -> None:
        """Go on from this state after ``t`` steps."""
        at = 0
        for part in (self.p, self.m, self.s):
            for k, v in part.items():
                part[k] = state[at : at + v.size].reshape(v.shape).copy()
                at += v.size
        self.t = t

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL, first: np.ndarray | None = None) -> None:
        """Platt scaling on findings held back; the threshold is the largest that finds ``recall`` of the true ones.

        ``first`` says at which row of ``x`` each finding's windows begin, if findings have several.
        """
        z = self.margin(x)
        if first is not None and len(first):
            z = np.maximum.reduceat(z, first)
        self.settle(cells(z), y, np.ones(len(z)), recall)

    def settle(self, cell: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """The same from the numbers ``n`` of findings by cell of their margins and by label."""
        z = cell / STEPS
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))
            h = n * (p * (1 - p) + 1e-6)
            g = np.array([(n * (p - y) * z).sum() + 1e-3 * (self.slope - 1), (n * (p - y)).sum()])
            hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum()]])
            step = np.linalg.solve(hess, g)
            self.slope, self.shift = self.slope - 0.5 * step[0], self.shift - 0.5 * step[1]
            if abs(step).max() < 1e-6:
                break
        found, n = self._calibrated(z[y > 0]), n[y > 0]
        order = np.argsort(-found, kind="stable")
        last = np.searchsorted(np.cumsum(n[order]), max(1, np.ceil(recall * n.sum())))
        self.threshold = float(found[order][last]) if len(found) else 0.5


def made_findings(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings by rule: (text, start, end, 1 for a secret or 0 for a look-alike)."""
    r = random.Random(seed)
    low, alnum, b64 = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    parts = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ou", "ea", "ti", "es", "or", "en", "at", "ing", "ion", "ch", "de", "la"]
    word = lambda a=1, b=5: "".join(r.choice(parts) for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 5)))
    secret = [
        lambda: some(alnum, 20, 64),
        lambda: some(alnum, 12, 20) + r.choice("0123456789"),
        lambda: some(low + low.upper(), 20, 40),
        lambda: some(b64, 28, 86) + r.choice(["", "=", "=="]),
        lambda: r.choice(["ghp_", "gho_", "glpat-", "npm_", "sk_live_", "rk_test_", "xoxb-", "AIza", "sk-"]) + some(alnum, 20, 40),
        lambda: "eyJ" + some(alnum, 15, 40) + "." + some(alnum + "-_", 20, 60) + "." + some(alnum + "-_", 20, 43),
        lambda: some("0123456789ABCDEF", 32, 64),
        lambda: "-".join(some(alnum, 5, 10) for _ in range(4)),
    ]
    harmless = [
        lambda: f"mail{r.randint(1, 99)}.{word()}.{r.choice(['com', 'org', 'net'])}",
        lambda: f"{word()}.{word()}.{r.randint(1, 99)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:00Z".replace(":", "-"),
        lambda: f"{word()}_{word()}_{word()}_{r.randint(0, 999)}",
        lambda: f"{word()}/{word()}/{word()}{r.randint(0, 99)}.{r.choice(['py', 'html', 'txt', 'png'])}",
        lambda: f"{word(3, 8)}{r.randint(0, 9999)}",
        lambda: f"{word()}-{word()}-{word()}-v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        lambda: f"{word(3, 7).upper()}{r.randint(0, 9999)}",
        lambda: f"{some('0123456789abcdef', 8, 8)}-{some('0123456789abcdef', 4, 4)}-4{some('0123456789abcdef', 3, 3)}-a{some('0123456789abcdef', 3, 3)}-{some('0123456789abcdef', 12, 12)}",
        lambda: "-".join(word() + str(r.randint(0, 9)) for _ in range(r.randint(3, 6))),
        lambda: "".join(w.capitalize() for w in (word(), word(), word(), word())) + str(r.randint(0, 99)),
    ]
    leads = ["", "key ", "auth ", "Authorization: Bearer ", "value=", "id: ", "= \"", "see ", "at ", "https://", "@", "user@", "export X=", "credential "]
    out = []
    for i in range(n):
        good = i % 2
        value = r.choice(secret if good else harmless)()
        before = f"{prose()} {r.choice(leads)}"
        out.append((f"{before}{value}{r.choice([' ', chr(10), '\" ', '. ', ', '])}{prose()}", len(before), len(before) + len(value), good))
    return out


def _bytes(text: str, start: int, end: int) -> list[bytes]:
    """The encoded windows of a finding, a byte for each place."""
    return [encode(text, *w).astype(np.uint8).tobytes() for w in windows(start, end)]


def _findings(texts):
    """Encoded windows of a text's findings: values of base spans are true ones, candidates of a harmless format are not.

    What any other candidate is isn't known, so none is shown to the network as harmless.
    """
    rows, labels = [], []
    for t in texts:
        text = t.decode() if t else ""
        spans = base_spans(text)
        ranges = _ranges(spans)
        x, y = [], []
        for a, b, kind in spans:
            m = _ASSIGN.match(text, a, b) if kind == "assign" else None
            a = m.start(2) if m else a
            if b - a >= 16:
                x.append(_bytes(text, a, b))
                y.append(1)
        for a, b in candidates(text, spans):
            known = text[a - 1 : a] == "@" or text[b : b + 1] == "@" or _HARMLESS.fullmatch(text, a, b)
            if known and not _touches(a, b, ranges):
                x.append(_bytes(text, a, b))
                y.append(0)
        rows.append(x)
        labels.append(y)
    return {"x": rows, "y": labels}


def _by_window(found: DataFrame) -> DataFrame:
    """A row for each window of the findings ``x, y``, with the hashes of the finding and of its value, which is the finding without context."""
    value = F.transform("x", lambda w: F.substring(w, SIDE + 1, BODY))
    return found.select(F.xxhash64("x").alias("finding"), F.xxhash64(value).alias("value"), "y", F.explode("x").alias("x"))


def lessons(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The different windows of the findings of every text: finding, value (as hashes), y and x; stored.

    Of the true values, every second by its hash is also shown without its context, so that the network doesn't lean on
    the keyword that the base pattern needs.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.lit(True).alias("read"))
    found = apply_texts(texts, "text", _findings, "x array<array<binary>>, y array<int>", ["read"])
    found = found.select(F.explode(F.arrays_zip("out.x", "out.y")).alias("found")).select("found.x", "found.y")
    blank = F.lit(bytes(SIDE))
    whole = F.struct("finding", "x")
    bare = F.struct(F.col("value").alias("finding"), F.concat(blank, F.substring("x", SIDE + 1, BODY), blank).alias("x"))
    shown = F.when((F.col("y") == 1) & (F.col("value").bitwiseAND(4) != 0), F.array(whole, bare)).otherwise(F.array(whole))
    rows = _by_window(found).select("value", "y", F.explode(shown).alias("shown"))
    return stored(rows.select("shown.finding", "value", "y", "shown.x").distinct(), "findings")


def _round(rows: DataFrame, shards: int, net: CharNet, number: int) -> None:
    """Every shard goes on from the network over its own rows; the network becomes the average of theirs."""

    def learn(key, table):
        order = sorted(zip(table.column("y").to_pylist(), table.column("x").to_pylist()))
        mine = copy.deepcopy(net)
        mine.fit(np.frombuffer(b"".join(x for _, x in order), np.uint8).reshape(len(order), -1), np.array([y for y, _ in order], dtype=float), 1, seed=[number, key[0].as_py()])
        return pa.table({"t": pa.array([mine.t], pa.int32()), "part": pa.array([np.rint(mine.state() * FIXED).astype(np.int64)], pa.list_(pa.int64()))})

    parts = rows.select("shard", "y", "x").repartition(shards, "shard").groupBy("shard").applyInArrow(learn, "t int, part array<long>")
    sums = parts.select("t", F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.count("*").alias("n"), F.max("t").alias("t")).collect()
    if sums:
        state = np.zeros(len(sums))
        for r in sums:
            state[r.k] = int(r.v) / r.n / FIXED
        net.take(state, sums[0].t)


def _held_margins(rows: DataFrame, net: CharNet) -> DataFrame:
    """Numbers ``n`` of findings by cell of their margins, of several windows the greatest, and by label."""

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                z = net.margin(np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column("finding"), batch.column("y"), batch.column("weight"), pa.array(cells(z))], names=["finding", "y", "weight", "cell"])

    asked = rows.select("finding", "y", "weight", "x").mapInArrow(ask, "finding long, y int, weight long, cell long")
    return asked.groupBy("finding", "y", "weight").agg(F.max("cell").alias("cell")).groupBy("cell", "y").agg(F.sum("weight").alias("n"))


def train(docs: DataFrame, text_col: str = "text", made: int = MADE, shard: int = SHARD) -> CharNet:
    """Learn from labelled findings: those of every text, and ``made`` ones of other formats.

    Findings lie in shards of about ``shard`` windows by their hashes, and each shard has the made ones too, so that their
    share doesn't fall as the table grows. In each round every shard learns on its own and the results are averaged. One
    value in four, all its findings together, only calibrates, made ones counting once for each shard.
    """
    spark = docs.sparkSession
    own = lessons(docs, text_col)
    other = _by_window(spark.createDataFrame([(_bytes(t, a, b), y) for t, a, b, y in made_findings(made)], "x array<binary>, y int"))
    held = F.pmod("value", F.lit(4)) == 0
    shards = max(1, -(-own.filter(~held).count() // shard))
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    rows = own.withColumn("shard", F.pmod(F.xxhash64("finding", "x"), F.lit(shards)).cast("int")).unionByName(other.withColumn("shard", each)).filter(~held)
    net = CharNet()
    for number in range(EPOCHS):
        _round(rows, shards, net, number)
    asked = own.withColumn("weight", F.lit(1).cast("long")).unionByName(other.withColumn("weight", F.lit(shards).cast("long"))).filter(held)
    got = _held_margins(asked, net).orderBy("cell", "y").collect()
    net.settle(*(np.array([r[k] for r in got], dtype=float) for k in ("cell", "y", "n")))
    return net


def scan(docs: DataFrame, net: CharNet, carry: list[str], text_col: str = "text") -> DataFrame:
    """Struct ``row`` of the carried columns and struct ``out`` with ``spans``: start, end (exclusive, code points), kind and score.

    Null texts are empty and have no spans. Spans are ordered by start, then kind; base spans have score 1.
    A candidate that reaches past a base span is a span of its own beside it; one of several windows has the greatest score of these.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def fn(texts):
        out, asked, first, rows = [], [], [], []
        for i, t in enumerate(texts):
            text = t.decode() if t else ""
            spans = base_spans(text)
            out.append([(a, b, k, 1.0) for a, b, k in spans])
            for a, b in candidates(text, spans):
                asked.append((i, a, b))
                first.append(len(rows))
                rows += [encode(text, *w) for w in windows(a, b)]
        if rows:
            for (i, a, b), p in zip(asked, np.maximum.reduceat(model.value.probability(np.stack(rows)), first)):
                if p >= model.value.threshold:
                    out[i].append((a, b, "learned", float(p)))
        return {"spans": [[dict(zip(("start", "end", "kind", "score"), s)) for s in sorted(x, key=lambda s: (s[0], KINDS.index(s[2])))] for x in out]}

    return apply_texts(docs, text_col, fn, "spans array<struct<start:int,end:int,kind:string,score:double>>", carry)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans, and n_learned (spans that only the network finds).

    Null and empty texts have no spans; repeated rows, null and repeated ids included, each get a row; an empty table
    gives no rows; other columns are not read.
    """
    found = scan(docs, train(docs, text_col), [id_col], text_col)
    count = lambda kind: F.size(F.filter("out.spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col(f"row.`{id_col}`").alias(id_col),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(F.filter("out.spans", lambda s: s["kind"] != "learned")), 256).alias("base_sha256"),
        line(F.col("out.spans")).alias("spans"),
        count("learned").alias("n_learned"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``, overlapping spans by one; other columns as they were."""
    found = scan(docs, train(docs, text_col), docs.columns, text_col)
    text = F.col(f"row.`{text_col}`")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    done = F.aggregate(
        "out.spans",
        start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("text"), s["end"].alias("at"))).otherwise(
            F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"))
        ),
    )
    clean = F.when(F.size("out.spans") == 0, text).otherwise(F.concat(done["text"], F.substring(text, done["at"] + 1, F.length(text))))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
