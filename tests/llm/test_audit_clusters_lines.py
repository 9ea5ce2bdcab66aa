"""Source divergence, centroid clustering and line dedup against brute force, and on odd rows."""

import random

import numpy as np
import pytest

from codecorpus.llm import centroids, divergence, lines
from tests.llm.test_operators import prose


# ---- source divergence -----------------------------------------------------------------------------------------------


def group_rows(n, sources):
    r = random.Random(n)
    rows = []
    for i in range(n):
        words = [f"{r.choice('abcdefghij')}{'xyz'[w % 3]}" for w in range(r.randrange(30))] + ["Mot", "é漢"] * (i % 3)
        rows.append((" 1".join(words) + "_-", ["en", "fr", None][i % 7 % 3], f"s{r.randrange(sources)}"))
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0) for i, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def audited(docs):
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.report(docs).collect()}


def test_divergence_equals_brute_force(spark):
    rows = group_rows(400, 5) + [(None, "en", "s0"), ("", None, None), ("123", "xx", "lonely"), ("nur selten", "de", "a"), ("nur einmal", "de", "b"), ("word " * 70_000, "en", "s1")]
    assert audited(as_docs(spark, rows)) == divergence.brute_force(rows)


def test_divergence_in_small_tiles_and_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = group_rows(500, 9)
    assert audited(as_docs(spark, rows).repartition(3)) == divergence.brute_force(rows)


def test_divergence_edges(spark, with_clashes):
    rows = group_rows(120, 2)
    docs = with_clashes(as_docs(spark, rows)).withColumns({c: centroids.F.lit("mine") for c in ("term", "value", "item", "rank", "p", "shard", "tile")})
    assert audited(docs) == divergence.brute_force(rows)
    assert divergence.report(docs.limit(0)).count() == 0
    twice = rows + rows
    assert audited(as_docs(spark, twice)) == divergence.brute_force(twice)


# ---- centroid clustering ---------------------------------------------------------------------------------------------


VEC = "vec_id long, embedding array<float>, label int"


def clustered(df):
    return sorted(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in centroids.report(df).collect())


def vectors(n, spread, seed=1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(5, 64))
    return [(i, [float(np.float32(x)) for x in middle[i % 5] + spread * r.normal(size=64)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_clusters_equal_brute_force(spark, spread):
    vs = vectors(150, spread)
    df = spark.createDataFrame([(i, v, 0) for i, v in vs], VEC).repartition(3)
    assert clustered(df) == sorted(centroids.brute_force(vs))


def test_clusters_on_odd_vectors(spark):
    vs = vectors(40, 1.0)
    odd = [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [1.0] * 63 + [float("nan")]), (104, [float("-inf")] * 64), (105, []), (3, vs[3][1]), (107, [0.0] * 64), (108, [0.0] * 64), (109, [-0.0] * 64), (110, [1000.0] * 64)]
    every = vs + odd
    df = spark.createDataFrame([(i, v, 0) for i, v in every], VEC).withColumns({c: centroids.F.lit("mine") for c in ("full", "cells", "block", "cluster", "distance", "h")})
    assert clustered(df) == sorted(centroids.brute_force(every))
    assert clustered(df.limit(0)) == []
    assert clustered(df.filter("vec_id < 3")) == sorted(centroids.brute_force(vs[:3]))
    same = [(i, [0.5] * 64) for i in range(12)]
    assert clustered(spark.createDataFrame([(i, v, 0) for i, v in same], VEC)) == sorted(centroids.brute_force(same))
    assert {r.vec_id for r in centroids.report(df.unionByName(df.filter("vec_id = 107").withColumn("vec_id", centroids.F.lit(None).cast("long")))).collect()} >= {None, 107}


def test_a_component_that_is_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 0)], VEC)
    with pytest.raises(Exception, match="beyond"):
        centroids.report(df).collect()


def test_cells_decide_as_full_vectors_or_not_at_all():
    r = np.random.default_rng(3)
    x = r.integers(-400, 400, (500, 8))
    c = r.integers(-100, 100, (6, 8))
    marks = centroids.Marks(x.min(axis=0), x.max(axis=0), 6)
    cells = marks.unpack(marks.pack(x))
    assert ((marks.at[np.arange(8), cells] <= x) & (x < marks.at[np.arange(8), cells + 1])).all()
    (got,) = marks.decide(cells, c)
    best = centroids.distances(x, c).argmin(axis=1)
    assert (got[got >= 0] == best[got >= 0]).all() and (got >= 0).mean() > 0.3


def test_a_narrow_dimension_and_a_tie():
    x = np.array([[0, 7], [0, 7], [2, 7]])
    marks = centroids.Marks(x.min(axis=0), x.max(axis=0), 3)
    (got,) = marks.decide(marks.unpack(marks.pack(x)), np.array([[1, 7], [1, 7]]))
    assert set(got.tolist()) <= {0, -1}


# ---- line dedup ------------------------------------------------------------------------------------------------------


def line_texts():
    r = random.Random(4)
    common = [f"  {prose(k, 9)} Passage {k}\t" for k in range(12)]
    texts = {}
    for i in range(150):
        own = [prose(1000 + i * 7 + k, 8) for k in range(3)]
        own[1:1] = [r.choice([str.upper, str.lower, str])(r.choice(common[: 3 + i % 10])) for _ in range(r.randrange(4))]
        own += ["short line", "", "é" * 39, "é" * 40][: i % 5]
        texts[i] = "\n".join(own)
    return texts


def reported(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.report(df).collect()), key=repr)


def test_lines_equal_brute_force(make_docs):
    texts = line_texts()
    got = reported(make_docs(texts).repartition(5))
    assert got == sorted(lines.brute_force(list(texts.items())), key=repr)
    assert sum(r[2] for r in got) > 50


def test_lines_where_filters_are_full_and_tasks_flush(make_docs, monkeypatch):
    texts = line_texts()
    monkeypatch.setattr(lines, "MOST_BITS", 64)
    monkeypatch.setattr(lines, "BITS_A_LINE", 0)
    monkeypatch.setattr(lines, "HELD", 3)
    assert reported(make_docs(texts).repartition(5)) == sorted(lines.brute_force(list(texts.items())), key=repr)


def test_lines_without_a_broadcast(make_docs, monkeypatch):
    rows = [*line_texts().items(), (None, line_texts()[7]), (3, line_texts()[4])]
    found = lines.Repeats(make_docs(rows))
    pick = lambda df: sorted(((r.row.doc_id, r.out.n_lines, r.out.n_dropped, bytes(r.out.kept)) for r in df.collect()), key=repr)
    assert pick(found.kept(["doc_id"], most_keys=0)) == pick(found.kept(["doc_id"]))


def test_lines_edges(make_docs, with_clashes):
    line = "This line is long enough to be a key of its own."
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (5, f"{line}\r\n{line}"), (6, f"\t{line.upper()} "), (6, line), (7, line), (None, f"{line}\nkept"), (9, prose(1, 60_000) + "\n" + line), (10, "\n".join([line] * 20_000))]
    docs = with_clashes(make_docs(rows))
    assert reported(docs) == sorted(lines.brute_force(rows), key=repr)
    clean = lines.dedup(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.collect() if r.doc_id == 1} == {None}
    assert [r.text for r in clean.collect() if r.doc_id == 10][0].count(line) == 20_000
    assert lines.report(docs.limit(0)).count() == 0


def test_the_second_filter_has_every_repeat(spark, make_docs):
    texts = {i: f"line number {i % 900} with enough letters to be a key" for i in range(1000)}
    found = lines.Repeats(make_docs(texts).repartition(6), min_docs=2)
    assert found.decisions.count() == 100
    assert found._asked().count() < 400
