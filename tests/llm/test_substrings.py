"""Substring de-duplication against plain loops, and on nulls, long texts, repeats and equal digests of different texts."""

import random

import pytest

from codecorpus.llm import queries, substrings
from tests.llm.test_operators import edge_docs, prose  # noqa: F401


def covered(spans):
    return {i for s in spans.split(",") if s for i in range(*map(int, s.split(":")))}


def texts():
    passage = prose(900, 120)
    got = {i: prose(i, 20 + 7 * i) for i in range(40)}
    got |= {100 + i: prose(200 + i, 30) + " " + passage + " " + prose(300 + i, 30) for i in range(12)}
    got |= {200: "é漢🙂 " * 300, 201: "x" + "é漢🙂 " * 300, 202: "a" * 5_000, 203: "b\0" * 800, 204: None, 205: "", 206: "short", 207: "short", 208: prose(7, 69), 209: passage + passage}
    return got


@pytest.mark.parametrize("digest_bytes", [12, 1])
def test_repeats_equal_brute_force(make_docs, digest_bytes):
    want = substrings.brute_force(texts())
    rows = {r.doc_id: r for r in substrings.report(make_docs(texts()).repartition(5), digest_bytes=digest_bytes).collect()}
    assert rows.keys() == want.keys()
    for i, (n_chars, n_chunks, n_repeated, later) in want.items():
        r = rows[i]
        assert (r.n_chars, r.n_chunks, r.n_repeated, r.n_later) == (n_chars, n_chunks, n_repeated, sum(e - s for s, e in later)), i
        assert covered(r.spans) == {k for s, e in later for k in range(s, e)}
    assert all(rows[100 + i].n_later > 300 for i in range(1, 12))  # the passage has some 700 characters
    assert rows[207].spans == "0:5" and rows[206].n_later == 0


def test_registered_over_all_documents(spark, sf_dir):
    assert "op2_substring_dedup" in queries.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = substrings.brute_force(docs)
    got = {r.doc_id: (r.n_chars, r.n_chunks, r.n_repeated) for r in queries.queries()["op2_substring_dedup"](spark, sf_dir).collect()}
    assert got == {k: v[:3] for k, v in want.items()}


def test_repeats_edges(edge_docs):  # noqa: F811
    rows = substrings.report(edge_docs).collect()
    assert len(rows) == 10
    sixes = [r for r in rows if r.doc_id == 6]
    assert sorted(r.n_later for r in sixes) == [0, sixes[0].n_chars] and all(r.n_repeated == r.n_chars for r in sixes)
    assert substrings.report(edge_docs.limit(0)).count() == 0


def test_recall_of_planted_passages(make_docs):
    """100 passages of each length, each in two documents among other text: the share of their characters that is found repeated."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(5_000)]
    fill = lambda n: " ".join(r.choice(words) for _ in range(n))
    got, sizes = {}, {}
    for length in (200, 350, 700):
        for i in range(100):
            passage = fill(length)[:length]
            for _ in range(2):
                got[len(got)] = f"{fill(60)} {passage} {fill(60)}"
                sizes[len(got) - 1] = length
    rows = {x.doc_id: x.n_repeated for x in substrings.report(make_docs(got)).collect()}
    for length, least in ((200, 0.65), (350, 0.80), (700, 0.88)):
        mine = [rows[i] for i, n in sizes.items() if n == length]
        assert sum(mine) >= least * 200 * length and sum(x > 0 for x in mine) >= 198, (length, sum(mine) / 200 / length)
