"""Shingle sets take memory by the piece, whatever texts come together or however long one is."""

import random
import tracemalloc

import numpy as np

from codecorpus.llm import ngram_join


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(100_000)}" for _ in range(n)).encode()


def peak(texts):
    ngram_join.shingle_sets([b"one two three four five"])
    tracemalloc.start()
    try:
        ngram_join.shingle_sets(texts)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_chunk():
    texts = [words(i, 600) for i in range(1_000)]  # about 4 MB, as a task gets them
    assert peak(texts) < 5 * sum(map(len, texts))


def test_memory_of_a_long_text():
    text = words(1, 600_000)
    assert peak([text]) < 15 * len(text)


def test_few_words_in_all():
    """Texts that have fewer words together than a shingle."""
    for texts in ([b"one"], [b"one two"], [b"a b c", None], [b"a", b"b c"]):
        assert [len(s) for s in ngram_join.shingle_sets(texts)] == [int(t is not None) for t in texts]


def test_sets_do_not_depend_on_pieces(monkeypatch):
    texts = [None, b"", b" \n\t ", b"one", b"A b\x0bC d", words(2, 300), b"x" * 500 + b" y z", None, b"  lead and trail  ", "é ß 漢字 🙂 fünf Sechs".encode(), words(3, 40)]
    want = ngram_join.shingle_sets(texts)
    assert [len(s) for s in want] == [n for n, _ in ngram_join.brute_force({i: t.decode() if t is not None else None for i, t in enumerate(texts)}).values()]
    for piece in (1, 2, 7, 64, 1_000):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        got = ngram_join.shingle_sets(texts)
        assert len(got) == len(want) and all(np.array_equal(g, w) and g.dtype == w.dtype for g, w in zip(got, want))
    assert ngram_join.shingle_sets([]) == [] and all(not len(s) for s in ngram_join.shingle_sets([None, b""]))
