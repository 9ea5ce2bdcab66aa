"""Secret scans: the threshold follows the recall, candidates reach past base spans, and long ones are seen whole."""

import random
import time

import numpy as np
import pytest

from codecorpus.llm import secrets
from codecorpus.llm._text import sample_ids

ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def some(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(ALNUM) for _ in range(n))


class Given(secrets.CharNet):
    def margin(self, x):
        return x[:, 0].astype(float)


def test_threshold_is_the_recall_quantile():
    r = np.random.default_rng(1)
    y = np.array([1.0] * 40 + [0.0] * 400)
    x = np.concatenate([r.normal(1, 1, 40), r.normal(0, 1, 400)])[:, None]
    net = Given()
    net.calibrate(x, y)
    assert net.threshold < 0.5
    assert (net.probability(x[:40]) >= net.threshold).sum() == 38
    twice = Given()  # a second window that says less changes nothing
    twice.calibrate(np.repeat(x, 2, axis=0) - np.tile([[0.0], [5.0]], (440, 1)), y, first=np.arange(0, 880, 2))
    assert twice.threshold == pytest.approx(net.threshold)


def test_candidates_reach_past_base_spans():
    token = "Zk9Q" + "0123456789abcdef" * 2 + "WqX7rT"
    text = f"see {token} and token = {token} too"
    spans = secrets.base_spans(text)
    at = text.index(token)
    assert secrets.candidates(text, spans) == [(at, at + len(token))]  # the second lies in the assignment
    assert secrets._inside(2, 9, [(0, 4, "hex"), (4, 9, "hex")]) and not secrets._inside(2, 9, [(0, 4, "hex"), (5, 9, "hex")])


def test_windows_cover_the_candidate():
    for n in (16, 48, 49, 72, 73, 500):
        parts = secrets.windows(7, 7 + n)
        assert {i for a, b in parts for i in range(a, b)} == set(range(7, 7 + n)) and all(b - a <= secrets.BODY for a, b in parts)


def test_tokens_are_redacted_whole_and_long_ones_seen_whole(make_docs):
    around = "Zk9QpLwG" + "0123456789abcdef" * 2 + "WqX7rTm3"
    words = "/thering/oneinan/resting/andinte"
    long = "a1" + words + "/" + some(60, 5) + words
    texts = {1: f"see {around} there", 2: f"see {long} there", 3: f"see a1{words * 3} there"} | {10 + i: f"token = {some(32, i)} and mail{i}.thering.com/index{i}.html" for i in range(40)}
    docs = make_docs(texts)
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert got[1] == "see [REDACTED] there" and got[3] == texts[3]
    net = secrets.train(docs.filter("doc_id >= 10"))  # what it is taught as harmless is not what it is asked
    net.threshold = 0.5
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs, net, ["doc_id"]).select("row.doc_id", "out.spans").collect()}
    assert spans[1] == [("learned", 4, 4 + len(around)), ("hex", 12, 44)]
    assert spans[2] == [("learned", 4, 4 + len(long))] and spans[3] == []


def test_what_is_taught_as_harmless():
    assert all(secrets._HARMLESS.fullmatch(x) for x in ("mail7.example.com", "www2.site.org", "2024-05-06T10-00", "pkg-name-v1.2.33", "0a1b2c3d-0000-4abc-8def-001122334455"))
    assert not any(secrets._HARMLESS.fullmatch(x) for x in ("Zk9QpLwG01WqX7rTm3", "ghp_a8B7c6D5e4F3g2H1i0J9", "a1/thering/oneinan"))
    text = "write to some.one@mail7.example.com or use Zk9QpLwG01WqX7rTm3 now, " + "token = " + some(32, 1)
    got = secrets._findings([text.encode(), None])
    assert got["y"] == [[1, 0], []]  # the unknown token is not shown at all


def test_candidates_of_letters_only():
    found = lambda t: [t[a:b] for a, b in secrets.candidates(t, [])]
    assert found("see QwErTyUiOpAsDfGhJkLz here") == ["QwErTyUiOpAsDfGhJkLz"]
    assert found("Donaudampfschifffahrtsgesellschaft McDonaldsRestaurants Neuseeland") == []
    assert found("abc123def456 short1") == ["abc123def456"]


def test_recall_of_planted_secrets(make_docs):
    """Secrets of formats that no base pattern names, planted among words; clean texts stay clean."""
    texts, where = {i: f"plain words of the {i} page, write to mail{i}.{'abc'[i % 3]}den.com or see the index" for i in range(200)}, {}
    for k, (text, a, b, good) in enumerate(secrets.made_findings(400, seed=77)):
        if good:
            texts[1000 + k], where[1000 + k] = text, (a, b)
    rows = secrets.report(make_docs(texts)).collect()
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in rows}
    hit = [any(s < b and a < e for s, e in spans[k]) for k, (a, b) in where.items()]
    assert sum(hit) >= 0.9 * len(hit)
    assert sum(not spans[k] for k in range(200)) >= 195


def learned(net):
    return np.concatenate([[net.slope, net.shift, net.threshold], *[v.ravel() for v in net.p.values()]])


def test_network_learns_from_every_document(make_docs):
    """Findings that lie only in documents beyond the 2,000 with the smallest hashes, or without an id, are learned from."""
    texts = {i: f"plain words of the {i} page" for i in range(2_100)}
    beyond = set(texts) - {r.id for r in sample_ids(make_docs(texts), "doc_id", 2_000).collect()}
    assert len(beyond) == 100
    rest = learned(secrets.train(make_docs(texts)))
    assert not np.array_equal(learned(secrets.train(make_docs(texts | {i: f"token = {some(32, i)}" for i in beyond}))), rest)
    assert not np.array_equal(learned(secrets.train(make_docs([*texts.items(), *((None, f"token = {some(32, i)}") for i in range(100))]))), rest)


def test_lessons_are_all_findings_once(make_docs):
    texts = [(i % 70 or None, f"secret: {some(20 + i, i % 90)} or mail{i % 50}.den.com and {'0a' * (i // 2)} end" if i % 9 else None) for i in range(150)]
    docs = make_docs(texts + texts[:40])
    want = set()
    for _, t in texts:
        got = secrets._findings([t.encode() if t else None])
        want |= {(w, y) for x, y in zip(got["x"][0], got["y"][0]) for w in x}
    rows = secrets.lessons(docs).collect()
    bare = {bytes(secrets.SIDE) + w[secrets.SIDE : -secrets.SIDE] + bytes(secrets.SIDE) for w, y in want if y}
    shown = {(bytes(r.x), r.y) for r in rows}
    assert want <= shown and {w for w, _ in shown - want} <= bare
    assert len({(r.finding, r.y, bytes(r.x)) for r in rows}) == len(rows)
    assert len({r.value for r in rows if r.finding == r.value}) > 20  # about half of the true ones also without context


def test_shards_agree_over_layouts_and_find(make_docs):
    texts = {i: f"token = {some(32, i)} and mail{i}.thering.com/index{i}.html" for i in range(300)}
    docs = make_docs(texts)
    net = secrets.train(docs, shard=100)
    assert np.array_equal(learned(net), learned(secrets.train(docs.repartition(7, "text"), shard=100)))
    made = secrets.made_findings(600, seed=78)
    p = net.probability(np.stack([secrets.encode(t, a, b) for t, a, b, _ in made])) >= net.threshold
    y = np.array([m[3] for m in made])
    assert p[y == 1].mean() >= 0.9 and p[y == 0].mean() < 0.05


def test_threshold_counts_every_held_finding():
    """Counts by cell give what the findings one by one give."""
    r = np.random.default_rng(2)
    y = (r.random(3_000) < 0.3).astype(float)
    z = r.normal(0, 1, 3_000) + y
    one, all_ = Given(), Given()
    one.calibrate(z[:, None], y)
    cell, n = np.unique(np.stack([secrets.cells(z), y.astype(int)]), axis=1, return_counts=True)
    all_.settle(cell[0].astype(float), cell[1].astype(float), n.astype(float))
    assert (all_.slope, all_.shift, all_.threshold) == pytest.approx((one.slope, one.shift, one.threshold))
    assert (one.probability(z[y > 0][:, None]) >= one.threshold).mean() >= secrets.RECALL


def test_findings_of_a_long_text_take_linear_time():
    text = " ".join(f"token = {some(16, i % 100)} mail{i}.den.com" for i in range(30_000))
    began = time.process_time()
    got = secrets._findings([text.encode()])
    assert len(got["y"][0]) == 60_000 and sum(got["y"][0]) == 30_000
    assert time.process_time() - began < 30
