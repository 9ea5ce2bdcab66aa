"""The pipeline's stages keep the columns, act on what they decide, and follow one another."""

import random

import corpus_pipeline
from codecorpus.llm import decontam, ngram_join, quality, secrets
from codecorpus.llm._text import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    kept, before = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, before, sf_dir), "stage")
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before.count()
        if name == "quality rules":
            rated = quality.report(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert {r.doc_id for r in rated.filter("kept").collect()} == {r.doc_id for r in kept.collect()}
        if name == "n-gram Jaccard join":
            texts = {r.doc_id: r.text for r in before.collect()}
            want = ngram_join.brute_force(texts)
            assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}
        if name == "benchmark decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
            counts = decontam.brute_force({r.doc_id: r.text for r in before.collect()}, items)
            clean = {k for k, (n, hit, _) in counts.items() if not (hit and 20 * hit >= n)}
            assert {r.doc_id for r in kept.collect()} == clean
        if name == "secret scans":
            assert kept.count() == before.count()
            assert not any(secrets.base_spans(r.text) for r in kept.collect())
            assert all(r.n_chars == len(r.text) for r in kept.collect() if "[REDACTED]" in r.text)
        before = kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() > 0
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in kept.collect()}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def long_text(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(r.randrange(50)) for _ in range(n))


def test_stages_on_odd_rows(spark, sf_dir, make_docs, with_clashes):
    """Null, empty and very long texts, repeated and null ids, null sources, clashing columns, and no rows at all."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first().text
    texts = [(1, None), (2, ""), (3, "  \n "), (4, long_text(4, 30_000)), (5, long_text(5)), (5, long_text(5)), (None, long_text(6)), (None, None), (7, long_text(5)), (8, item + " " + long_text(8, 30)), (9, long_text(9) + " token = abcdef0123456789abcdef")]
    docs = with_clashes(make_docs(texts, source={1: None, 5: "a", 7: "b"}))
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    every = [(r[0] is None, r[0] or 0) for r in texts]
    run = dict(corpus_pipeline.STAGES)
    good = run["quality rules"](spark, docs, sf_dir)
    rated = {(r.doc_id, r.n_words): r.kept for r in quality.report(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert ids(good) == sorted((i is None, i or 0) for i, t in texts if rated[i, len((t or "").split())])
    assert ids(run["n-gram Jaccard join"](spark, docs, sf_dir)) == sorted(set(every) - {(False, 7)} | {(True, 0)}) + [(True, 0)]
    assert ids(run["benchmark decontamination"](spark, docs, sf_dir)) == sorted(x for x in every if x != (False, 8))
    clean = run["secret scans"](spark, docs, sf_dir)
    assert ids(clean) == sorted(every) and not any("abcdef0123456789" in (r.text or "") for r in clean.collect())
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in clean.collect())
    mixed = run["mixing sources"](spark, docs, sf_dir)
    assert set(ids(mixed)) <= set(every) - {(False, 1), (False, 2), (False, 3)} and all(r.text and r.text.split() for r in mixed.collect())
    assert mixed.columns == docs.columns + ["mix_copy", "mix_shard", "mix_order_key"]
    for name, stage in corpus_pipeline.STAGES:
        none = stored(stage(spark, docs.limit(0), sf_dir), "none")
        assert none.count() == 0 and none.columns[: len(docs.columns)] == docs.columns, name
