"""Mixing: what the report counts is what the splitting tree has dealt."""

from codecorpus.llm import mix
from tests.llm.test_operators import prose


def test_report_counts_dealt_copies(make_docs):
    docs = make_docs({i: prose(i, 10 + i % 30) for i in range(300)}, source={i: f"s{i % 3}" for i in range(300)})
    m = mix.mix(docs)
    rows = m.report().collect()
    dealt = {}
    for r in m.rows().collect():
        dealt.setdefault(r.doc_id, []).append((r.copy, r.shard))
    assert len(rows) == 300 and any(r.copies == 2 for r in rows)
    for r in rows:
        shards = [str(s) for _, s in sorted(dealt.get(r.doc_id, []))]
        assert (r.copies, r.taken, r.shards) == (len(shards), r.size * len(shards), ",".join(shards))
    all_units = sum(r.copies for r in rows)
    m.units = m.units.filter("shard < 8")  # what isn't dealt isn't taken
    some = m.report().collect()
    assert len(some) == 300 and 0 < sum(r.copies for r in some) < all_units
