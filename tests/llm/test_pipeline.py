"""Each pipeline stage on its predecessor's rows, against what it promises."""

import re

import corpus_pipeline
from tessera.llm import decontam, quality
from tessera.llm.store import stage, table
from brute_forms import shingles


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = stage(apply(spark, docs, sf), "test")
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        assert ids <= set(before)
        if k < 4:
            assert out.columns == columns
            assert all(r == before[r.doc_id] for r in rows)
        gone = set(before) - ids
        if name == "quality rules":
            judged = {r.doc_id: r.kept for r in quality.op1_quality_rules(spark, sf).collect()}
            assert ids == {d for d, kept in judged.items() if kept} and len(rows) == len(ids)
        if name == "minhash near-dedup":
            sets = {d: shingles(r.text, 5) for d, r in before.items()}
            like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            assert all(any(like(d, o) for o in before if o < d) for d in gone)
            assert not any(like(a, b) for a in ids for b in ids if a < b and sets[a])
        if name == "benchmark decontamination":
            hit = decontam.judged(docs, table(spark, sf, "benchmark"), ["doc_id"]).where("contaminated").collect()
            assert gone == {r.row__.doc_id for r in hit}
        if name == "mixing to target weights":
            labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
            clean = [d for d in before if d in labels and labels[d].quality == 1 and labels[d].toxic == 0]
            assert sum(d in ids for d in clean) >= 0.95 * len(clean)
        if name == "sharding":
            assert len(rows) == docs.count() and not gone
        docs, before = out, {r.doc_id: r for r in rows}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and re.match("sharding", corpus_pipeline.STAGES[-1][0])
