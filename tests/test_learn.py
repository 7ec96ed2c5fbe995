"""Calibrators, saved models, parts of one source only, and analysis on small and empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions.similarity import ratio
from tessera.operators import analysis, learn, mining


def test_calibration_keeps_every_row(spark, tmp_path):
    rows = spark.createDataFrame([(i, 2 + i % 3, i, i / 40, int(i > 20)) for i in range(40)], "s1_idx long, src int, t_idx long, p1 double, y int")
    odd = spark.createDataFrame([(90, 9, 1, 1.5, None), (91, None, 1, 0.5, None), (92, 2, 1, None, None)], rows.schema)
    models = learn.fit_calibrators(rows.unionByName(odd))
    assert sorted(models) == [2, 3, 4]
    got = {r.s1_idx: r.p for r in learn.apply_calibrators(models, rows.unionByName(odd)).collect()}
    assert len(got) == 43 and got[90] == 1.0 and got[91] == 0.5 and got[92] is None
    learn.save_models(spark, [models[2]], ["p1"], f"file://{tmp_path}/m")
    (again,), names = learn.load_models(spark, f"file://{tmp_path}/m")
    assert names == ["p1"]
    one = {r.s1_idx: r.p for r in learn.apply_calibrators({2: again}, rows.where("src = 2")).collect()}
    assert one == {k: got[k] for k in one}


def test_source_parts(spark):
    ref = ["paris", "north rhine", "abc", "a"]
    new = ["pariss", "pari", "prais", "nrth rhine", "gironde", "abd", "b", "a", "north rhine westfalia", "", "paris 1", "xparis"]
    rows = [(i, 1, p) for p in ref for i in range(3)] + [(i, 2 + i % 2, p) for p in new for i in range(4)] + [(1, 1, None), (0, 1, "paris")]
    got = mining.source_parts(spark.createDataFrame(rows, "rec long, src int, part string"), min_count=4, min_reference=3)
    want = {p for p in new if p not in ref and all(ratio(p, r) < 80 for r in ref)}
    assert {r.part for r in got.collect()} == want


def test_likeness_needs_a_common_pair_of_letters():
    """What source_parts blocks by holds for all strings: no two of ratio 80 or more lack a common pair of letters, ends included."""
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)] + ["abcde", "abxde", "abcdefg", "bcdefg", "abdefg"]
    pairs = {w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)} for w in words}
    for a, b in itertools.product(words, repeat=2):
        if ratio(a, b) >= 80:
            assert pairs[a] & pairs[b] and 3 * len(a) >= 2 * len(b)


def test_analysis_of_empty_tables(spark):
    scores = spark.createDataFrame([], "s1_idx long, src int, t_idx long, p double")
    truth, ids = scores.select("s1_idx", "src", "t_idx"), spark.createDataFrame([], "s1_idx long, country string")
    labelled = analysis.with_label(scores, truth)
    for df in (analysis.calibration(labelled), analysis.anatomy(scores, truth, ids), analysis.siblings(labelled), analysis.structure(scores, scores, ids), analysis.bands(scores)):
        assert df.count() == 0
    assert analysis.errors(scores, truth).first().fp == 0
    assert analysis.tv_distance(truth, truth).first().tv is None


def test_errors_and_rules(spark):
    scores = spark.createDataFrame([(1, 2, 1, 0.9), (1, 2, 2, 0.8), (2, 2, 1, 0.6), (3, 2, 5, 0.1)], "s1_idx long, src int, t_idx long, p double")
    truth = spark.createDataFrame([(1, 2, 1), (1, 2, 1), (3, 2, 5), (3, 2, 6)], "s1_idx long, src int, t_idx long")
    assert analysis.errors(scores, truth).first().asDict() == {"fp": 2, "fn_not_candidate": 1, "fn_rejected": 1, "fp_singleton": 1}
    got = {r.what: r.n for r in analysis.probe(scores, analysis.claimed(0.7)).collect()}
    assert got == {"removed": 1, "kept": 3}
    twins = analysis.probe(scores.withColumn("place", F.when(F.col("s1_idx") == 1, F.lit("x"))), analysis.twin("place", "p"))
    assert {r.what: r.n for r in twins.collect()} == {"removed": 1, "kept": 3}
    assert analysis.with_label(scores, truth).agg(F.sum("y")).first()[0] == 2
    assert analysis.projection(spark.createDataFrame([(1, "a"), (2, "b")], "s1_idx long, country string"), {"a": 0.9}, 0.8, "b").first()[0] == pytest.approx(0.7)
