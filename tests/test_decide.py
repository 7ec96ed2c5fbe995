"""The decision layer against enumeration of all outcomes, and its behaviour on small tables."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import decide, metric
from tessera.operators.decide import Params


def enumerated(ps, k, m0):
    """Expected F0.5 of the first k of independent pairs, over all outcomes."""
    if k == 0:
        return math.prod(1 - p for p in ps) * math.exp(-m0)
    total = 0.0
    for out in itertools.product((0, 1), repeat=len(ps)):
        w = math.prod(p if o else 1 - p for p, o in zip(ps, out))
        total += w * 1.25 * sum(out[:k]) / (k + 0.25 * (sum(out) + m0))
    return total


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0.01, 0.99), min_size=1, max_size=5), st.sampled_from([0.0, 0.5]))
def test_expected_f(spark, ps, m0):
    got = spark.createDataFrame([(ps,)], "ps array<double>").select(decide.expected_f_exact("ps", m0).alias("ef")).first().ef
    assert got == pytest.approx([enumerated(ps, k, m0) for k in range(len(ps) + 1)], abs=1e-9)


def scores(spark, rows):
    return spark.createDataFrame(rows, "s1_idx long, src int, t_idx long, p double")


def chosen(df):
    return {(r.s1_idx, r.src, r.t_idx) for r in df.collect()}


def test_clear_pair_and_noise(spark):
    df = scores(spark, [(1, 2, 10, 0.98), (1, 2, 11, 0.05), (2, 2, 12, 0.2), (3, 3, 10, 0.9)])
    for got in (decide.select(df), decide.select_exact(df)):
        assert chosen(got) == {(1, 2, 10), (3, 3, 10)}


def test_target_has_one_owner(spark):
    df = scores(spark, [(1, 2, 10, 0.9), (2, 2, 10, 0.85)])
    assert chosen(decide.select(df)) == {(1, 2, 10)}
    assert chosen(decide.select(df, Params(margin=0.1))) == set()
    assert chosen(decide.select(df, Params(exclusive=False))) == {(1, 2, 10), (2, 2, 10)}


def test_coherent_posterior(spark):
    got = {r.s1_idx: r.p for r in decide.coherent(scores(spark, [(1, 2, 10, 0.9), (2, 2, 10, 0.5)]), 1.0).collect()}
    assert got[1] == pytest.approx(9 / 11) and got[2] == pytest.approx(1 / 11)


def test_certain_pair(spark):
    assert chosen(decide.select(scores(spark, [(1, 2, 10, 1.0)]))) == {(1, 2, 10)}


def test_grid_is_a_loop(spark):
    df = scores(spark, [(i % 7, 2 + i % 2, i % 11, ((i * 37) % 90 + 5) / 100) for i in range(60)]).dropDuplicates(["s1_idx", "src", "t_idx"])
    pts = [(0, 0.0, 0.0, 0.2, 1.0), (1, 0.1, 0.0, 0.5, 2.0)]
    every = decide.grid(df, spark.createDataFrame(pts, "point int, margin double, floor double, m0 double, empty_bias double")).collect()
    for k, margin, floor, m0, bias in pts:
        assert {(r.s1_idx, r.src, r.t_idx) for r in every if r.point == k} == chosen(decide.select(df, Params(margin, floor, m0, bias)))


def test_tune_is_select_and_macro(spark):
    df = scores(spark, [(i % 7, 2 + i % 2, i % 11, ((i * 37) % 90 + 5) / 100) for i in range(60)]).dropDuplicates(["s1_idx", "src", "t_idx"])
    truth = df.where("(s1_idx + t_idx) % 3 = 0").select("s1_idx", "src", "t_idx").unionByName(spark.createDataFrame([(9, 2, 1)], "s1_idx long, src int, t_idx long"))
    ids = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(11)], "s1_idx long, country string")
    pts = [(0, 0.0, 0.0, 0.2, 1.0, 0.0), (1, 0.1, 0.4, 0.5, 2.0, 1.0), (2, 0.0, 0.0, 0.5, 0.0, 0.5)]
    table = spark.createDataFrame(pts, "point int, margin double, floor double, m0 double, empty_bias double, coh double")
    got = {(r.country, r.point): r.f05 for r in decide.tune(df, truth, ids, table, "country").collect()}
    for k, margin, floor, m0, bias, coh in pts:
        picked = decide.select(df, Params(margin, floor, m0, bias, coh=coh))
        assert chosen(picked) == {(r.s1_idx, r.src, r.t_idx) for r in decide.grid(df, table).collect() if r.point == k}
        for r in metric.macro_f05(picked, truth, ids, "country").where("country <> 'ALL'").collect():
            assert got[r.country, k] == pytest.approx(r.f05)
    none = decide.tune(df.limit(0), truth.limit(0), ids, table).collect()
    assert [r.f05 for r in none] == [1.0, 1.0, 1.0] and decide.grid(df.limit(0), table).count() == 0


def test_grid_shuffles_do_not_grow(spark):
    df = scores(spark, [(1, 2, 10, 0.9)]).repartition(4)

    def exchanges(n):
        pts = spark.createDataFrame([(i, 0.0, 0.0, 0.5, 1.0 + i) for i in range(n)], "point int, margin double, floor double, m0 double, empty_bias double")
        return decide.grid(df, pts)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(1) == exchanges(12) == 2


def test_macro_f05(spark):
    truth = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (2, 2, 3)], "s1_idx long, src int, t_idx long")
    pred = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 3, 9), (3, 2, 5), (3, 2, 5)], "s1_idx long, src int, t_idx long")
    ids = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "s1_idx long, country string")
    p, r = 2 / 3, 1.0
    first = 1.25 * p * r / (0.25 * p + r)
    got = metric.macro_f05(pred, truth, ids).first()
    assert got.f05 == pytest.approx((first + 0 + 0 + 1) / 4) and got.precision == pytest.approx((2 / 3 + 0) / 2) and got.singleton_f == 0.5
    assert metric.macro_f05(pred, truth, ids, "country").count() == 3


def test_exclusivity_uses_one_shuffle_for_each_partitioning(spark):
    plan = decide.select(scores(spark, [(1, 2, 10, 0.9)]).repartition(4))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(src") == 1 and plan.count("hashpartitioning(s1_idx") == 1


def test_queries_take_all_pairs(spark, sf):
    """d05 and d06 over every pair of a record, against enumeration."""
    import __spark_entry__ as entry
    from tessera.plans.roles import role

    by = {}
    for r in role(spark, sf, "scores").collect():
        by.setdefault(r.s1_idx, []).append(r.p)
    by = {k: sorted(v, reverse=True) for k, v in by.items()}
    some = sorted(by, key=lambda k: (abs(len(by[k]) - 8), k))[:20]
    assert all(len(by[k]) > 6 for k in some)
    d05 = {r.s1_idx: r for r in entry.queries()["d05_prefix_distribution"](spark, sf).collect()}
    d06 = {r.s1_idx: r for r in entry.queries()["d06_expected_f"](spark, sf).collect()}
    assert d05.keys() == by.keys() == d06.keys()
    for k in some:
        outs = list(itertools.product((0, 1), repeat=len(by[k])))
        chance = [math.prod(p if o else 1 - p for p, o in zip(by[k], out)) for out in outs]
        assert [d05[k][f"p{n}"] for n in range(3)] == pytest.approx([sum(c for c, out in zip(chance, outs) if sum(out) == n) for n in range(3)], abs=2e-5)
        assert [d06[k][f"ef{n}"] for n in range(4)] == pytest.approx([enumerated(by[k], n, 0.5) for n in range(4)], abs=2e-5)
