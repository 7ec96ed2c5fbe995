"""The whole set of pair features: each of its stages reaches the result of full_pair_features, and agrees with its operator."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.operators import features
from tessera.plans import extra


def test_every_feature_reaches_the_result(spark, sf):
    df = extra.full_features(spark, sf)
    made = {f"n_{m}" for m in sim.METRICS} | {f"c_{m}" for m in sim.METRICS} | {"a_ratio", "a_partial", "a_token_sort", "a_token_set"}
    made |= {f"{c}_{k}" for c in ("core", "skel", "at", "num", "loc", "str") for k in ("inter", "jac", "c12", "c21", "n1", "n2")}
    made |= {"h_eq", "a_missing2", "h_has1", "h_has2", "h_logdiff", "state_eq", "legal_inter", "nfreq2", "core_widf", "core_wjac", "core_wc12", "core_wc21", "core_mass1"}
    made |= {"cx_n", "cx_rel", "cx_gap_c", "cx_gap_a", "cx_rank_c", "tx_n", "tx_rank", "tx_gap", "tx_rel", "tx_margin", "tx_gap_c", "sib_heq_n", "sib_hne_n", "sib_alike_n", "sib_heq_oth", "sib_heq_cgap", "sib_cgap"}
    assert made <= set(df.columns) and not [c for c in df.columns if c.endswith(("_1", "_2"))]
    got = extra.QUERIES["full_pair_features"](spark, sf)
    assert {{"wratio": "n_wratio", "wjac": "core_wjac"}.get(c, c) for c in got.columns} >= made


def test_weights_of_records_give_the_overlap_of_pairs(spark):
    rows = [(1, "US", ["a", "b", "b"]), (2, "US", ["b", "c"]), (3, "US", []), (4, "US", None), (5, "US", ["c", "d", "e"]), (6, "FR", ["a", "b"])]
    r = spark.createDataFrame(rows, "idx long, country string, core array<string>")
    idf = features.token_idf(r.where("core IS NOT NULL"), "core").where("tok <> 'e'")
    w = r.join(features.token_weights(r, idf, "core"), "idx", "left")
    a, b = w.selectExpr("country", "idx AS s1_idx", "core AS a", "core_w AS aw"), w.selectExpr("country AS c2", "2 AS src", "idx AS t_idx", "core AS b", "core_w AS bw")
    pairs = a.join(b, F.col("country") == F.col("c2"))
    want = {tuple(x)[:2]: tuple(x)[2:] for x in features.idf_overlap(pairs, idf, "core").select("s1_idx", "t_idx", "core_widf", "core_wjac", "core_wc12", "core_wc21", "core_mass1").collect()}
    new = features.weighted_overlap(F.col("aw"), F.col("bw"), "core")
    got = {tuple(x)[:2]: tuple(x)[2:] for x in pairs.select("s1_idx", "t_idx", *[c.alias(k) for k, c in new.items()]).collect()}
    known = [k for k in want if 4 not in k]
    assert len(got) == 26 and all(got[k] == pytest.approx(want[k]) for k in known) and got[1, 2][0] > 0 and got[1, 4][0] == 0


def test_sibling_windows_are_the_join(spark):
    rows = [(1, 2, 5, 1, 90.0), (2, 2, 5, 0, 70.0), (3, 2, 5, -1, None), (1, 3, 5, 1, 80.0), (2, 3, 6, None, 10.0)]
    pairs = spark.createDataFrame(rows, "s1_idx long, src int, t_idx long, h_eq int, c_tset double")
    joined = pairs.join(features.siblings(pairs), ["src", "t_idx"], "left")
    got = features.sibling_features(pairs)
    assert got.columns[: len(joined.columns)] == joined.columns
    assert sorted(map(str, got.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
