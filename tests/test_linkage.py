"""Blocking, features, mining, files and output on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.normalize import normalize
from tessera.operators import blocking, dense, evaluate, features, learn, metric, mining, output
from tessera.sources import io as files


def recs(spark, rows):
    return normalize(spark.createDataFrame(rows, "idx long, src int, country string, business_name string, business_address string")).withColumn("raw_addr", F.col("business_address"))


def test_block_survives_typos_and_swaps(spark):
    r = recs(spark, [(1, 1, "US", "Blue River Bakery", "12 Oak Street, Salem"), (2, 2, "US", "Blue Rivr Bakery", "12 Oak St, Salem"), (3, 3, "US", "Quite Other Name", "12 Oak Street, Salem"), (4, 2, "FR", "Blue River Bakery", "12 Oak Street, Salem"), (5, 2, "US", None, None)])
    got = {(x.s1_idx, x.t_idx): x for x in blocking.block(r.where("src = 1"), r.where("src > 1")).collect()}
    assert set(got) == {(1, 2), (1, 3)}
    assert got[1, 3].bs_name == 0 and got[1, 3].bs_addr > 0 and got[1, 2].nk_name > 0


def test_key_families(spark):
    """Every family on one record: the first tokens count, then their length."""
    row = (1, "US", ["a", "bakery", "blue", "of", "river", "bakeries"], ["bkr", "bl", "rvr", "k", "zz"], ["salem", "x", "oregon"], ["oak", "st", "elm", "pine"], ["12", "7", "305", "9"], "C-0346 and 19-b, c12")
    r = spark.createDataFrame([row], "idx long, country string, core array<string>, skel array<string>, loc array<string>, street array<string>, nums array<string>, raw_addr string")
    got = {}
    for x in blocking.keys(r, hashed=False).collect():
        got.setdefault(x.fam, set()).add(x.key)
    core, loc, nums, ids = ["bakery", "blue", "of"], ["salem"], ["12", "7", "305"], ["c346", "19b", "c12"]
    pairs = lambda t: {f"{a}|{b}" for a in t for b in t if a < b}
    cross = lambda a, b: {f"{x}|{y}" for x in a for y in b}
    assert got == {
        "n": set(core), "s": {"bkr", "rvr"}, "np": pairs(core), "sp": pairs(["bkr", "bl", "rvr"]), "nl": cross(core, loc), "sl": cross(["bkr", "rvr"], loc),
        "nx": cross(["bake", "blue"], loc), "fn": {"a bakeries bakery blue of river"}, "fs": {"12r 1l 22 r1r"},
        "a1": cross(nums, ["oak", "elm"]), "a2": cross(nums, loc), "a4": pairs(nums), "aa": pairs(["oak", "elm", "salem"]), "h0": set(ids), "h1": cross(ids, loc),
    }


def test_hashed_and_readable_keys_agree(spark):
    r = recs(spark, [(k, 1 + k % 3, "US", f"name{k % 5} word{k % 3}", f"{k % 4} Elm Road, Town{k % 2}") for k in range(60)])
    a, b = (blocking.block(r.where("src = 1"), r.where("src > 1"), hashed=h).select("s1_idx", "src", "t_idx", F.round("bs", 6), "nkeys").collect() for h in (True, False))
    assert sorted(a) == sorted(b)


def test_frequency_cap(spark):
    r = recs(spark, [(0, 1, "US", "common rare", None)] + [(k, 2, "US", "common", None) for k in range(1, 9)] + [(9, 2, "US", "rare", None)])
    got = blocking.block(r.where("src = 1"), r.where("src > 1"), ("n",), single=5).collect()
    assert [x.t_idx for x in got] == [9]


def test_competition_of_a_sole_candidate(spark):
    df = spark.createDataFrame([(1, 2, 5, 0.7), (2, 2, 6, 0.9), (3, 2, 6, 0.4), (4, 2, 6, 0.9)], "s1_idx long, src int, t_idx long, bs double")
    got = {r.s1_idx: r for r in features.competition(df, "bs").collect()}
    assert got[1].tx_margin == 0.7 and got[2].tx_margin == 0 and got[3].tx_rank == 3 and got[3].tx_margin == pytest.approx(-0.5)


def test_anchor_is_not_itself(spark):
    df = spark.createDataFrame([(1, 2, 5, 0.7), (1, 2, 6, 0.9), (1, 3, 7, 0.4), (2, 2, 8, 0.9)], "s1_idx long, src int, t_idx long, p1 double")
    texts = spark.createDataFrame([(2, 5, "a b", ""), (2, 6, "a b", "x"), (3, 7, "c", None), (2, 8, "d", "d")], "src int, idx long, name string, address string")
    got = {(r.s1_idx, r.t_idx): r for r in features.coherence(df, texts).collect()}
    assert got[1, 5].coh_c_same == 100 and got[1, 6].coh_c_same == -1 and got[1, 6].coh_c_oth == 0 and got[2, 8].coh_c_oth == -1


def test_mining(spark):
    rows = [(["blue", "cafe"], ["blue", "cafe", "store"])] * 40 + [(["sonata"], ["sonatta"])] * 6 + [(None, ["x"])]
    pairs = spark.createDataFrame(rows, "a array<string>, b array<string>")
    rate = {r.tok: r.rate for r in mining.filler_rates(pairs.where("a IS NOT NULL")).collect()}
    assert rate["store"] == pytest.approx(40.5 / 41) and rate["blue"] == pytest.approx(0.5 / 41)
    assert [(r.tok, r.alias) for r in mining.token_aliases(pairs, max_known=10).collect()] == [("sonatta", "sonata")]
    assert mining.pure(pairs.limit(0).select(F.lit(1).alias("k"), F.lit(2).alias("v")), "k", "v", 1, 0.5).count() == 0


def test_pseudo_aliases(spark):
    keys = [(i, 2, i) for i in range(6)]
    scores = spark.createDataFrame([(*k, 0.98) for k in keys] + [(9, 2, 0, 0.99), (7, 2, 7, 0.5), (8, 2, 8, None)], "s1_idx long, src int, t_idx long, p double")
    tokens = spark.createDataFrame([(*k, ["red", "widget"], ["red", "widgett"]) for k in [*keys, (9, 2, 0), (7, 2, 7), (8, 2, 8)]], "s1_idx long, src int, t_idx long, a array<string>, b array<string>")
    # (0, 2, 0) is not the best of its target; unsure and null scores do not count
    assert [tuple(r) for r in mining.pseudo_aliases(scores, tokens).select("tok", "alias", "n", "total").collect()] == [("widgett", "widget", 6, 6)]
    assert mining.pseudo_aliases(scores.limit(0), tokens).count() == 0


def test_files_go_to_the_shared_folder():
    from types import SimpleNamespace as Fake

    from tessera.plans.linkage import _folder

    def session(shared, master):
        return Fake(conf=Fake(get=lambda key, default: shared), sparkContext=Fake(master=master))

    assert _folder(session("hdfs://shared", "spark://driver"), "x").startswith("hdfs://shared/x-")
    assert _folder(session(None, "local[8]"), "x").startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _folder(session(None, "spark://driver"), "x")


def test_writer_and_validator(spark, tmp_path, monkeypatch):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-9"), ("S1-1", "S2-4"), ("S1-1", "S2-4"), ("S1-2", "S2-7")], "source1_entity_id string, id string")
    output.write_submission(pairs, pairs.limit(0), ids, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out/matches").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-4,S3-9\nS1-2\tS2-7\nS1-3\t\n"
    known = pairs.select("id").distinct()
    assert all(r.violations == 0 for r in output.validate_file(spark, f"file://{tmp_path}/out/matches", ids, known).collect())
    back = files.read_submission(spark, f"file://{tmp_path}/out/matches")
    assert sorted(map(tuple, back.collect())) == [("S1-1", "S2-4"), ("S1-1", "S3-9"), ("S1-2", "S2-7")]
    files.zip_file(next(str(p) for p in (tmp_path / "out/matches").glob("part-*")), str(tmp_path / "r.zip"))
    with monkeypatch.context() as m, pytest.raises(ValueError, match="unpacks"):
        m.setattr(files, "ZIP_BYTES", 10)
        files.read_submission(spark, f"file://{tmp_path}/r.zip")
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS1-1,S2-4,S2-4\nS1-1\tS2-99\n")
    bad = {r.rule: r.violations for r in output.validate_file(spark, f"file://{tmp_path}/bad.tsv", ids, known).collect()}
    assert bad == {"header": 0, "columns": 0, "repeated_rows": 1, "repeated_ids": 1, "self_matches": 1, "wrong_prefix": 1, "unknown_ids": 2, "missing_records": 2, "extra_records": 0}
    with pytest.raises(ValueError, match="wrong_prefix"):
        output.write_submission(pairs.withColumn("id", F.lit("S1-5")), pairs, ids, f"file://{tmp_path}/out2")


def test_nearest_is_exact(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    m = {k: x / np.linalg.norm(x) for k, x in v.items()}
    got = dense.top_k(e.where("vec_id % 100 = 0"), e, 4).collect()
    for q in {r.q_id for r in got}:
        want = sorted(m, key=lambda t: (-round(float(m[q] @ m[t]), 9), t))[:4]
        assert [r.t_id for r in sorted(got, key=lambda r: r["rank"]) if r.q_id == q] == want


def test_gate(spark):
    a = spark.createDataFrame([(k, "x" if k % 2 else "y", 0.5) for k in range(300)], "s1_idx long, country string, f05 double")
    res = evaluate.paired_bootstrap(a, a.withColumn("f05", F.lit(0.6)), "country", 50)
    assert res.count() == 3 and evaluate.gate(res).first().accept
    assert not evaluate.gate(evaluate.paired_bootstrap(a, a, "country", 50)).first().accept


def test_out_of_fold(spark):
    rows = spark.createDataFrame([(k, 2, k, float(k % 10), int(k % 10 > 4), k // 10 % 2) for k in range(200)], "s1_idx long, src int, t_idx long, x double, y int, fold int")
    models, feats = learn.fit_folds(rows, rounds=3, depth=2)
    assert feats == ["x"]
    got = learn.predict_folds(models, rows, feats)
    assert got.where("(p1 > 0.5) <> (y = 1)").count() == 0


def test_pushdown(spark, tmp_path):
    files.save_stage(spark.createDataFrame([("US", 2, 1, "a"), ("FR", 3, 2, "b")], "country string, src int, idx int, name string"), f"file://{tmp_path}", "s")
    df = files.load(spark, f"file://{tmp_path}", "s", 2, "US", ["idx"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.collect()[0].idx == 1 and "PartitionFilters: [isnotnull" in plan and "ReadSchema: struct<idx:int>" in plan


def test_pseudo_aliases_count_every_pair(spark, sf, monkeypatch):
    import __spark_entry__ as entry
    from tessera.plans import linkage

    n = 120_000
    monkeypatch.setattr(linkage, "token_pairs", lambda s, d: s.range(n).selectExpr("array('blue', 'widget') AS a", "array('blue', 'widgett') AS b"))
    got = entry.queries()["m11_pseudo_aliases"](spark, sf).collect()
    assert [(r.tok, r.alias, r.n, r.total) for r in got] == [("widgett", "widget", n, n)]


def test_queries_block_by_the_operators_caps(spark, sf, monkeypatch):
    """A name token of 60 targets keeps its weight in the registered query."""
    import __spark_entry__ as entry
    from tessera.plans import extra

    rows = spark.range(60).selectExpr("id AS idx", "2 AS src", "'X' AS country", "array('steel') AS core", "array('steel') AS skel", "array('x') AS loc", "array('x') AS street", "array('1') AS nums", "'1 x' AS raw_addr")
    monkeypatch.setattr(extra, "records", lambda s, d: rows)
    assert [r.df for r in entry.queries()["b05_capped_weights"](spark, sf).collect()] == [60]
