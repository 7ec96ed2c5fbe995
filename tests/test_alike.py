"""Pairs by classes: every pair is there once, and what is costly runs once for two classes."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.operators import alike, mining
from tessera.plans import linkage

NAMES = "red ring", "blue ring", None, ""


def pairs_of(spark, monkeypatch, chunk):
    monkeypatch.setattr(alike, "CHUNK", chunk)
    rows = [(k, k % 2, NAMES[k % 4 if k % 3 else 0]) for k in range(40)]
    df = spark.createDataFrame(rows, "idx long, place int, name string")
    one = alike.classes(df.withColumnRenamed("name", "a"), ["place"], ["a"], "xs")
    two = alike.classes(df.withColumnRenamed("name", "b"), ["place"], ["b"], "ys")
    want = sorted((i, j, a, b) for i, p, a in rows for j, q, b in rows if p == q and i < j)
    return alike.class_pairs(one, two, ["place"], 4, ["a", "b"]), want


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_every_pair_once(spark, monkeypatch, chunk):
    pairs, want = pairs_of(spark, monkeypatch, chunk)
    none = lambda rows: sorted((i, j, a or "-", b or "-") for i, j, a, b in rows)
    assert none(tuple(r) for r in alike.expand(pairs, "a", "b").select("ia", "ib", "a", "b").collect()) == none(want)
    assert pairs.select(alike.count_pairs("xs", "ys").alias("n")).agg(F.sum("n")).first()[0] == len(want)
    assert chunk == 1 or pairs.count() < len(want)


def test_a_task_scores_equal_pairs_once(spark, monkeypatch):
    """Copies in several batches: a text pair is scored once, not once a batch."""
    calls = spark.sparkContext.accumulator(0)

    def counted(a, b):
        calls.add(1)
        return 1.0

    monkeypatch.setitem(similarity._SCORERS, "ratio", counted)
    df = spark.range(0, 45_000, 1, 1).select(F.lit("x").alias("a"), F.lit("y").alias("b"))
    assert df.select(similarity.all_metrics(F.col("a"), F.col("b"), ("ratio",))["ratio"].alias("r")).agg(F.sum("r")).first()[0] == 45_000
    assert calls.value == 1


def scored_pairs(spark, monkeypatch, query, n=60):
    """Text pairs that reach the scorer when *n* records share two names, one number and brand."""
    from tessera.plans import roles

    part = spark.range(n).selectExpr("id AS p_partkey", "CASE id % 2 WHEN 0 THEN 'red ring' ELSE 'blue ring' END AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "1 AS p_size")
    monkeypatch.setattr(linkage, "role", lambda s, d, name: s.sql(roles.ROLES[name].replace("FROM part", "FROM {part}"), part=part))
    rows = query(spark, None)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    return rows.count(), plan


@pytest.mark.parametrize("name", ["f06_all_metrics", "m03_weak_labels", "sim01_ratio", "sim02_partial", "sim03_token_sort", "sim04_token_set", "sim05_wratio", "sim06_jaro_winkler", "f08_idf_overlap", "f15_lexical_pack", "f02_flags"])
def test_queries_list_every_pair_after_the_work(spark, monkeypatch, name):
    n, plan = scored_pairs(spark, monkeypatch, linkage.QUERIES[name])
    assert n == 60 * 59 // 2
    lines = plan.split("\n")
    loops = [k for k, x in enumerate(lines) if "Generate explode(" in x][:2]
    # scorers and aggregates stand below the two loops that list the pairs
    assert "explode(ys" in lines[loops[0]] and "explode(xs" in lines[loops[1]] and not any("ArrowEvalPython" in x or "Aggregate" in x or "Join" in x for x in lines[: max(loops)])


def test_rows_stand_for_many_pairs(spark):
    """Mining of weighted rows gives what their copies give."""
    rows = [(["blue", "cafe"], ["blue", "cafe", "store"], 40), (["sonata"], ["sonatta"], 6), (["sonata", "x"], ["sonatta", "y"], 2)]
    few = spark.createDataFrame(rows, "a array<string>, b array<string>, n_pairs long")
    many = spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "a array<string>, b array<string>")
    for mine in (lambda p: mining.filler_rates(p, 2), lambda p: mining.token_aliases(p, max_known=10), lambda p: mining.transliterations(p), lambda p: mining.part_aliases(p)):
        assert sorted(map(tuple, mine(few).collect())) == sorted(map(tuple, mine(many).collect())) != []


def test_token_pairs_are_counted_not_listed(spark, monkeypatch):
    n, _ = scored_pairs(spark, monkeypatch, linkage.token_pairs)
    assert n <= 8 and linkage.token_pairs(spark, None).agg(F.sum("n_pairs")).first()[0] == 60 * 59 // 2
