"""What keeps blocking in bounds: pairs are not shuffled to be scored, equal records are blocked once, tables are not sent whole."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking


def table(spark, rows):
    return spark.createDataFrame(rows, "idx long, src int, country string, core array<string>, skel array<string>, loc array<string>, street array<string>, nums array<string>, raw_addr string")


def record(idx, src, *core):
    return (idx, src, "US", list(core), [], [], [], [], None)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_pairs_are_listed_behind_the_last_shuffle(spark):
    r = table(spark, [record(k, 1 + k % 3, "blue", f"w{k % 4}") for k in range(30)])
    one, two = r.where("src = 1"), r.where("src > 1")
    pairs = blocking.keep_budgets(blocking.score_pairs(blocking.keys(one), blocking.weighted_keys(two, blocking.keys(two, extra=("src",)))))
    plan = executed(pairs)
    listed = next(k for k, x in enumerate(plan) if "Generate explode(ts" in x)
    assert any("Window" in x for x in plan[:listed]) and not any("Exchange" in x for x in plan[:listed])


def test_equal_records_share_their_candidates(spark, monkeypatch):
    r = table(spark, [record(k, 1, "blue", "river") for k in range(5)] + [record(5, 1, "blue", "lake"), record(6, 1, "none")] + [record(10 + k, 2 + k % 2, "blue", "river") for k in range(4)])
    reached, scored = [], blocking.score_pairs
    monkeypatch.setattr(blocking, "score_pairs", lambda keys, weighted: (reached.append(keys.select("idx").distinct().count()), scored(keys, weighted))[1])
    got = blocking.block(r.where("src = 1"), r.where("src > 1")).groupBy("s1_idx").agg(F.collect_set("t_idx").alias("t"), F.count_distinct("bs").alias("n")).collect()
    assert {x.s1_idx: (sorted(x.t), x.n) for x in got} == {k: ([10, 11, 12, 13], 1) for k in range(6)}
    assert reached == [3]


def test_report_reads_the_pairs_once(spark):
    pairs = spark.createDataFrame([("US", 1, 2, k, 1.0 / k) for k in range(1, 31)] + [("FR", 2, 2, 1, 1.0)], "country string, s1_idx long, src int, t_idx long, bs double")
    truth = spark.createDataFrame([("US", 1, 2, 3), ("US", 1, 2, 15), ("US", 1, 2, 29), ("US", 1, 2, 99), ("DE", 5, 2, 1)], "country string, s1_idx long, src int, t_idx long")
    ids = spark.createDataFrame([("US",), ("US",), ("FR",), ("DE",)], "country string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    got = {r.country: tuple(r)[1:] for r in blocking.report(pairs.withColumn("bs", counted("bs")), truth, ids).collect()}
    assert got == {"US": (4, 0.75, 0.25, 0.5, 15.0), "DE": (1, 0.0, 0.0, 0.0, None)}
    assert read.value == 31


@pytest.mark.parametrize("name", ["f09_flags", "f01_cheap_strings"])
def test_records_are_not_sent_whole(spark, sf, name):
    """Their files are small, the normalised rows are not."""
    from tessera.plans import extra

    text = "\n".join(executed(extra._pair_text(spark, sf)))
    assert text.split("Join")[0].count("Broadcast") == 0 and "SortMergeJoin [src" in text and "SortMergeJoin [s1_idx" in text
