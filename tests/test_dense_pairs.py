"""All pairs of a group by blocks, and the ensemble's passes over its rows."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import dense, learn


@pytest.mark.parametrize("block", [3, 1024])
def test_group_pairs_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "PAIR_BLOCK", block)
    vecs = {k: [math.sin(k * 7 + j) for j in range(4)] for k in range(23)} | {30: [0.0] * 4, 31: None, 32: [1.0, None, 0.0, 0.0], 33: [1.0, 2.0]}
    rows = [(k, k % 2, v) for k, v in vecs.items()] + [(40, None, [1.0] * 4), (41, 7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")

    def cos(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))

    want = {(i, j): cos(vecs[i], vecs[j]) for i in vecs for j in vecs if i < j and i % 2 == j % 2}
    got = dense.group_pairs(df, "label")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.q_id, r.t_id): r.cos for r in got.collect()}
    assert got.count() == len(found) and set(found) == set(want)
    assert all(found[k] == pytest.approx(want[k], abs=6e-6) for k in want)


def test_ensemble_computes_its_rows_once(spark):
    rows = spark.range(200).selectExpr("id AS s1_idx", "2 AS src", "id AS t_idx", "CAST(id % 10 AS DOUBLE) AS x", "CAST(id % 10 > 4 AS INT) AS y", "CAST(id div 10 % 2 AS INT) AS fold")
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    got = learn.ensemble(rows.withColumn("x", counted("x")))
    assert got.count() == 200 and got.where("(stacked > 0.5) <> (y = 1)").count() == 0
    assert read.value == 200
