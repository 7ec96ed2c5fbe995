"""Comparison of two runs: paired bootstrap and acceptance gate."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Chances that a Poisson(1) draw is at most 0, 1, .. 7; a uniform draw becomes the number of them it passes.
POISSON = tuple(accumulate(exp(-1) / factorial(k) for k in range(8)))


def paired_bootstrap(a: DataFrame, b: DataFrame, by: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """By group and overall ('ALL'): f05 of both runs, their difference, and its 95 % interval.

    Each record weighs in each replicate by a Poisson(1) draw from a hash of its id, so records are
    resampled where they are: replicate sums are combined before the shuffle, and none is collected.
    """
    d = a.select("s1_idx", by, F.col("f05").alias("fa")).join(b.select("s1_idx", F.col("f05").alias("fb")), "s1_idx")
    # md5, so that other engines can repeat the draws; one draw a record and replicate, read by each cut
    rows = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    rows = rows.withColumn("u", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "r", "s1_idx")), 1, 8), 16, 10).cast("double") / float(1 << 32))
    rows = rows.withColumn("w", F.when(F.col("r") == 0, 1).otherwise(sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0))))
    sums = rows.groupBy(by, "r").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("fa")).alias("a"), F.sum(F.col("w") * F.col("fb")).alias("b"))
    sums = sums.withColumn(by, F.explode(F.array(F.lit("ALL"), F.col(by))))  # a row for each group and replicate
    reps = sums.groupBy(by, "r").agg(F.sum("n").alias("n"), (F.sum("a") / F.sum("n")).alias("fa"), (F.sum("b") / F.sum("n")).alias("fb"))
    diff = F.when(F.col("r") > 0, F.col("fb") - F.col("fa"))
    return reps.groupBy(by).agg(
        F.max(F.when(F.col("r") == 0, F.col("n"))).alias("n"), F.max(F.when(F.col("r") == 0, F.col("fa"))).alias("f05_a"), F.max(F.when(F.col("r") == 0, F.col("fb"))).alias("f05_b"),
        F.percentile(diff, 0.025).alias("ci_low"), F.percentile(diff, 0.975).alias("ci_high"), F.avg(F.when(diff > 0, 1.0).when(diff <= 0, 0.0)).alias("p_b_better"),
    ).withColumn("delta", F.col("f05_b") - F.col("f05_a"))


def gate(compared: DataFrame) -> DataFrame:
    """One row: accept if the overall interval is above zero and no group loses."""
    group = compared.columns[0]
    return compared.agg(
        F.max(F.when(F.col(group) == "ALL", F.col("ci_low"))).alias("ci_low"), F.min(F.when(F.col(group) != "ALL", F.col("delta"))).alias("worst_group"),
    ).withColumn("accept", (F.col("ci_low") > 0) & (F.col("worst_group") >= 0))
