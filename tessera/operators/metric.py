"""Evaluation of match sets: macro F0.5 over reference records, empty sets included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["s1_idx", "src", "t_idx"]


def per_record(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """s1_idx (and the other columns of *ids*), n_pred, n_true, tp, f05, precision, recall of every record of *ids*."""
    both = pred.select(*PAIR).distinct().withColumn("_p", F.lit(1)).join(truth.select(*PAIR).distinct().withColumn("_t", F.lit(1)), PAIR, "full")
    counts = both.groupBy("s1_idx").agg(F.sum(F.coalesce("_p", F.lit(0))).alias("n_pred"), F.sum(F.coalesce("_t", F.lit(0))).alias("n_true"), F.sum(F.coalesce(F.col("_p") * F.col("_t"), F.lit(0))).alias("tp"))
    rows = ids.join(counts, "s1_idx", "left").fillna(0, ["n_pred", "n_true", "tp"])
    return rows.withColumns({"f05": f05(), "precision": F.try_divide(F.col("tp").cast("double"), F.col("n_pred")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("n_true"))})


def f05(tp: str = "tp", n_pred: str = "n_pred", n_true: str = "n_true") -> Column:
    """Closed form; an empty prediction of an empty truth is 1, anything one-sided is 0."""
    t, p, n = F.col(tp).cast("double"), F.col(n_pred), F.col(n_true)
    return F.when((p == 0) & (n == 0), 1.0).when(t == 0, 0.0).otherwise(1.25 * t / (0.25 * n + p))


def macro(records: DataFrame, by: str | None = None) -> DataFrame:
    """Means over records, overall ('ALL') and for each value of *by*."""
    aggs = [
        F.count("*").alias("n"), F.avg("f05").alias("f05"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg(F.when(F.col("n_true") == 0, F.col("f05"))).alias("singleton_f"), F.sum("tp").alias("tp"),
    ]
    if by is None:
        return records.agg(*aggs)
    # the grouping id tells the total from records whose group is null
    return records.rollup(by).agg(*aggs, F.grouping(by).alias("_all")).withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def macro_f05(pred: DataFrame, truth: DataFrame, ids: DataFrame, by: str | None = None) -> DataFrame:
    return macro(per_record(pred, truth, ids), by)
