"""Models over pair features: cross-fitted trees, calibration, stacking, self-training, transfer."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.io import staged

META = frozenset("s1_idx src t_idx y fold role country weight p p1 ce entity_id".split())


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are no ids, labels or scores."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") and f.name not in META]


def roles(ids: DataFrame, n_val: int, n_fit: int, seed: int = 42) -> DataFrame:
    """(s1_idx, role, fold): *n_val* validation and *n_fit* fitting records in hash order of the id; fold is by parity."""
    order = W.orderBy("h", "s1_idx")
    few = ids.select("s1_idx", F.md5(F.concat_ws(":", F.lit(seed), "s1_idx")).alias("h")).orderBy("h", "s1_idx").limit(n_val + n_fit)
    ranked = few.withColumn("r", F.row_number().over(order))  # bounded by the two sizes
    return ranked.select("s1_idx", F.when(F.col("r") <= n_val, "val").otherwise("fit").alias("role"), (F.col("s1_idx") % 2).cast("int").alias("fold"))


def subsample_negatives(rows: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """One of *m* negatives by hash, with weight *m*; all positives."""
    keep = (F.col("y") == 1) | (F.pmod(F.xxhash64(F.lit(seed), "s1_idx", "src", "t_idx"), F.lit(m)) == 0)
    return rows.where(keep).withColumn("weight", F.when(F.col("y") == 1, 1.0).otherwise(float(m)))


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows.fillna(-1.0, features))


def _chance(model, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    out = model.transform(_vectors(rows, features))
    return out.select(*rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def fit_folds(rows: DataFrame, features: list[str] | None = None, kind: str = "gbt", rounds: int = 20, depth: int = 4, seed: int = 42, held: float = 0.0) -> tuple[list, list[str]]:
    """Two models, each fitted on one fold of *rows* (y, fold, weight, features).

    With *held*, boosting stops when the loss over that share of the records, chosen by a hash of s1_idx, no longer falls.
    """
    features = features or feature_columns(rows)
    rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    stop = {}
    if held and kind == "gbt":
        stop = {"validationIndicatorCol": "_held"}
        rows = rows.withColumn("_held", F.pmod(F.xxhash64(F.lit(seed), "s1_idx"), F.lit(1 << 20)) < int(held * (1 << 20)))
    make = {
        "gbt": lambda: GBTClassifier(labelCol="y", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed, **stop),
        "forest": lambda: RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=rounds, maxDepth=depth, seed=seed),
        "logistic": lambda: LogisticRegression(labelCol="y", weightCol="weight", maxIter=rounds),
    }[kind]
    return [make().fit(_vectors(rows.where(F.col("fold") == k), features)) for k in (0, 1)], features


def save_models(spark: SparkSession, models: list, features: list[str], path: str) -> None:
    """Write fitted models (of any kind, calibrators included) and the names of their features below *path*."""
    for k, model in enumerate(models):
        model.write().overwrite().save(f"{path}/{k}")
    about = [(k, f"{type(m).__module__}.{type(m).__name__}", features) for k, m in enumerate(models)]
    spark.createDataFrame(about, "k int, kind string, features array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_models(spark: SparkSession, path: str) -> tuple[list, list[str]]:
    """What :func:`save_models` wrote."""
    about = spark.read.parquet(f"{path}/about").orderBy("k").collect()  # a row a model
    load = {f"{c.__module__}.{c.__name__}": c.load for c in (GBTClassificationModel, RandomForestClassificationModel, LogisticRegressionModel, IsotonicRegressionModel)}
    return [load[r.kind](f"{path}/{r.k}") for r in about], list(about[0].features) if about else []


def predict_folds(models: list, rows: DataFrame, features: list[str], name: str = "p1") -> DataFrame:
    """Out-of-fold predictions: a row of fold k by the other fold's model, a row without fold by the mean."""
    both = _chance(models[1], _chance(models[0], rows, features, "_m0"), features, "_m1")
    mean = (F.col("_m0") + F.col("_m1")) / 2
    p = F.when(F.col("fold") == 0, F.col("_m1")).when(F.col("fold") == 1, F.col("_m0")).otherwise(mean) if "fold" in rows.columns else mean
    return both.withColumn(name, p).drop("_m0", "_m1")


def importances(models: list, features: list[str]) -> list[tuple[str, float]]:
    """Mean gain of each feature, largest first."""
    both = [m.featureImportances.toArray() for m in models]
    return sorted(((f, float(sum(b[k] for b in both) / len(both))) for k, f in enumerate(features)), key=lambda x: (-x[1], x[0]))


def prune(rows: DataFrame, score: str = "p1", most: int = 20, floor: float = 0.002) -> DataFrame:
    """The *most* best pairs of each record and source with a score of at least *floor*."""
    r = F.row_number().over(W.partitionBy("s1_idx", "src").orderBy(F.desc(score), "t_idx"))
    return rows.withColumn("r1", r).where((F.col("r1") <= most) & (F.col(score) >= floor))


def fit_calibrators(fitted: DataFrame, score: str = "p1") -> dict:
    """An isotonic model for each source of *fitted* that has labels; sources are a handful."""
    labelled = fitted.where(F.col("src").isNotNull() & F.col("y").isNotNull() & F.col(score).isNotNull())
    found = sorted(r.src for r in labelled.select("src").distinct().collect())
    return {src: IsotonicRegression(featuresCol=score, labelCol="y", predictionCol="_p").fit(labelled.where(F.col("src") == src)) for src in found}


def apply_calibrators(models: dict, rows: DataFrame, score: str = "p1", name: str = "p") -> DataFrame:
    """*rows* with *name*, clipped to 0..1; rows of a source without a model, or without a score, keep their score, clipped."""
    known = F.coalesce(F.col("src").isin(list(models)), F.lit(False)) & F.col(score).isNotNull()
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    out = rows.where(~known).withColumn(name, F.when(F.col(score).isNotNull(), clip(F.col(score))))
    for src, model in models.items():
        out = out.unionByName(model.transform(rows.where(known & (F.col("src") == src))).withColumn(name, clip(F.col("_p"))).drop("_p"))
    return out


def calibrate(fitted: DataFrame, rows: DataFrame, score: str = "p1", name: str = "p") -> DataFrame:
    """Isotonic calibration by source, fitted on out-of-fold scores."""
    return apply_calibrators(fit_calibrators(fitted, score), rows, score, name)


def group_softmax(score: Column, *keys: str) -> Column:
    e = F.exp(score - F.max(score).over(W.partitionBy(*keys)))
    return e / F.sum(e).over(W.partitionBy(*keys))


def ensemble(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Trees, forest and a pairwise-ranking stand-in (logistic scores, softmax in each record), stacked by logistic regression.

    The rows are read dozens of times, so they are written once, and again with the three scores: fits read files, and the
    joins behind *rows* are shuffled once instead of once a pass.
    """
    names = []
    out = rows = staged(rows, "rows")
    features = feature_columns(rows)
    for kind in ("gbt", "forest", "logistic"):
        models, _ = fit_folds(rows, features, kind, seed=seed)
        out = predict_folds(models, out, features, f"m_{kind}")
        names.append(f"m_{kind}")
    out = out.withColumn("m_logistic", group_softmax(F.log(F.col("m_logistic") + 1e-6), "s1_idx"))
    out = staged(out, "scored")
    models, _ = fit_folds(out, names, "logistic", seed=seed)
    return predict_folds(models, out, names, "stacked")


def uncertain_band(rows: DataFrame, lo: float = 0.005, hi: float = 0.995, score: str = "p") -> DataFrame:
    return rows.where(F.col(score).between(lo, hi))


def stack(rows: DataFrame, second: DataFrame, features: list[str], score: str = "p") -> DataFrame:
    """Pairs with a second score get the stacked chance, all others keep theirs. *second* has the pair and ``ce``."""
    key = ["s1_idx", "src", "t_idx"]
    band = rows.join(second.select(*key, "ce"), key)
    models, _ = fit_folds(band, features, "gbt")
    better = predict_folds(models, band, features, "_better").select(*key, "_better")
    return rows.join(better, key, "left").withColumn("p", F.coalesce("_better", score)).drop("_better")


def pseudo_labels(scores: DataFrame, hi: float = 0.97, lo: float = 0.02) -> DataFrame:
    """Confident pairs as labels: at least *hi* and best for the target is 1, at most *lo* is 0."""
    best = F.col("p") >= F.max("p").over(W.partitionBy("src", "t_idx"))
    return scores.withColumn("y", F.when((F.col("p") >= hi) & best, 1).when(F.col("p") <= lo, 0)).where("y IS NOT NULL")


def leave_one_out(rows: DataFrame, groups: list[str], by: str = "country", rounds: int = 8) -> DataFrame:
    """(held, group, n, brier): a model fitted without each group, scored on every group."""
    features = feature_columns(rows)
    out = None
    for held in groups:
        models, _ = fit_folds(rows.where(F.col(by) != held), features, rounds=rounds, depth=3)
        scored = predict_folds(models, rows.drop("fold"), features, "q")
        part = scored.groupBy(F.col(by).alias("group")).agg(F.count("*").alias("n"), F.avg((F.col("q") - F.col("y")) ** 2).alias("brier")).withColumn("held", F.lit(held))
        out = part if out is None else out.unionByName(part)
    return out


def replaced_names(rows: DataFrame, text: str = "core_s", dense: tuple[str, ...] = ("n_tokens", "n_known", "n_chars", "mean_len", "n_legal"), size: int = 1 << 14) -> tuple[object, DataFrame]:
    """(model, scores): classifier of replaced names from hashed character 2- to 4-grams and dense counts; *rows* has y and the columns."""
    share = rows.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.5
    rows = rows.withColumn("weight", F.when(F.col("y") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))

    def vectors(df: DataFrame) -> DataFrame:
        df = RegexTokenizer(inputCol=text, outputCol="_chars", pattern="", minTokenLength=1).transform(df)
        for n in (2, 3, 4):
            df = HashingTF(inputCol=f"_g{n}", outputCol=f"_h{n}", numFeatures=size).transform(NGram(n=n, inputCol="_chars", outputCol=f"_g{n}").transform(df))
        return VectorAssembler(inputCols=["_h2", "_h3", "_h4", *dense], outputCol="features").transform(df)

    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=0.01, maxIter=30).fit(vectors(rows.where("y IS NOT NULL")))
    scored = model.transform(vectors(rows))
    return model, scored.select(*rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("replaced"))


def empty_model(aggregates: DataFrame) -> DataFrame:
    """(s1_idx, q0): chance that a record has no match, cross-fitted on its aggregates; *aggregates* has y and fold."""
    features = feature_columns(aggregates)
    models, _ = fit_folds(aggregates, features, rounds=10, depth=3)
    return predict_folds(models, aggregates, features, "q0").select("s1_idx", "q0")


def members_mean(df: DataFrame, members: list[str], name: str = "ce") -> DataFrame:
    return df.withColumn(name, sum((F.col(c) for c in members), F.lit(0.0)) / len(members))


def score_pairs(df: DataFrame, scorer, a: str = "a", b: str = "b", name: str = "ce") -> DataFrame:
    """Hook for any batch scorer of text pairs: *scorer* takes two lists of strings, sorted by length, and returns numbers."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        order = (x.str.len().fillna(0) + y.str.len().fillna(0)).sort_values(kind="stable").index
        got = scorer(x.loc[order].fillna("").tolist(), y.loc[order].fillna("").tolist())
        return pd.Series(list(got), index=order, dtype="float64").reindex(x.index)

    return df.withColumn(name, run(F.col(a), F.col(b)))
