"""Analysis of scored pairs and match sets, as functions of frames: recall by layer, calibration, errors, losses, probes.

Scores have s1_idx, src, t_idx and p; truth and match sets have the pair; ids have s1_idx and a group such as country.
Every function is one or two joins by pair or record and a small aggregate.  Empty frames give empty results, or
one row of zeros and nulls where the result is a single row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.metric import PAIR, f05


def with_label(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """*scores* with y: 1 if the pair is true."""
    true = truth.select(*PAIR).distinct().withColumn("y", F.lit(1))
    return scores.join(true, PAIR, "left").withColumn("y", F.coalesce("y", F.lit(0)))


def _both(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """All pairs of either side with p (null: not scored) and y."""
    true = truth.select(*PAIR).distinct().withColumn("y", F.lit(1))
    return scores.select(*PAIR, "p").join(true, PAIR, "full").withColumn("y", F.coalesce("y", F.lit(0)))


def _bin(p: Column | str, bins: int) -> Column:
    return F.floor((F.col(p) if isinstance(p, str) else p) * bins).cast("int")


def _mean(c: Column) -> Column:
    return F.round(F.avg(c.cast("double")), 6)


def layer_recall(scores: DataFrame, truth: DataFrame, ids: DataFrame, floors: Mapping[str, float], by: str = "country") -> DataFrame:
    """Share of the true pairs that are scored at least each floor (null p: not a candidate), overall ('ALL') and by group."""
    rows = truth.select(*PAIR).distinct().join(scores.select(*PAIR, "p"), PAIR, "left").join(ids.select("s1_idx", by), "s1_idx")
    got = rows.rollup(by).agg(F.count("*").alias("n"), *[_mean(F.coalesce((F.col("p") >= x).cast("int"), F.lit(0))).alias(k) for k, x in floors.items()], F.grouping(by).alias("_all"))
    return got.withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def calibration(labelled: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, p_mean, rate, brier) of equally wide bins of p; the last one is closed."""
    at = F.least(_bin("p", bins), F.lit(bins - 1))
    return labelled.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), _mean(F.col("p")).alias("p_mean"), _mean(F.col("y")).alias("rate"), _mean((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def errors(scores: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: false pairs, true pairs that are no candidates or were rejected, false pairs of records without a match."""
    rows = _both(scores, truth).withColumn("_any", F.max("y").over(W.partitionBy("s1_idx")))
    false = (F.col("y") == 0) & (F.col("p") >= threshold)
    return rows.agg(
        F.count_if(false).alias("fp"), F.count_if((F.col("y") == 1) & F.col("p").isNull()).alias("fn_not_candidate"),
        F.count_if((F.col("y") == 1) & (F.col("p") < threshold)).alias("fn_rejected"), F.count_if(false & (F.col("_any") == 0)).alias("fp_singleton"),
    )


def anatomy(scores: DataFrame, truth: DataFrame, ids: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By kind of record: F0.5 now, without the false pairs, with all true candidates added, with the true candidates alone, and the loss."""
    pred, cand = F.coalesce(F.col("p") >= threshold, F.lit(False)).cast("int"), F.col("p").isNotNull().cast("int")
    rows = _both(scores, truth).withColumns({"_p": pred, "_c": F.col("y") * cand})
    per = rows.groupBy("s1_idx").agg(
        F.sum("y").alias("nt"), F.sum("_p").alias("np"), F.sum(F.col("y") * F.col("_p")).alias("tp"), F.sum("_c").alias("tc"), F.sum(F.greatest("_p", "_c")).alias("nu"),
    )
    v = ids.select("s1_idx").join(per, "s1_idx", "left").fillna(0)
    kind = (
        F.when((F.col("nt") == 0) & (F.col("np") > 0), "fp_on_singleton").when((F.col("tp") == F.col("nt")) & (F.col("np") == F.col("nt")), "perfect")
        .when(F.col("tc") < F.col("nt"), "retrieval").when(F.col("tp") < F.col("nt"), "rejected").otherwise("extra")
    )
    v = v.select(
        kind.alias("kind"), f05("tp", "np", "nt").alias("now_f"), f05("tp", "tp", "nt").alias("clean_f"), f05("tc", "nu", "nt").alias("added_f"), f05("tc", "tc", "nt").alias("ceiling_f"),
    )
    return v.groupBy("kind").agg(F.count("*").alias("n"), *[_mean(F.col(c)).alias(c) for c in ("now_f", "clean_f", "added_f", "ceiling_f")], F.round(F.sum(1 - F.col("now_f")), 4).alias("loss"))


def siblings(labelled: DataFrame, most: int = 5) -> DataFrame:
    """Pairs by the number of records that claim their target (at most *most* told apart) and whether theirs is the best claim."""
    target = W.partitionBy("src", "t_idx")
    rows = labelled.select("p", "y", F.least(F.count("*").over(target), F.lit(most)).cast("int").alias("claims"), (F.col("p") >= F.max("p").over(target)).cast("int").alias("best"))
    return rows.groupBy("claims", "best").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_true"), _mean(F.col("p")).alias("p"))


def slices(labelled: DataFrame, by: Sequence[str], bins: int = 5) -> DataFrame:
    """Share of true pairs by the columns *by* and bin of p."""
    return labelled.groupBy(*by, _bin("p", bins).alias("bin")).agg(F.count("*").alias("n"), _mean(F.col("y")).alias("rate"))


def origin(truth: DataFrame, layers: Mapping[str, DataFrame]) -> DataFrame:
    """True pairs by the layers (1 or 0 each) that have them."""
    rows = truth.select(*PAIR).distinct()
    for name, frame in layers.items():
        rows = rows.join(frame.select(*PAIR).distinct().withColumn(name, F.lit(1)), PAIR, "left")
    return rows.fillna(0, list(layers)).groupBy(*layers).agg(F.count("*").alias("n"))


def structure(a: DataFrame, b: DataFrame, ids: DataFrame, by: str = "country") -> DataFrame:
    """Two match sets by group: mean sizes, empty records, common pairs, records with equal sets."""
    both = a.select(*PAIR).distinct().withColumn("_a", F.lit(1)).join(b.select(*PAIR).distinct().withColumn("_b", F.lit(1)), PAIR, "full").fillna(0)
    per = both.groupBy("s1_idx").agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"), F.sum(F.col("_a") * F.col("_b")).alias("nab"))
    rows = ids.select("s1_idx", by).join(per, "s1_idx", "left").fillna(0, ["na", "nb", "nab"])
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), _mean(F.col("na")).alias("mean_a"), _mean(F.col("nb")).alias("mean_b"), F.count_if(F.col("na") == 0).alias("empty_a"), F.count_if(F.col("nb") == 0).alias("empty_b"),
        F.sum("nab").cast("long").alias("overlap"), F.count_if((F.col("na") == F.col("nb")) & (F.col("na") == F.col("nab"))).alias("same"),
    )


def progression(a: DataFrame, b: DataFrame, bucket: Column) -> DataFrame:
    """Pairs that *b* no longer has and pairs that it has anew, by *bucket* of their own row."""
    gone = a.join(b.select(*PAIR), PAIR, "left_anti").select(F.lit("removed").alias("what"), bucket.alias("bucket"))
    new = b.join(a.select(*PAIR), PAIR, "left_anti").select(F.lit("added").alias("what"), bucket.alias("bucket"))
    return gone.unionByName(new).groupBy("what", "bucket").agg(F.count("*").alias("n"))


def transfer(labelled: DataFrame, other: DataFrame, bins: int = 5) -> DataFrame:
    """Expected precision of *other*: its mix of score bins with the share of true pairs that *labelled* has in each."""
    share = labelled.groupBy(_bin("p", bins).alias("bin")).agg(F.avg(F.col("y").cast("double")).alias("rate"))
    mix = other.groupBy(_bin("p", bins).alias("bin")).agg(F.count("*").alias("n"))
    return mix.join(share, "bin").agg(F.sum("n").cast("long").alias("n"), F.round(F.sum(F.col("n") * F.col("rate")) / F.sum("n"), 4).alias("expected"))


def bands(scores: DataFrame, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    """Records by whether they have a pair below, inside and above the band."""
    has = {"has_lo": F.col("p") < lo, "has_mid": F.col("p").between(lo, hi), "has_hi": F.col("p") > hi}
    return scores.groupBy("s1_idx").agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in has.items()]).groupBy(*has).agg(F.count("*").alias("n"))


def count_shares(matches: DataFrame, most: int = 9, name: str = "f") -> DataFrame:
    """(k, share): records by their number of matches, at most *most*; records without a match do not count."""
    n = matches.groupBy("s1_idx").agg(F.least(F.count("*"), F.lit(most)).alias("k")).groupBy("k").agg(F.count("*").alias("_n"))
    return n.select("k", (F.col("_n") / F.sum("_n").over(W.partitionBy())).alias(name))  # at most *most* rows


def tv_distance(a: DataFrame, b: DataFrame, most: int = 9) -> DataFrame:
    """Total variation between the match counts of two sets."""
    both = count_shares(a, most, "f").join(count_shares(b, most, "g"), "k", "full").fillna(0.0, ["f", "g"])
    return both.agg(F.round(0.5 * F.sum(F.abs(F.col("f") - F.col("g"))), 6).alias("tv"))


def false_share(reference: DataFrame, observed: DataFrame, most: int = 9) -> DataFrame:
    """Share of false pairs of *observed* without labels: the least-squares mixture of size-biased reference counts and the same, one more."""
    ref, obs = count_shares(reference, most, "f"), count_shares(observed, most, "g")
    mean = ref.agg(F.sum(F.col("k") * F.col("f")).alias("mu"))  # one row
    z = ref.join(obs, "k", "full").fillna(0.0, ["f", "g"]).join(ref.select((F.col("k") + 1).alias("k"), F.col("f").alias("shifted")), "k", "left").fillna(0.0, ["shifted"])
    z = z.join(F.broadcast(mean)).select("g", "shifted", (F.col("f") * F.col("k") / F.col("mu")).alias("biased"))
    up = F.sum((F.col("g") - F.col("biased")) * (F.col("shifted") - F.col("biased"))) / F.sum((F.col("shifted") - F.col("biased")) * (F.col("shifted") - F.col("biased")))
    return z.agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), up)), 4).alias("false_share"))


def probe(pairs: DataFrame, removed: Column, by: Sequence[str] = ()) -> DataFrame:
    """What a removal rule takes and leaves: number and mean p by *by*; a rule that is null keeps the pair."""
    what = F.when(removed, "removed").otherwise("kept")
    return pairs.withColumn("what", what).groupBy("what", *by).agg(F.count("*").alias("n"), _mean(F.col("p")).alias("p"))


def claimed(below: float) -> Column:
    """Rule: several records claim the target, and this claim is under *below*."""
    return (F.count("*").over(W.partitionBy("src", "t_idx")) > 1) & (F.col("p") < below)


def twin(place: str, likeness: str) -> Column:
    """Rule: at the same *place*, another pair of the record and source has a better *likeness*."""
    return F.col(place).isNotNull() & (F.col(likeness) < F.max(likeness).over(W.partitionBy("s1_idx", "src", place)))


def band(value: str, lo: float, hi: float) -> Column:
    """Rule: *value* lies in [lo, hi)."""
    return (F.col(value) >= lo) & (F.col(value) < hi)


def projection(ids: DataFrame, known: Mapping[str, float], target: float, unknown: str, by: str = "country", rest: float = 0.0) -> DataFrame:
    """The mean that group *unknown* must have for the whole to reach *target*, given those of the other groups (*rest*: of groups not named)."""
    mean = F.lit(rest)
    for group, value in known.items():
        mean = F.when(F.col(by) == group, value).otherwise(mean)
    n = ids.groupBy(by).agg(F.count("*").alias("n")).withColumn("_m", mean)
    own = F.col(by) == unknown
    return n.agg(F.round((F.lit(target) * F.sum("n") - F.sum(F.when(own, 0.0).otherwise(F.col("n") * F.col("_m")))) / F.sum(F.when(own, F.col("n"))), 6).alias("f_unknown"))


def add_rules(candidates: DataFrame, by: Sequence[str], floors: Sequence[float], cost: float = 0.25) -> DataFrame:
    """Rules (columns *by*, p at least fl) that would add pairs: hits less *cost* for each false pair in both halves; a rule holds if it gains in both.

    *candidates* has p, y, half (0 or 1) and *by*; a pair counts for every floor that it reaches.
    """
    rows = candidates.withColumn("fl", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in floors]), lambda x: F.col("p") >= x)))
    gain = F.col("y") - cost * (1 - F.col("y"))
    half = [F.sum(F.when(F.col("half") == k, gain).otherwise(0.0)).alias(f"g{k}") for k in (0, 1)]
    return rows.groupBy(*by, "fl").agg(F.count("*").alias("n"), *half).withColumn("keep", (F.col("g0") > 0) & (F.col("g1") > 0))
