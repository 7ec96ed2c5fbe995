"""Dictionaries learned from matched pairs: fillers, aliases, administrative parts, transliterations, weak labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import all_metrics
from tessera.functions.text import skeleton
from tessera.operators.learn import pseudo_labels


def _times(pairs: DataFrame) -> Column:
    """How many pairs a row stands for: its ``n_pairs``, or one."""
    return F.col("n_pairs") if "n_pairs" in pairs.columns else F.lit(1).cast("long")


def filler_rates(pairs: DataFrame, min_count: int = 30, prior: float = 0.5) -> DataFrame:
    """(tok, k, n, rate): how often a target token is not in the reference name; *pairs* has arrays a (reference), b (target).

    Here and below, rows with ``n_pairs`` stand for so many equal pairs.
    """
    toks = pairs.select("a", _times(pairs).alias("w"), F.explode(F.array_distinct("b")).alias("tok")).groupBy("tok").agg(
        F.sum("w").alias("n"), F.sum(F.when(~F.array_contains("a", F.col("tok")), F.col("w")).otherwise(0)).alias("k")
    )
    return toks.where(F.col("n") >= min_count).select("tok", "k", "n", ((F.col("k") + prior) / (F.col("n") + 2 * prior)).alias("rate"))


def split_fillers(rates: DataFrame, vocabulary: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Frequent additions as 'filler' (words the reference knows) or 'foreign'; *vocabulary* has tok."""
    known = vocabulary.select("tok").distinct().withColumn("_k", F.lit(True))
    return rates.where(F.col("rate") >= threshold).join(known, "tok", "left").select("tok", "rate", F.when(F.col("_k"), "filler").otherwise("foreign").alias("kind"))


def weak_labels(similarity: Column, raw: Column, marker: Column, low: float = 45, high: float = 80) -> Column:
    """1: the name was replaced; 0: it was not; null: not sure."""
    ascii_only = ~F.regexp_like(raw, F.lit(r"[^\x00-\x7F]"))
    return F.when((similarity >= high) | ~ascii_only, 0).when((similarity < low) & ascii_only & ~marker, 1)


def pure(pairs: DataFrame, key: str, value: str, min_count: int, min_purity: float, total: DataFrame | None = None) -> DataFrame:
    """(key, value, n, total): the most frequent value of each key, if frequent and pure enough."""
    counts = pairs.groupBy(key, value).agg(F.sum(_times(pairs)).alias("n"))
    all_ = counts.groupBy(key).agg(F.sum("n").alias("total")) if total is None else total.select(key, "total")
    best = counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b")).select(key, f"b.{value}", "b.n")
    return best.join(all_, key).where((F.col("n") >= min_count) & (F.col("n") >= min_purity * F.col("total")))


def token_aliases(pairs: DataFrame, min_count: int = 5, min_purity: float = 0.6, max_known: int = 2, min_similarity: float = 0.8) -> DataFrame:
    """(tok, alias, n, total): target tokens that stand for a reference token.

    Tokens that only one side has are aligned within their pair by the better of Jaro-Winkler and skeleton
    ratio (equal skeletons count as 1); a token's best partner counts, and words the reference knows well
    are no aliases.
    """
    w = _times(pairs).alias("n_pairs")
    known = pairs.select(w, F.explode(F.array_distinct("a")).alias("tok")).groupBy("tok").agg(F.sum("n_pairs").alias("f"))
    rest = pairs.select(F.monotonically_increasing_id().alias("pid"), w, F.array_except("b", "a").alias("x"), F.array_except("a", "b").alias("y"))
    both = rest.where("size(x) > 0 AND size(y) > 0").select("pid", "n_pairs", F.explode("x").alias("tok"), "y").select("pid", "n_pairs", "tok", F.explode("y").alias("alias"))
    # every distinct pair of words is scored once
    words = both.select("tok", "alias").distinct().withColumn("k1", skeleton(F.col("tok"))).withColumn("k2", skeleton(F.col("alias")))
    scored = words.withColumn("m", all_metrics(F.col("tok"), F.col("alias"), ("jaro_winkler",))).withColumn("s", all_metrics(F.col("k1"), F.col("k2"), ("ratio",)))
    sim = F.when((F.col("k1") == F.col("k2")) & (F.col("k1") != ""), 1.0).otherwise(F.greatest(F.col("m.jaro_winkler"), F.col("s.ratio") / 100))
    near = scored.select("tok", "alias", sim.alias("sim")).where(F.col("sim") >= min_similarity)
    best = both.join(near, ["tok", "alias"]).groupBy("pid", "n_pairs", "tok").agg(F.max_by("alias", F.struct("sim", "alias")).alias("alias"))
    total = pairs.select(w, F.explode(F.array_distinct("b")).alias("tok")).groupBy("tok").agg(F.sum("n_pairs").alias("total"))
    found = pure(best.select("tok", "alias", "n_pairs"), "tok", "alias", min_count, min_purity, total)
    return found.join(known, "tok", "left").where(F.coalesce("f", F.lit(0)) <= max_known).drop("f")


def pseudo_aliases(scores: DataFrame, tokens: DataFrame, confident: float = 0.97, **rules) -> DataFrame:
    """:func:`token_aliases` without labels: learned from the pairs with p of *confident* or more that are best for their target.

    *scores* has s1_idx, src, t_idx, p; *tokens* the arrays a (reference) and b (target) of each pair. Pairs that
    tie for a target all count; a null p is never confident.
    """
    sure = pseudo_labels(scores.select("s1_idx", "src", "t_idx", "p"), hi=confident).where("y = 1").select("s1_idx", "src", "t_idx")
    return token_aliases(tokens.join(sure, ["s1_idx", "src", "t_idx"], "left_semi").select("a", "b"), **rules)


def part_aliases(pairs: DataFrame, min_count: int = 5, min_purity: float = 0.6) -> DataFrame:
    """(part, alias, n, total): address parts of the target that replace a part of the reference; arrays a, b of parts."""
    rest = pairs.select(_times(pairs).alias("n_pairs"), F.array_except("b", "a").alias("x"), F.array_except("a", "b").alias("y"))
    both = rest.select("n_pairs", F.explode("x").alias("part"), "y").select("n_pairs", "part", F.explode("y").alias("alias"))
    total = rest.select("n_pairs", F.explode("x").alias("part")).groupBy("part").agg(F.sum("n_pairs").alias("total"))
    return pure(both, "part", "alias", min_count, min_purity, total)


def admin_parts(parts: DataFrame, implied_by: int = 4, chance: float = 0.3, min_count: int = 1) -> DataFrame:
    """(part, n_implying): parts that at least *implied_by* others of *min_count* records or more imply; *parts* has rec and part."""
    own = parts.select("rec", "part").distinct()
    n = own.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    pairs = own.join(own.withColumnRenamed("part", "other"), "rec").where("part <> other").groupBy("part", "other").agg(F.count("*").alias("both"))
    implied = pairs.join(n.withColumnRenamed("part", "other"), "other").where(F.col("both") >= chance * F.col("n"))
    return implied.groupBy("part").agg(F.count("*").alias("n_implying")).where(F.col("n_implying") >= implied_by)


def source_parts(parts: DataFrame, min_count: int = 1000, min_reference: int = 50, share: float = 0.01, variant: float = 80.0) -> DataFrame:
    """(part, f1, f23): frequent parts of the targets that the reference has not, nor any spelling of them; *parts* has rec, src (1: reference) and part.

    A ratio of 80 or more leaves at most a third of the letters of one side without a partner, so such strings share
    a pair of neighbouring letters, ends included, and their lengths are within two to three; only those are compared.
    Null parts are ignored.
    """
    seen = parts.where("part IS NOT NULL").select("rec", "src", "part").distinct()
    freq = seen.groupBy("part").agg(F.count_if(F.col("src") == 1).alias("f1"), F.count_if(F.col("src") > 1).alias("f23"))
    known = freq.where(F.col("f1") >= min_reference).select(F.col("part").alias("ref"))
    fresh = freq.where((F.col("f23") >= min_count) & (F.col("f1") <= share * F.col("f23")))
    if variant < 80:
        raise ValueError("neighbouring letters prove nothing below a ratio of 80")

    def grams(df: DataFrame, c: str) -> DataFrame:
        text = F.concat(F.lit("\x02"), c, F.lit("\x03"))
        return df.select(c, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(text, i, F.lit(2))))).alias("g"))

    near = grams(fresh.select("part"), "part").join(grams(known, "ref"), "g").where("3 * length(part) >= 2 * length(ref) AND 3 * length(ref) >= 2 * length(part)").select("part", "ref").distinct()
    like = near.where(all_metrics(F.col("part"), F.col("ref"), ("ratio",))["ratio"] >= variant).select("part").distinct()
    return fresh.join(like, "part", "left_anti")


def transliterations(pairs: DataFrame, min_count: int = 2, min_share: float = 0.7) -> DataFrame:
    """(tok, word, n, total): words at equal places of equally long token arrays a (word) and b (romanised)."""
    same = pairs.where("size(a) = size(b)").select(_times(pairs).alias("n_pairs"), F.explode(F.arrays_zip("a", "b")).alias("z")).select("n_pairs", F.col("z.b").alias("tok"), F.col("z.a").alias("word")).where("tok <> word")
    return pure(same, "tok", "word", min_count, min_share)
