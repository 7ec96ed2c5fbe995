"""Pair features: set overlap, weighted overlap, context within a record, competition within a target, coherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.similarity import all_metrics

UNSEEN = 12.0
PAIR = ["s1_idx", "src", "t_idx"]


def exact_flags(h1: Column, h2: Column, address2: Column) -> dict[str, Column]:
    """House-number equality (-1 where one is missing), and whether the target has no address."""
    known = (h1 != "") & (h2 != "")
    return {"h_eq": F.when(known, (h1 == h2).cast("int")).otherwise(-1), "a_missing2": (F.coalesce(address2, F.lit("")) == "").cast("int")}


def set_features(a: Column, b: Column, name: str) -> dict[str, Column]:
    """Overlap, Jaccard and containments of two token arrays; 0 where a side is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both, n1, n2 = (F.size(c).cast("double") for c in (F.array_intersect(x, y), x, y))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return {f"{name}_inter": both, f"{name}_jac": share(both, n1 + n2 - both), f"{name}_c12": share(both, n1), f"{name}_c21": share(both, n2), f"{name}_n1": n1, f"{name}_n2": n2}


def token_idf(records: DataFrame, column: str) -> DataFrame:
    """(country, tok, df, idf): ln((n + 1) / (df + 1)) over the records of a country."""
    n = records.groupBy("country").agg(F.count("*").alias("n"))
    df = records.select("country", F.explode(F.array_distinct(column)).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n), "country").select("country", "tok", "df", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def idf_overlap(pairs: DataFrame, idf: DataFrame, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """*pairs* (country, s1_idx, src, t_idx, arrays a and b) with IDF mass of the overlap and its shares.

    One explode, one join and one aggregate: each token of the union carries which sides have it.
    """
    toks = pairs.select("country", *PAIR, a, b, F.explode(F.array_union(a, b)).alias("tok")).select(
        "country", *PAIR, "tok", F.array_contains(a, F.col("tok")).alias("in1"), F.array_contains(b, F.col("tok")).alias("in2")
    )
    w = F.coalesce("idf", F.lit(UNSEEN))
    mass = toks.join(idf.select("country", "tok", "idf"), ["country", "tok"], "left").groupBy(*PAIR).agg(
        F.sum(F.when(F.col("in1") & F.col("in2"), w).otherwise(0.0)).alias("_i"), F.sum(w).alias("_u"),
        F.sum(F.when(F.col("in1"), w).otherwise(0.0)).alias("_m1"), F.sum(F.when(F.col("in2"), w).otherwise(0.0)).alias("_m2"),
    )
    out = pairs.join(mass, PAIR, "left").fillna(0.0, ["_i", "_u", "_m1", "_m2"])

    def share(whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col("_i"), F.col(whole)), F.lit(0.0))

    return out.withColumns({f"{name}_widf": F.col("_i"), f"{name}_wjac": share("_u"), f"{name}_wc12": share("_m1"), f"{name}_wc21": share("_m2"), f"{name}_mass1": F.col("_m1")}).drop("_i", "_u", "_m1", "_m2")


def token_weights(records: DataFrame, idf: DataFrame, column: str) -> DataFrame:
    """(idx, <column>_w): the distinct tokens of a record with their idf."""
    toks = records.select("idx", "country", F.explode(F.array_distinct(column)).alias("tok")).join(idf.select("country", "tok", "idf"), ["country", "tok"], "left")
    return toks.groupBy("idx").agg(F.collect_list(F.struct("tok", F.coalesce("idf", F.lit(UNSEEN)).alias("w"))).alias(f"{column}_w"))


def weighted_overlap(a: Column, b: Column, name: str) -> dict[str, Column]:
    """The features of idf_overlap, from both sides' token_weights; null is no token."""
    a, b = (F.coalesce(c, F.array().cast("array<struct<tok:string,w:double>>")) for c in (a, b))
    t1 = F.transform(a, lambda t: t["tok"])
    t2 = F.transform(b, lambda t: t["tok"])

    def mass(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, t: s + t["w"])

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    both, m1, m2 = mass(F.filter(a, lambda t: F.array_contains(t2, t["tok"]))), mass(a), mass(b)
    union = m1 + mass(F.filter(b, lambda t: ~F.array_contains(t1, t["tok"])))
    return {f"{name}_widf": both, f"{name}_wjac": share(both, union), f"{name}_wc12": share(both, m1), f"{name}_wc21": share(both, m2), f"{name}_mass1": m1}


def record_context(pairs: DataFrame, score: str = "bs", keys: tuple[str, ...] = ("s1_idx",)) -> DataFrame:
    """cx_*: candidates of the record, share of the best score, gaps to its best similarities, rank."""
    every = W.partitionBy(*keys)
    order = every.orderBy(F.desc("c_tset"), "src", "t_idx")
    return pairs.withColumns({
        "cx_n": F.count("*").over(every), "cx_rel": F.try_divide(F.col(score), F.max(score).over(every)), "cx_gap_c": F.col("c_tset") - F.max("c_tset").over(every),
        "cx_gap_a": F.col("a_tset") - F.max("a_tset").over(every), "cx_rank_c": F.row_number().over(order),
    })


def target_aggregates(pairs: DataFrame, score: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """By target: candidates, best and second score (the best again if there is one), best of *extra*."""
    # ranked instead of collected, so that no list grows with the target's candidates
    ranked = pairs.withColumn("_r", F.row_number().over(W.partitionBy("src", "t_idx").orderBy(F.desc(score), "s1_idx")))
    return ranked.groupBy("src", "t_idx").agg(
        F.count("*").alias("tx_n"), F.max(score).alias("_m1"), F.min(F.when(F.col("_r") <= 2, F.col(score))).alias("_m2"), *[F.max(c).alias(f"_mx_{c}") for c in extra]
    )


def competition(pairs: DataFrame, score: str, extra: tuple[str, ...] = (), tag: str = "") -> DataFrame:
    """tx_*: standing of a pair among all records that compete for its target; one shuffle by target."""
    s, every = F.col(score), W.partitionBy("src", "t_idx")
    order = every.orderBy(F.desc(score), "s1_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    g = pairs.withColumns({"_n": F.count("*").over(every), "_m1": F.max(score).over(every), **{f"_mx_{c}": F.max(c).over(every) for c in extra}})
    g = g.withColumn("_m2", F.coalesce(F.nth_value(score, 2).over(order), F.col("_m1")))
    best = s >= F.col("_m1")
    other = F.when(best, F.when(F.col("_n") <= 1, 0.0).otherwise(F.col("_m2"))).otherwise(F.col("_m1"))
    new = {
        f"tx_n{tag}": F.col("_n"), f"tx_rank{tag}": F.when(best, 1).when(s >= F.col("_m2"), 2).otherwise(3), f"tx_gap{tag}": s - F.col("_m1"),
        f"tx_rel{tag}": F.try_divide(s, F.col("_m1")), f"tx_margin{tag}": s - other, **{f"tx_gap_{c[0]}{tag}": F.col(c) - F.col(f"_mx_{c}") for c in extra},
    }
    return g.withColumns(new).drop("_n", "_m1", "_m2", *[f"_mx_{c}" for c in extra])


def general_context(pairs: DataFrame, score: str = "bs") -> DataFrame:
    """Context by (record, source) and competition by target, in two window passes."""
    own, target = W.partitionBy("s1_idx", "src"), W.partitionBy("src", "t_idx")
    new = {
        "cx_n": F.count("*").over(W.partitionBy("s1_idx")), "cx_n_src": F.count("*").over(own), "cx_rel": F.try_divide(F.col(score), F.max(score).over(own)),
        "cx_rank": F.row_number().over(own.orderBy(F.desc(score), "t_idx")), "tx_n": F.count("*").over(target),
        "tx_rank": F.row_number().over(target.orderBy(F.desc(score), "s1_idx")), "tx_gap": F.col(score) - F.max(score).over(target),
    }
    for c, short in (("c_tset", "ntset"), ("a_tset", "atset")):
        new |= {f"cx_rank_{short}": F.row_number().over(own.orderBy(F.desc(c), "t_idx")), f"cx_gap_{short}": F.col(c) - F.max(c).over(own), f"tx_gap_{short}": F.col(c) - F.max(c).over(target)}
    return pairs.withColumns(new)


def _siblings() -> dict[str, Column]:
    """Of a target, over all its candidates: same and other house numbers, best name among the same, look-alikes, best name."""
    return {
        "sib_heq_n": F.count_if(F.col("h_eq") == 1), "sib_hne_n": F.count_if(F.col("h_eq") == 0), "sib_heq_cmax": F.max(F.when(F.col("h_eq") == 1, F.col("c_tset"))),
        "sib_alike_n": F.count_if(F.col("c_tset") >= 80), "sib_cmax": F.max("c_tset"),
    }


def siblings(pairs: DataFrame) -> DataFrame:
    """(src, t_idx) with what _siblings says of every target."""
    return pairs.groupBy("src", "t_idx").agg(*[c.alias(k) for k, c in _siblings().items()])


def sibling_features(pairs: DataFrame) -> DataFrame:
    """*pairs* with siblings of their target; windows, so that the pairs are computed once."""
    every = W.partitionBy("src", "t_idx")
    g = pairs.select("src", "t_idx", *[c for c in pairs.columns if c not in ("src", "t_idx")], *[c.over(every).alias(k) for k, c in _siblings().items()])
    return g.withColumns({
        "sib_heq_oth": F.coalesce("sib_heq_n", F.lit(0)) - (F.col("h_eq") == 1).cast("int"), "sib_heq_cgap": F.col("c_tset") - F.col("sib_heq_cmax"), "sib_cgap": F.col("c_tset") - F.col("sib_cmax"),
    })


def anchors(pairs: DataFrame, score: str = "p1") -> DataFrame:
    """(s1_idx, src, a_idx, a_p1): the best candidate of each record and source."""
    return pairs.groupBy("s1_idx", "src").agg(F.max_by(F.struct("t_idx", score), F.struct(F.col(score), -F.col("t_idx"))).alias("b")).select("s1_idx", "src", F.col("b.t_idx").alias("a_idx"), F.col(f"b.{score}").alias("a_p1"))


def anchor_pairs(pairs: DataFrame, score: str = "p1") -> DataFrame:
    """*pairs* with the anchors of their own and the other source (2 and 3); a pair that is its own anchor has none.

    Both anchors of a record are window maxima of (score, -id), so the pairs are shuffled once.
    """
    every = W.partitionBy("s1_idx")
    best = {k: F.max(F.when(F.col("src") == k, F.struct(F.col(score).alias("p"), (-F.col("t_idx")).alias("i")))).over(every) for k in (2, 3)}
    out = pairs.withColumns({"_b2": best[2], "_b3": best[3]})
    own, other = (F.when(F.col("src") == 2, F.col(f"_b{k}")).otherwise(F.col(f"_b{5 - k}")) for k in (2, 3))
    out = out.withColumns({"_own": own, "_oth": other})
    new = {"same_idx": -F.col("_own.i"), "oth_idx": -F.col("_oth.i"), "coh_p_same": F.col("_own.p"), "coh_p_oth": F.col("_oth.p")}
    out = out.withColumns(new).drop("_b2", "_b3", "_own", "_oth")
    return out.withColumn("same_idx", F.when(F.col("same_idx") != F.col("t_idx"), F.col("same_idx"))).fillna(-1.0, ["coh_p_same", "coh_p_oth"])


def coherence(pairs: DataFrame, texts: DataFrame, score: str = "p1") -> DataFrame:
    """Similarity of each candidate to its record's anchors; -1 where there is none. *texts* has src, idx, name, address."""
    out = anchor_pairs(pairs, score)
    me = texts.select("src", F.col("idx").alias("t_idx"), F.col("name").alias("_n"), F.col("address").alias("_a"))
    out = out.join(me, ["src", "t_idx"], "left")
    for tag, src in (("same", F.col("src")), ("oth", 5 - F.col("src"))):
        other = texts.select(F.col("src").alias("_s"), F.col("idx").alias("_i"), F.col("name").alias(f"_n_{tag}"), F.col("address").alias(f"_a_{tag}"))
        out = out.join(other, (src == F.col("_s")) & (F.col(f"{tag}_idx") == F.col("_i")), "left").drop("_s", "_i")
    for tag in ("same", "oth"):
        for c, name in (("n", "c"), ("a", "a")):
            got = all_metrics(F.col(f"_{c}"), F.col(f"_{c}_{tag}"), ("token_set",))["token_set"]
            out = out.withColumn(f"coh_{name}_{tag}", F.when(F.col(f"{tag}_idx").isNull(), -1.0).otherwise(got))
    return out.drop("_n", "_a", *[f"_{c}_{t}" for c in "na" for t in ("same", "oth")])


def lead(score: str, keys: tuple[str, ...]) -> Column:
    """Lead over the best other of a group: the value if alone, the gap to the second, or minus the gap to the first."""
    every = W.partitionBy(*keys)
    order = every.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s, top = F.col(score), F.max(score).over(every)
    return F.when(F.count("*").over(every) == 1, s).when(s >= top, s - F.nth_value(score, 2).over(order)).otherwise(s - top)


def logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(q / (1 - q))


def stack_features(pairs: DataFrame) -> DataFrame:
    """Features of a second scorer ``ce`` beside p: logits, ranks, gaps and their difference."""
    own = W.partitionBy("s1_idx")
    return pairs.withColumns({
        "lp": logit(F.col("p")), "lce": logit(F.col("ce")), "ce_rank_s1": F.row_number().over(own.orderBy(F.desc("ce"), "src", "t_idx")),
        "p_rank_s1": F.row_number().over(own.orderBy(F.desc("p"), "src", "t_idx")), "ce_gap_t": lead("ce", ("src", "t_idx")), "dce": F.col("ce") - F.col("p"),
    })


def text_features(n1: Column, n2: Column, prefix: str) -> Column:
    """All metrics of one text pair as a struct, by one Arrow pass."""
    return all_metrics(n1, n2).alias(prefix)


def flag_features(h1: Column, h2: Column, state1: Column, state2: Column, legal1: Column, legal2: Column) -> dict[str, Column]:
    """House numbers, states and legal forms; -1 where a side has none."""
    d = F.abs(h1.try_cast("double") - h2.try_cast("double"))
    return {
        "h_has1": (h1 != "").cast("int"), "h_has2": (h2 != "").cast("int"), "h_logdiff": F.log1p(d),
        "state_eq": F.when((state1 == "") | (state2 == ""), -1).otherwise((state1 == state2).cast("int")),
        "legal_inter": F.when((F.size(legal1) == 0) | (F.size(legal2) == 0), -1).otherwise(F.size(F.array_intersect(legal1, legal2))),
    }


def lexical_pack(name1: Column, name2: Column, h1: Column, h2: Column, address2: Column) -> dict[str, Column]:
    """House-number status 0 to 4 (both missing, one missing, equal, one within the other, different), length ratio, missing flag."""
    status = F.when((h1 == "") & (h2 == ""), 0).when((h1 == "") | (h2 == ""), 1).when(h1 == h2, 2).when(F.contains(h1, h2) | F.contains(h2, h1), 3).otherwise(4)
    lens = F.try_divide(F.least(F.length(name1), F.length(name2)).cast("double"), F.greatest(F.length(name1), F.length(name2)))
    return {"h_status": status, "len_ratio": F.coalesce(lens, F.lit(0.0)), "a_missing2": (F.coalesce(address2, F.lit("")) == "").cast("int")}
