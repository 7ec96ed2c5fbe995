"""Compositions of the library's operators: whole feature sets, probes, stackers and file operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions.text import skeleton
from tessera.operators import blocking, decide, dense, features, learn, metric, mining, output
from tessera.plans import linkage
from tessera.plans.decisions import _SINGLE_SEL, _THRESH, macro_sql
from tessera.plans.decisions import PAIRS as _CHOSEN
from tessera.plans.linkage import CAPS, NAME_PAIRS, PAIRS, labelled, records
from tessera.plans.roles import role, run_sql, with_roles
from tessera.sources import io as files


def p10(spark: SparkSession, sf: str) -> DataFrame:
    """Drop columns by suffix."""
    df = run_sql(spark, sf, "SELECT a.idx AS s1_idx, a.business_name AS name_1, b.business_name AS name_2, b.idx AS t_idx FROM records a JOIN records b ON a.brand = b.brand AND a.number = b.number AND a.idx < b.idx")
    return df.select([c for c in df.columns if not c.endswith(("_1", "_2"))])


def p15(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric columns of a pair table that are no ids or labels."""
    return spark.createDataFrame([(c,) for c in sorted(learn.feature_columns(labelled(spark, sf)))], "feature string")


def t07(spark: SparkSession, sf: str) -> DataFrame:
    """The best match of each brand name among the type names: a stated list of few strings against few."""
    a = run_sql(spark, sf, "SELECT DISTINCT lower(p_name) AS q FROM part")
    b = run_sql(spark, sf, "SELECT DISTINCT lower(p_type) AS c FROM part")
    scored = a.join(F.broadcast(b)).withColumn("r", sim.all_metrics(F.col("q"), F.col("c"), ("ratio",))["ratio"])
    return scored.groupBy("q").agg(F.max_by("c", F.struct("r", "c")).alias("best"), F.round(F.max("r"), 6).alias("score"))


def sim09(spark: SparkSession, sf: str) -> DataFrame:
    """Alias alignment: the better of Jaro-Winkler and skeleton ratio; equal skeletons are 1."""
    df = run_sql(spark, sf, NAME_PAIRS).select("ia", "ib", F.split("a", " ")[0].alias("x"), F.split("b", " ")[0].alias("y")).withColumns({"k": skeleton(F.col("x")), "l": skeleton(F.col("y"))})
    df = df.withColumn("m", sim.all_metrics(F.col("x"), F.col("y"), ("jaro_winkler",))).withColumn("s", sim.all_metrics(F.col("k"), F.col("l"), ("ratio",)))
    return df.select("ia", "ib", F.round(F.when((F.col("k") == F.col("l")) & (F.col("k") != ""), 1.0).otherwise(F.greatest("m.jaro_winkler", F.col("s.ratio") / 100)), 6).alias("sim"))


def _pair_text(spark: SparkSession, sf: str, r: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Blocked pairs with both normalised records (of *r*, if given, with columns *more*); these are never sent whole, however small their files look."""
    r = files.staged(records(spark, sf), "records") if r is None else r
    cols = ["name_norm", "core", "skel", "addr_norm", "hno", "state", "legal", "loc", "street", "nums", "atoks", *more]
    a = r.select(F.col("idx").alias("s1_idx"), *[F.col(c).alias(f"{c}_1") for c in cols])
    b = r.select("src", F.col("idx").alias("t_idx"), *[F.col(c).alias(f"{c}_2") for c in cols])
    return linkage.blocked(spark, sf, r=r).join(a.hint("merge"), "s1_idx").join(b.hint("merge"), ["src", "t_idx"])


def f01(spark: SparkSession, sf: str) -> DataFrame:
    df = _pair_text(spark, sf)
    c = sim.all_metrics(F.array_join("core_1", " "), F.array_join("core_2", " "), ("token_set",))["token_set"]
    a = sim.all_metrics(F.col("addr_norm_1"), F.col("addr_norm_2"), ("token_set",))["token_set"]
    return df.select("s1_idx", "src", "t_idx", F.round(c, 6).alias("c_tset"), F.round(a, 6).alias("a_tset"))


def f09(spark: SparkSession, sf: str) -> DataFrame:
    df = _pair_text(spark, sf)
    flags = features.flag_features(*[F.col(c) for c in ("hno_1", "hno_2", "state_1", "state_2", "legal_1", "legal_2")])
    return df.select("s1_idx", "src", "t_idx", *[F.round(c, 6).alias(k) for k, c in flags.items()])


def full_features(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pair feature set: texts by one Arrow pass for each field, sets, flags, weighted overlap, frequency, context.

    Weights of tokens and frequencies of names come with the record, so that the wide pairs are not shuffled for them.
    """
    r = records(spark, sf).withColumn("nfreq", F.when(F.col("name_norm").isNotNull(), F.count("*").over(W.partitionBy("src", "name_norm"))))
    r = files.staged(r, "records")
    r = files.staged(r.join(features.token_weights(r, features.token_idf(r, "core"), "core").hint("merge"), "idx", "left"), "records")
    df = _pair_text(spark, sf, r, ("nfreq", "core_w"))
    df = df.withColumns({
        "n": sim.all_metrics(F.col("name_norm_1"), F.col("name_norm_2")), "c": sim.all_metrics(F.array_join("core_1", " "), F.array_join("core_2", " ")),
        "a": sim.all_metrics(F.col("addr_norm_1"), F.col("addr_norm_2"), ("ratio", "partial", "token_sort", "token_set")),
    })
    new: dict = {f"{p}_{m}": F.col(f"{p}.{m}") for p, ms in (("n", sim.METRICS), ("c", sim.METRICS), ("a", ("ratio", "partial", "token_sort", "token_set"))) for m in ms}
    for c, short in (("core", "core"), ("skel", "skel"), ("atoks", "at"), ("nums", "num"), ("loc", "loc"), ("street", "str")):
        new |= features.set_features(F.col(f"{c}_1"), F.col(f"{c}_2"), short)
    new |= features.exact_flags(F.col("hno_1"), F.col("hno_2"), F.col("addr_norm_2"))
    new |= features.flag_features(*[F.col(c) for c in ("hno_1", "hno_2", "state_1", "state_2", "legal_1", "legal_2")])
    new |= features.weighted_overlap(F.col("core_w_1"), F.col("core_w_2"), "core")
    df = df.withColumns(new).withColumns({"c_tset": F.col("c_token_set"), "a_tset": F.col("a_token_set"), "nfreq2": F.col("nfreq_2")})
    keep = [c for c in df.columns if not c.endswith(("_1", "_2")) and c not in ("n", "c", "a")]
    return features.sibling_features(features.competition(features.record_context(df.select(*keep)), "bs", ("c_tset",)))


def feature_means(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of each source and the mean of every feature, so that none is left out of the work."""
    df = full_features(spark, sf)
    named = {"n_wratio": "wratio", "core_wjac": "wjac"}
    means = [F.round(F.avg(c), 3 if c == "n_wratio" else 4).alias(named.get(c, c)) for c in df.columns if c not in ("country", *features.PAIR)]
    return df.groupBy("src").agg(F.count("*").alias("n"), *means)


def f10(spark: SparkSession, sf: str) -> DataFrame:
    return run_sql(spark, sf, "SELECT r.idx, r.src, f.n AS nfreq FROM records r JOIN (SELECT src, business_name, count(*) AS n FROM records GROUP BY src, business_name) f ON r.src = f.src AND r.business_name = f.business_name")


_RERANK = """WITH z AS (SELECT s.s1_idx, s.src, s.t_idx, s.p AS p0, b.p AS ce, CASE WHEN s.t_idx % 5 = 0 THEN 1 ELSE 0 END AS origin FROM scores s JOIN scores2 b ON s.s1_idx = b.s1_idx AND s.src = b.src AND s.t_idx = b.t_idx)
  SELECT s1_idx, src, t_idx, origin, round(ln(p0 / (1 - p0)), 5) AS lp, round(ln(ce / (1 - ce)), 5) AS lce, count(*) OVER (PARTITION BY s1_idx) AS cx_n, round(p0 - max(p0) OVER (PARTITION BY s1_idx), 5) AS cx_gap,
  count(*) OVER (PARTITION BY src, t_idx) AS tx_n, round(ce - max(ce) OVER (PARTITION BY src, t_idx), 5) AS tx_gap FROM z"""


def f17(spark: SparkSession, sf: str) -> DataFrame:
    """Coherence of a candidate with its record's eight best others: weighted means, best, strong and close ones."""
    df = run_sql(spark, sf, "SELECT s1_idx, src, t_idx, p FROM scores")
    names = run_sql(spark, sf, "SELECT p_partkey AS t_idx, p_name AS name FROM part")
    ranked = df.withColumn("k", F.row_number().over(W.partitionBy("s1_idx").orderBy(F.desc("p"), "src", "t_idx"))).join(names, "t_idx")
    other = ranked.where("k <= 8").select("s1_idx", F.col("src").alias("sj"), F.col("t_idx").alias("tj"), F.col("p").alias("pj"), F.col("name").alias("nj"))
    pairs = ranked.join(other, "s1_idx").where("NOT (src = sj AND t_idx = tj)")
    pairs = pairs.withColumn("sim", sim.all_metrics(F.col("name"), F.col("nj"), ("token_set",))["token_set"])
    return pairs.groupBy("s1_idx", "src", "t_idx").agg(
        F.round(F.sum(F.col("pj") * F.col("sim")) / F.sum("pj"), 4).alias("coh"), F.round(F.max("sim"), 4).alias("best"), F.max(F.when(F.col("pj") > 0.5, F.col("pj"))).alias("strong"), F.count_if(F.col("sim") >= 80).alias("n_close")
    )


def sim12(spark: SparkSession, sf: str) -> DataFrame:
    """Each unmatched part of one side with its best match on the other."""
    a = run_sql(spark, sf, "SELECT DISTINCT lower(p_brand) AS x FROM part WHERE p_partkey % 2 = 0")
    b = run_sql(spark, sf, "SELECT DISTINCT lower(p_brand) AS y FROM part WHERE p_partkey % 2 = 1")
    scored = a.join(F.broadcast(b)).withColumn("r", sim.all_metrics(F.col("x"), F.col("y"), ("ratio",))["ratio"])
    return scored.groupBy("x").agg(F.round(F.max("r"), 6).alias("best"))


def e22(spark: SparkSession, sf: str) -> DataFrame:
    """How far down the neighbour list the true targets stand."""
    near = linkage.neighbours(spark, sf, 20)
    return near.join(linkage.dense_truth(spark, sf), ["q_id", "t_id"], "left_semi").groupBy("q_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("in_5"), F.count("*").alias("in_20"))


def ml05(spark: SparkSession, sf: str) -> DataFrame:
    """Stage 2: pruned pairs with sibling and competition features, pseudo-labelled rows in training only."""
    rows = learn.prune(linkage.ml02(spark, sf), most=10)
    rows = features.sibling_features(features.competition(rows.drop("r1"), "p1", tag="_p1")).fillna(-1.0)
    feats = [c for c in learn.feature_columns(rows)]
    models, _ = learn.fit_folds(rows, feats, rounds=5, depth=3)
    return learn.predict_folds(models, rows, feats, "p2").select("s1_idx", "src", "t_idx", "y", "p2")


def m11(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases from the confident pairs of the scores table; two targets of three misspell the last word, the others add a filler."""
    tokens = run_sql(spark, sf, "SELECT s1_idx, src, t_idx, p_name AS name FROM scores JOIN part ON p_partkey = t_idx").withColumn("a", F.split("name", " "))
    last = F.element_at("a", -1)
    wrong = F.concat(F.slice("a", 1, F.size("a") - 1), F.array(F.concat(last, F.right(last, F.lit(1)))))
    tokens = tokens.withColumn("b", F.when(F.col("s1_idx") % 3 == 0, F.concat("a", F.array(F.lit("shop")))).otherwise(wrong))
    return mining.pseudo_aliases(role(spark, sf, "scores"), tokens)


def ml09(spark: SparkSession, sf: str) -> DataFrame:
    """Dense stacker: new pairs get a score of their own and join the base by anti join."""
    base = role(spark, sf, "scores").where("t_idx % 3 > 0")
    new = role(spark, sf, "scores2").join(base.select("s1_idx", "src", "t_idx"), ["s1_idx", "src", "t_idx"], "left_anti")
    return base.withColumn("origin", F.lit("base")).unionByName(new.withColumn("origin", F.lit("dense"))).groupBy("origin").agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("p"))


def ml10(spark: SparkSession, sf: str) -> DataFrame:
    """Re-ranker: cross-fitted on the re-ranking features; pairs below the floor keep their score."""
    rows = run_sql(spark, sf, _RERANK).join(role(spark, sf, "truth").withColumn("y", F.lit(1)), ["s1_idx", "src", "t_idx"], "left").fillna(0, ["y"]).withColumn("fold", (F.col("s1_idx") % 2).cast("int"))
    feats = ["origin", "lp", "lce", "cx_n", "cx_gap", "tx_n", "tx_gap"]
    models, _ = learn.fit_folds(rows, feats, rounds=5, depth=3)
    out = learn.predict_folds(models, rows, feats, "q")
    p0 = 1 / (1 + F.exp(-F.col("lp")))
    return out.select("s1_idx", "src", "t_idx", F.when(p0 >= 1e-3, F.col("q")).otherwise(p0).alias("p"))


def ml14(spark: SparkSession, sf: str) -> DataFrame:
    """Adaptation to a country without labels: its confident pairs as labels, its uncertain ones scored anew."""
    rows = labelled(spark, sf).withColumn("p", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("bs") / 10)))
    own = rows.where("country = '5-LOW'")
    pseudo = learn.pseudo_labels(own.drop("y"), 0.9, 0.1).withColumn("y", F.col("y").cast("int"))
    feats = ["bs", "c_tset", "a_tset", "h_eq"]
    models, _ = learn.fit_folds(pseudo, feats, rounds=3, depth=3)
    return learn.predict_folds(models, learn.uncertain_band(own, 0.1, 0.9), feats, "q").select("s1_idx", "src", "t_idx", "q")


def b05(spark: SparkSession, sf: str) -> DataFrame:
    t = records(spark, sf).where("src > 1")
    w = blocking.weighted_keys(t, blocking.keys(t, ("n",), False, ("src",)), **CAPS)
    return w.select("country", "src", "key", "df", F.round("w", 6).alias("w")).distinct()


def o03(spark: SparkSession, sf: str) -> DataFrame:
    pairs, cands, ids = linkage._result_lists(spark, sf)
    return output.write_submission(pairs, cands, ids, linkage._folder(spark, "submission"))


def io02(spark: SparkSession, sf: str) -> DataFrame:
    """Text scan, fixed row index, filter and projection straight into Parquet."""
    path, out = linkage._folder(spark, "tsv"), linkage._folder(spark, "sink")
    files.write_tsv(run_sql(spark, sf, "SELECT CAST(idx AS STRING) AS entity_id, business_name, business_address, country FROM records"), path)
    files.with_index(files.read_tsv(spark, path, files.SOURCE), "entity_id").where("country = 'SMALL'").select("entity_id", "idx").write.parquet(out)
    df = spark.read.parquet(out)
    return df.select("entity_id", (F.col("idx") >= 0).alias("indexed"))


def io04(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose columns drift, read under one schema."""
    from pyspark.sql import types as T

    a, b = linkage._folder(spark, "part"), linkage._folder(spark, "part")
    run_sql(spark, sf, "SELECT idx, src, country FROM records WHERE src = 1").write.parquet(a)
    run_sql(spark, sf, "SELECT idx, src, country, brand FROM records WHERE src = 2").write.parquet(b)
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("src", T.IntegerType()), T.StructField("brand", T.StringType())])
    return files.scan_drifted(spark, [a, b], schema).groupBy("src").agg(F.count("*").alias("n"), F.count("brand").alias("with_brand"))


def io22(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows by partition with label and fold."""
    out = linkage._folder(spark, "research")
    labelled(spark, sf).write.partitionBy("country", "src").parquet(out)
    have = files.available(spark, out, ["bs", "c_tset", "no_such"])
    return spark.read.parquet(out).groupBy("country", "src").agg(F.count("*").alias("n"), F.round(F.sum(have[0]), 4).alias("bs"))


QUERIES = {
    "p10_drop_by_suffix": p10, "p15_numeric_columns": p15, "t07_best_match": t07, "sim09_alias_alignment": sim09, "sim12_best_parts": sim12,
    "f01_cheap_strings": f01, "f09_flags": f09, "f10_name_frequency": f10, "f14_rerank_features": lambda s, d: run_sql(s, d, _RERANK), "f17_target_coherence": f17,
    "full_pair_features": feature_means,
    "t06_matrix_top_k": lambda s, d: dense.top_k(s.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0"), s.read.parquet(f"{d}/embeddings.parquet"), 3).select("q_id", "t_id", F.col("rank").cast("int").alias("rank")),
    "b05_capped_weights": b05, "e22_recall_probe": e22,
    "m11_pseudo_aliases": lambda s, d: mining.token_aliases(linkage.token_pairs(s, d), min_count=3), "m11_confident_aliases": m11,
    "ml03_out_of_fold": lambda s, d: linkage.ml02(s, d).groupBy("fold").agg(F.count("*").alias("n")),
    "ml05_stage2": ml05, "ml09_dense_stacker": ml09, "ml10_reranker": ml10, "ml14_adaptation": ml14,
    "ml17_score_hook": lambda s, d: learn.score_pairs(run_sql(s, d, NAME_PAIRS), lambda a, b: [float(len(x) + len(y)) for x, y in zip(a, b)]).select("ia", "ib", "ce"),
    "o03_submission": o03, "io02_scan_to_sink": io02, "io04_drift": io04, "io22_research_export": io22,
    "d09_best_point": lambda s, d: decide.grid(role(s, d, "scores"), s.createDataFrame([(0, 0.0, 0.0, 0.5, 2.5)], "point int, margin double, floor double, m0 double, empty_bias double")).select("s1_idx", "src", "t_idx"),
    "e03_by_half": lambda s, d: metric.per_record(decide.threshold_select(role(s, d, "scores"), 0.4), role(s, d, "truth"), role(s, d, "s1")).groupBy(decide.half_of("s1_idx").alias("half")).agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("f05")),
}

_BEST = """WITH a AS (SELECT DISTINCT lower({x}) AS q FROM part {wx}), b AS (SELECT DISTINCT lower({y}) AS c FROM part {wy}), s AS (SELECT q, c, {r} AS r FROM a, b),
  k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r DESC, c DESC) AS n FROM s)"""
_FIRST = f"SELECT ia, ib, string_split(a, ' ')[1] AS x, string_split(b, ' ')[1] AS y FROM ({NAME_PAIRS})"
_COHERENT_PAIRS = """SELECT s1_idx, src, t_idx, pj, a.name AS a, nj AS b FROM rk a JOIN (SELECT s1_idx, src AS sj, t_idx AS tj, p AS pj, name AS nj FROM rk WHERE k <= 8) o USING (s1_idx) WHERE NOT (src = sj AND t_idx = tj)"""

ORACLES = {
    "m11_pseudo_aliases": linkage.ORACLES["m05_token_aliases"].replace(">= 5", ">= 3"),
    "m11_confident_aliases": """WITH k AS (SELECT s1_idx, t_idx FROM (SELECT *, max(p) OVER (PARTITION BY src, t_idx) AS best FROM scores) WHERE p >= 0.97 AND p >= best),
      w AS (SELECT string_split(p_name, ' ')[-1] AS alias FROM k JOIN part ON p_partkey = t_idx WHERE s1_idx % 3 <> 0)
      SELECT concat(alias, right(alias, 1)) AS tok, alias, count(*) AS n, count(*) AS total FROM w GROUP BY alias HAVING count(*) >= 5""",
    "t07_best_match": _BEST.format(x="p_name", y="p_type", wx="", wy="", r=linkage.ratio_sql("q", "c")) + " SELECT q, c AS best, round(r, 6) AS score FROM k WHERE n = 1",
    "sim12_best_parts": _BEST.format(x="p_brand", y="p_brand", wx="WHERE p_partkey % 2 = 0", wy="WHERE p_partkey % 2 = 1", r=linkage.ratio_sql("q", "c")) + " SELECT q AS x, round(r, 6) AS best FROM k WHERE n = 1",
    "sim09_alias_alignment": f"""SELECT ia, ib, round(CASE WHEN k = l AND k <> '' THEN 1 ELSE greatest(jaro_winkler_similarity(x, y), ({linkage.ratio_sql('k', 'l')}) / 100) END, 6) AS sim
      FROM (SELECT *, {linkage._sql_skeleton('x')} AS k, {linkage._sql_skeleton('y')} AS l FROM ({_FIRST}))""",
    "f17_target_coherence": f"""WITH rk AS (SELECT s.*, p_name AS name, row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) AS k FROM scores s JOIN part ON p_partkey = t_idx),
      z AS ({linkage.token_set_sql(_COHERENT_PAIRS, 's1_idx, src, t_idx, pj')})
      SELECT s1_idx, src, t_idx, round(sum(pj * ts) / sum(pj), 4) AS coh, round(max(ts), 4) AS best, max(CASE WHEN pj > 0.5 THEN pj END) AS strong, count(CASE WHEN ts >= 80 THEN 1 END) AS n_close FROM z GROUP BY s1_idx, src, t_idx""",
    "p10_drop_by_suffix": "SELECT a.idx AS s1_idx, b.idx AS t_idx FROM records a JOIN records b ON a.brand = b.brand AND a.number = b.number AND a.idx < b.idx",
    "p15_numeric_columns": "SELECT unnest(['a_tset', 'bs', 'c_tset', 'h_eq']) AS feature",
    "f10_name_frequency": "SELECT idx, src, count(*) OVER (PARTITION BY src, business_name) AS nfreq FROM records",
    "f14_rerank_features": _RERANK,
    "t06_matrix_top_k": f"WITH {linkage._NEIGHBOURS} SELECT q_id, t_id, rank::INT AS rank FROM nk WHERE rank <= 3",
    "b05_capped_weights": f"WITH {linkage._TOK}, nt AS (SELECT country, src, count(*) AS n_t FROM rec WHERE src > 1 GROUP BY country, src) SELECT k.country, k.src, key, count(*) AS df, round(ln(max(n_t) + 1.0::DOUBLE) - ln(count(*)::DOUBLE), 6) AS w FROM ks k JOIN nt ON nt.country = k.country AND nt.src = k.src WHERE fam = 'n' GROUP BY k.country, k.src, key HAVING count(*) <= {CAPS['single']}",
    "e22_recall_probe": f"WITH {linkage._NEIGHBOURS.replace('rank <= 11', 'rank <= 21')}, {linkage._DT} SELECT nb.q_id, min(rank)::INT AS first, count(CASE WHEN rank <= 5 THEN 1 END) AS in_5, count(*) AS in_20 FROM nb JOIN dt ON dt.q_id = nb.q_id AND dt.t_id = nb.t_id GROUP BY nb.q_id",
    "ml03_out_of_fold": f"WITH q AS ({PAIRS}) SELECT (q.s1_idx % 2)::INT AS fold, count(*) AS n FROM q JOIN s1 ON q.s1_idx = s1.s1_idx GROUP BY 1",
    "ml09_dense_stacker": "WITH b AS (SELECT * FROM scores WHERE t_idx % 3 > 0), n AS (SELECT s.* FROM scores2 s ANTI JOIN b ON b.s1_idx = s.s1_idx AND b.src = s.src AND b.t_idx = s.t_idx) SELECT 'base' AS origin, count(*) AS n, round(sum(p), 4) AS p FROM b UNION ALL SELECT 'dense', count(*), round(sum(p), 4) FROM n",
    "ml17_score_hook": f"SELECT ia, ib, (length(a) + length(b))::DOUBLE AS ce FROM ({NAME_PAIRS})",
    "o03_submission": linkage.ORACLES["o02_invariants"],
    "io02_scan_to_sink": "SELECT CAST(idx AS VARCHAR) AS entity_id, true AS indexed FROM records WHERE country = 'SMALL'",
    "io04_drift": "SELECT src, count(*) AS n, CASE WHEN src = 1 THEN 0 ELSE count(*) END::BIGINT AS with_brand FROM records WHERE src < 3 GROUP BY src",
    "io22_research_export": f"WITH q AS ({PAIRS}) SELECT country, src, count(*) AS n, round(sum(bs), 4) AS bs FROM q JOIN s1 ON q.s1_idx = s1.s1_idx GROUP BY country, src",
    "d09_best_point": f"WITH {_SINGLE_SEL} {_CHOSEN}",
    "e03_by_half": f"WITH {_THRESH.format(x=0.4)}, {macro_sql('th')} SELECT ((s1_idx * 2654435761) % 1000 < 500)::INT AS half, count(*) AS n, round(avg(f05), 6) AS f05 FROM rec GROUP BY 1",
}


def queries() -> dict:
    return QUERIES


def oracles() -> dict:
    return {k: with_roles(v) for k, v in ORACLES.items()}
