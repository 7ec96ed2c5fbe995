"""Normalisation, similarity, blocking, features, mining, models, dense retrieval, output and files as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text
from tessera.functions.normalize import Learned, enrich, normalize, segment, split_alias
from tessera.operators import alike, blocking, dense, features, learn, mining, output
from tessera.plans.roles import role, run_sql, with_roles
from tessera.sources import io as files

PAIRS = """SELECT CAST(l_orderkey AS BIGINT) AS s1_idx, CAST(2 + l_linenumber % 2 AS INT) AS src, CAST(l_partkey AS BIGINT) AS t_idx,
  max(l_discount * 100) AS bs, max(l_quantity * 2) AS c_tset, max(l_tax * 1000) AS a_tset, CAST(max(l_linenumber % 3 - 1) AS INT) AS h_eq, max(round(l_discount * 10, 1)) AS p1
  FROM lineitem GROUP BY l_orderkey, 2 + l_linenumber % 2, l_partkey"""
#: Pairs of names of records at the same number and brand.
NAME_PAIRS = "SELECT a.idx AS ia, b.idx AS ib, a.business_name AS a, b.business_name AS b FROM records a JOIN records b ON a.brand = b.brand AND a.number = b.number AND a.idx < b.idx"
CAPS = {"single": blocking.CAP_SINGLE, "pair": blocking.CAP_PAIR, "full": blocking.CAP_FULL}
BUDGETS = blocking.BUDGETS
SQL_FAMILIES = ("n", "np", "nl", "a1", "a2", "a4")


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def records(spark: SparkSession, sf: str) -> DataFrame:
    # a small file is one part of the scan, and normalisation is the work of all tasks
    return normalize(role(spark, sf, "records").repartition(tasks(spark), "idx")).withColumn("raw_addr", F.col("business_address"))


def _join(*cols: str) -> dict:
    return {c: F.array_join(c, " ") for c in cols}


def n01(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


def n02(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.createDataFrame([("राम",), ("आदित्य",), ("प्राइवेट लिमिटेड",), ("রাম",), ("ਕੰਪਨੀ १२",), ("plain",)], "word string")
    return words.select("word", text.fold(F.col("word")).alias("latin"))


def n03(spark: SparkSession, sf: str) -> DataFrame:
    return run_sql(spark, sf, "SELECT p_partkey, explode(split(lower(p_name), ' ')) AS tok FROM part").withColumn("k", text.skeleton(F.col("tok")))


def _sql_skeleton(t: str) -> str:
    for a, b in text.SOUNDS:
        t = f"replace({t}, '{a}', '{b}')"
    for v in "eiy":
        t = f"replace({t}, 'c{v}', 's{v}')"
    t = f"replace({t}, 'c', 'k')"
    t = f"concat(regexp_replace(substr({t}, 1, 1), '[aeiouyh]', ''), regexp_replace(substr({t}, 2), '[aeiouyh]', '', 'g'))"
    for ch in "dfjklmnprstv":
        t = f"regexp_replace({t}, '{ch}+', '{ch}', 'g')"
    return t


def n10(spark: SparkSession, sf: str) -> DataFrame:
    """Alias markers between two part names."""
    names = run_sql(spark, sf, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' d/b/a ', p_type) WHEN 1 THEN concat(p_name, ' formerly known as ', p_type) WHEN 2 THEN concat('dba ', p_name) ELSE concat(p_name, ' aka ', p_type) END AS raw FROM part")

    return names.select("p_partkey", split_alias(F.lower("raw")).alias("x")).select("p_partkey", "x.main", "x.alias")


def n12(spark: SparkSession, sf: str) -> DataFrame:
    vocab = {r.tok: r.n for r in run_sql(spark, sf, "SELECT tok, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS tok FROM part) GROUP BY tok").collect()}

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: " ".join(segment(x, vocab)))

    return run_sql(spark, sf, "SELECT DISTINCT replace(p_name, ' ', '') AS glued FROM part").withColumn("words", run("glued"))


def n16(spark: SparkSession, sf: str) -> DataFrame:
    """One country normalised anew with learned words, all others as they were."""
    old, raw = records(spark, sf), role(spark, sf, "records").where("country = 'SMALL'")
    new = normalize(raw, learned=Learned(admin={"SMALL": frozenset({"small city"})})).withColumn("raw_addr", F.col("business_address"))
    return old.where("country <> 'SMALL'").unionByName(new).select("idx", "country", "addr_norm")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def name_pairs(spark: SparkSession, sf: str, left: str = "business_name AS a", right: str = "business_name AS b", by: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The pairs of NAME_PAIRS by classes of records: equal brand, number and the columns of *left* or *right*."""
    place, r = ["brand", "number"], role(spark, sf, "records").where("brand IS NOT NULL AND number IS NOT NULL")

    def side(columns: str, ids: str) -> DataFrame:
        own = r.selectExpr("idx", *place, *columns.split(", "))
        return alike.classes(own, place, own.columns[3:], ids)

    return alike.class_pairs(side(left, "xs"), side(right, "ys"), place, tasks(spark), list(by))


def metrics(spark: SparkSession, sf: str, names: tuple[str, ...] = sim.METRICS) -> DataFrame:
    scored = name_pairs(spark, sf).withColumn("m", sim.all_metrics(F.col("a"), F.col("b"), names))
    return alike.expand(scored, *[F.round(f"m.{n}", 6).alias(n) for n in names]).select("ia", "ib", *names)


def one_metric(name: str):
    return lambda s, d: metrics(s, d, (name,))


def weak(spark: SparkSession, sf: str) -> DataFrame:
    pairs = name_pairs(spark, sf).withColumn("m", sim.all_metrics(F.col("a"), F.col("b"), ("token_set",)))
    y = F.coalesce(mining.weak_labels(F.col("m.token_set"), F.col("b"), F.lit(False)), F.lit(-1))
    return alike.expand(pairs, y.alias("y")).select("ia", "ib", "y")


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of records of one brand and country; one of five has no number, one of seven no address."""
    place, r = ["brand", "country"], role(spark, sf, "records").where("brand IS NOT NULL AND country IS NOT NULL")
    one = alike.classes(r.selectExpr("idx", *place, "CASE WHEN idx % 5 = 0 THEN '' ELSE number END AS h1"), place, ["h1"], "xs")
    two = alike.classes(r.selectExpr("idx", *place, "number AS h2", "CASE WHEN idx % 7 = 0 THEN NULL ELSE business_address END AS ad"), place, ["h2", "ad"], "ys")
    found = features.exact_flags(F.col("h1"), F.col("h2"), F.col("ad"))
    return alike.expand(alike.class_pairs(one, two, place, tasks(spark), ["h1", "h2"]), *[c.alias(k) for k, c in found.items()]).select("ia", "ib", *found)


def lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Length ratio and missing flag by names, the status of the numbers (here the ids) by pair."""
    def pack(h1, h2) -> dict:
        return {k: F.round(c, 6).alias(k) for k, c in features.lexical_pack(F.col("a"), F.col("b"), h1, h2, F.col("b")).items()}

    of_names = pack(F.lit(""), F.lit(""))
    of_ids = pack(F.col("ia").cast("string"), F.col("ib").cast("string"))["h_status"]
    return alike.expand(name_pairs(spark, sf), of_names["len_ratio"], of_names["a_missing2"]).select("ia", "ib", of_ids, "len_ratio", "a_missing2")


def blocked(spark: SparkSession, sf: str, families=blocking.FAMILIES, hashed: bool = True, r: DataFrame | None = None) -> DataFrame:
    """Candidate pairs of the records, or of *r*, where these are at hand."""
    r = records(spark, sf) if r is None else r
    return blocking.block(r.where("src = 1"), r.where("src > 1"), families, BUDGETS, hashed, **CAPS)


def block_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of equal brand and number in a country count as true; the reference records are not broadcast, however small their file."""
    return run_sql(spark, sf, "SELECT /*+ MERGE(a) */ a.country, a.idx AS s1_idx, b.src, b.idx AS t_idx FROM records a JOIN records b ON a.country = b.country AND a.brand = b.brand AND a.number = b.number WHERE a.src = 1 AND b.src > 1")


def misses(spark: SparkSession, sf: str) -> DataFrame:
    r = files.staged(records(spark, sf), "records")
    return blocking.miss_anatomy(block_truth(spark, sf), r.where("src = 1"), r.where("src > 1"), blocked(spark, sf, r=r), **CAPS)


def token_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Matched token arrays: the names of records at the same number and brand, one with a filler and an alias; n_pairs of each."""
    pairs = name_pairs(spark, sf, right="business_name AS b, idx % 3 = 0 AS third").select("a", "b", "third", alike.count_pairs("xs", "ys").alias("n"))
    return pairs.groupBy("a", "b", "third").agg(F.sum("n").alias("n_pairs")).where("n_pairs > 0").select(
        F.split("a", " ").alias("a"), F.when(F.col("third"), F.concat(F.split("b", " "), F.array(F.lit("shop")))).otherwise(F.transform(F.split("a", " "), lambda t: F.when(t == "widget", "widgett").otherwise(t))).alias("b"), "n_pairs"
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with label, fold and country."""
    return run_sql(spark, sf, f"WITH q AS ({PAIRS}) SELECT q.s1_idx, q.src, q.t_idx, bs, c_tset, a_tset, h_eq, CASE WHEN t.s1_idx IS NULL THEN 0 ELSE 1 END AS y, CAST(q.s1_idx % 2 AS INT) AS fold, country FROM q JOIN s1 ON q.s1_idx = s1.s1_idx LEFT JOIN truth t ON t.s1_idx = q.s1_idx AND t.src = q.src AND t.t_idx = q.t_idx")


def ml02(spark: SparkSession, sf: str) -> DataFrame:
    rows = learn.subsample_negatives(labelled(spark, sf), 2)
    models, feats = learn.fit_folds(rows, rounds=5, depth=3)
    return learn.predict_folds(models, labelled(spark, sf), feats)


def ml_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ml02(spark, sf).select("s1_idx", "src", "t_idx", "y", "p1", "fold", "country")


def ml06(spark: SparkSession, sf: str) -> DataFrame:
    rows = ml_scores(spark, sf)
    return learn.calibrate(rows, rows).select("s1_idx", "src", "t_idx", "p")


def io12(spark: SparkSession, sf: str) -> DataFrame:
    """Models fitted with early stop, saved, loaded and applied: equal scores."""
    rows, path = labelled(spark, sf), _folder(spark, "models")
    models, feats = learn.fit_folds(rows, rounds=5, depth=3, held=0.2)
    learn.save_models(spark, models, feats, path)
    loaded, names = learn.load_models(spark, path)
    both = learn.predict_folds(loaded, learn.predict_folds(models, rows, feats, "one").drop("p1"), names, "two")
    return both.groupBy("fold").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("one") - F.col("two")) < 1e-12).alias("equal"))


def ml15(spark: SparkSession, sf: str) -> DataFrame:
    models, feats = learn.fit_folds(labelled(spark, sf), rounds=5, depth=3)
    return spark.createDataFrame(learn.importances(models, feats), "feature string, gain double")


def ml08(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf).withColumn("p", F.col("bs") / 10)
    second = learn.uncertain_band(rows, 0.3, 0.7).select("s1_idx", "src", "t_idx", (F.col("c_tset") / 100).alias("ce"))
    return learn.stack(rows, second, ["bs", "c_tset", "a_tset", "ce"]).select("s1_idx", "src", "t_idx", "p")


def ml11(spark: SparkSession, sf: str) -> DataFrame:
    agg = labelled(spark, sf).groupBy("s1_idx", "fold").agg(F.count("*").alias("n"), F.max("bs").alias("top"), F.avg("bs").alias("mean"), (F.sum("y") == 0).cast("int").alias("y"))
    return learn.empty_model(agg)


def m04(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_sql(spark, sf, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat(reverse(p_name), 'xq') END AS core_s, CAST(p_partkey % 2 AS INT) AS y FROM part")
    rows = rows.withColumns({"n_tokens": F.lit(2.0), "n_known": F.lit(1.0), "n_chars": F.length("core_s").cast("double"), "mean_len": F.length("core_s") / 2.0, "n_legal": F.lit(0.0)})
    return learn.replaced_names(rows)[1].select("p_partkey", "y", "replaced")


def neighbours(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return dense.top_k(e.where("vec_id % 50 = 0"), e, k + 1).where("q_id <> t_id")


def dense_truth(spark: SparkSession, sf: str) -> DataFrame:
    return run_sql(spark, sf, "SELECT q.vec_id AS q_id, t.vec_id AS t_id FROM embeddings q JOIN embeddings t ON q.label = t.label WHERE q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id")


def _result_lists(spark: SparkSession, sf: str):
    pairs = run_sql(spark, sf, "SELECT concat('S1-', s1_idx) AS source1_entity_id, concat('S', src, '-', t_idx) AS id FROM truth")
    cands = run_sql(spark, sf, "SELECT concat('S1-', s1_idx) AS source1_entity_id, concat('S', src, '-', t_idx) AS id FROM scores")
    ids = run_sql(spark, sf, "SELECT concat('S1-', s1_idx) AS source1_entity_id, country FROM s1")
    return pairs, cands, ids


def o02(spark: SparkSession, sf: str) -> DataFrame:
    pairs, cands, ids = _result_lists(spark, sf)
    return output.invariants(output.id_lists(pairs, ids), output.id_lists(cands, ids, "candidate_entity_ids"), ids)


_folder = files.folder


def o04(spark: SparkSession, sf: str) -> DataFrame:
    """Write results, read the file back as text, and validate it."""
    pairs, cands, ids = _result_lists(spark, sf)
    folder = _folder(spark, "result")
    output.write_submission(pairs, cands, ids, folder)
    return output.validate_file(spark, f"{folder}/matches", ids, cands.select("id").distinct())


def io01(spark: SparkSession, sf: str) -> DataFrame:
    """Source TSV round trip."""
    path = _folder(spark, "tsv")
    src = run_sql(spark, sf, "SELECT concat('S1-', idx) AS entity_id, business_name, business_address, country FROM records")
    files.write_tsv(src, path)
    return files.read_tsv(spark, path, files.SOURCE)


def io06(spark: SparkSession, sf: str) -> DataFrame:
    """Stage table by country and source, one partition read back."""
    root = _folder(spark, "stage")
    files.save_stage(role(spark, sf, "records"), root, "train")
    assert files.stage_done(spark, f"{root}/train")
    return files.load(spark, root, "train", 2, "SMALL", ["idx", "business_name"])


def io15(spark: SparkSession, sf: str) -> DataFrame:
    pairs, _, ids = _result_lists(spark, sf)
    path = _folder(spark, "submission")
    files.write_tsv(output.id_lists(pairs, ids), path)
    return files.read_submission(spark, path)


def io19(spark: SparkSession, sf: str) -> DataFrame:
    r = role(spark, sf, "records")
    own, targets = files.mini_dataset(r.where("src = 1"), block_truth(spark, sf).select("s1_idx", "src", "t_idx"), r.where("src > 1"), 10)
    return own.groupBy("country").agg(F.count("*").alias("n")).join(targets.groupBy("country").agg(F.count("*").alias("m")), "country")


def io21(spark: SparkSession, sf: str) -> DataFrame:
    r = role(spark, sf, "records")
    return files.text_pairs(block_truth(spark, sf), r.where("src = 1"), r.where("src > 1")).select("s1_idx", "src", "t_idx", "a", "b")


def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return run_sql(spark, sf, TFIDF.format(tri="explode(transform(sequence(1, length(name) - 2), i -> substr(name, i, 3)))"))


#: parts of three sources: spelling variants of a reference part in source 2, other parts in source 3, and the same parts everywhere
_SOURCE_PARTS = """SELECT p_partkey AS rec, 1 AS src, lower(p_type) AS part FROM part UNION ALL SELECT p_partkey, 2, concat(lower(p_type), 'x') FROM part
  UNION ALL SELECT p_partkey, 3, lower(p_name) FROM part UNION ALL SELECT p_partkey, 1 + p_partkey % 3, lower(p_brand) FROM part UNION ALL SELECT p_partkey, 2, concat('zone ', p_size % 10) FROM part"""


TFIDF = """WITH nm AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, {tri} AS g FROM nm), tf AS (SELECT name, g, 1 + ln(count(*)) AS tf FROM g GROUP BY name, g),
  df AS (SELECT g, ln((1 + (SELECT count(*) FROM nm)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY g), v AS (SELECT name, tf.g, tf * idf AS x FROM tf JOIN df ON tf.g = df.g),
  n AS (SELECT name, sqrt(sum(x * x)) AS len FROM v GROUP BY name)
  SELECT a.name AS a, b.name AS b, round(sum(a.x * b.x) / max(na.len * nb.len), 6) AS cos FROM v a JOIN v b ON a.g = b.g AND a.name < b.name JOIN n na ON na.name = a.name JOIN n nb ON nb.name = b.name GROUP BY a.name, b.name"""

QUERIES = {
    "n01_fold": n01, "n02_romanise": n02, "n03_skeleton": n03,
    "n04_names": lambda s, d: records(s, d).select("idx", "name_norm", F.array_join("core", " ").alias("core"), F.array_join("legal", " ").alias("legal")),
    "n06_addresses": lambda s, d: records(s, d).select("idx", "addr_norm", "hno", "state", *[F.array_join(c, " ").alias(c) for c in ("nums", "loc", "street")]),
    "n08_records": lambda s, d: records(s, d).select("idx", "name_norm", "addr_norm", F.array_join("skel", " ").alias("skel")),
    "n10_alias_markers": n10,
    "n11_norm_part": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", text.norm_part(F.col("url")).alias("part")),
    "n12_segment": n12,
    "n13_ocr": lambda s, d: run_sql(s, d, "SELECT p_partkey, explode(split(translate(concat(p_name, ' ', p_brand), 'ols', '015'), ' ')) AS tok FROM part").withColumn("fixed", text.ocr_fix(F.col("tok"))),
    "n14_phonetic": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.phonetic_class(F.lower("p_name")).alias("k")),
    "n15_house_ids": lambda s, d: run_sql(s, d, "SELECT p_partkey, concat('Flat c-0', p_size, ' block ', p_size, '-b road') AS a FROM part").select("p_partkey", F.array_join(text.house_ids(F.col("a")), ",").alias("ids")),
    "n16_renormalise": n16,
    "n18_street_text": lambda s, d: role(s, d, "records").select("idx", text.street_text(F.col("business_address")).alias("street")),
    **{f"sim{k:02d}_{n}": one_metric(n) for k, n in ((1, "ratio"), (2, "partial"), (3, "token_sort"), (4, "token_set"), (5, "wratio"), (6, "jaro_winkler"))},
    "sim07_levenshtein_similarity": lambda s, d: run_sql(s, d, NAME_PAIRS).select("ia", "ib", F.round(sim.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("s")),
    "sim08_levenshtein": lambda s, d: run_sql(s, d, NAME_PAIRS).select("ia", "ib", F.levenshtein("a", "b").cast("long").alias("d")),
    "sim10_tfidf": tfidf,
    "sim11_cosine": lambda s, d: dense.group_pairs(s.read.parquet(f"{d}/embeddings.parquet"), "label"),
    "b01_keys": lambda s, d: blocking.keys(records(s, d), SQL_FAMILIES, hashed=False, extra=("src",)),
    "b04_all_families": lambda s, d: blocking.keys(records(s, d), extra=("src",)).groupBy("country", "src", "fam").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")),
    "b08_block_sql_families": lambda s, d: _r(blocked(s, d, SQL_FAMILIES, hashed=False), "bs", "bs_addr", "arcs").select("country", "s1_idx", "src", "t_idx", "bs", "bs_addr", "arcs", "nkeys", "nk_addr"),
    "b09_block_all": lambda s, d: blocked(s, d).select("country", "s1_idx", "src", "t_idx", F.round("bs", 6).alias("bs"), "nfam"),
    "b12_report": lambda s, d: blocking.report(blocked(s, d), block_truth(s, d), role(s, d, "records").where("src = 1")),
    "b13_miss_anatomy": misses,
    "b14_dense_new_pairs": lambda s, d: dense.cut(dense.new_pairs(neighbours(s, d), dense_truth(s, d).where("t_id % 3 = 0")), dense_truth(s, d)).select("q_id", "t_id", F.round("cos", 5).alias("cos")),
    "b15_variants": lambda s, d: neighbours(s, d).where("rank <= 6 AND cos >= 0.2").select("q_id", "t_id"),
    "j09_inverted_index": lambda s, d: blocking.score_pairs(blocking.keys(records(s, d).where("src = 1"), ("a2",), False), blocking.weighted_keys(records(s, d).where("src > 1"), blocking.keys(records(s, d).where("src > 1"), ("a2",), False, ("src",)), **CAPS)).select("s1_idx", "src", "t_idx", F.round("bs", 6).alias("bs"), "nkeys"),
    "j10_nearest": lambda s, d: neighbours(s, d).select("q_id", "t_id", F.round("cos", 5).alias("cos"), F.col("rank").cast("int").alias("rank")),
    "f02_flags": flags,
    "f03_record_context": lambda s, d: _r(features.record_context(run_sql(s, d, PAIRS)), "cx_rel", "cx_gap_c", "cx_gap_a").select("s1_idx", "src", "t_idx", F.col("cx_n").cast("long").alias("cx_n"), "cx_rel", "cx_gap_c", "cx_gap_a", F.col("cx_rank_c").cast("long").alias("cx_rank_c")),
    "f04_target_aggregates": lambda s, d: features.target_aggregates(run_sql(s, d, PAIRS), "bs", ("c_tset",)).select("src", "t_idx", "tx_n", F.round("_m1", 6).alias("m1"), F.round("_m2", 6).alias("m2"), "_mx_c_tset"),
    "f05_competition": lambda s, d: _r(features.competition(run_sql(s, d, PAIRS), "bs", ("c_tset",)), "tx_gap", "tx_rel", "tx_margin").select("s1_idx", "src", "t_idx", F.col("tx_rank").cast("int").alias("tx_rank"), "tx_gap", "tx_rel", "tx_margin", "tx_gap_c"),
    "f06_all_metrics": metrics,
    "f07_set_features": lambda s, d: run_sql(s, d, NAME_PAIRS).select("ia", "ib", *[F.round(c, 6).alias(k) for k, c in features.set_features(F.split("a", " "), F.split("b", " "), "core").items()]),
    "f08_idf_overlap": lambda s, d: _idf_overlap(s, d),
    "f11_general_context": lambda s, d: features.general_context(run_sql(s, d, PAIRS)).select("s1_idx", "src", "t_idx", "cx_n", "cx_n_src", F.col("cx_rank").cast("long").alias("cx_rank"), F.col("tx_rank").cast("long").alias("tx_rank"), F.round("tx_gap", 6).alias("tx_gap")),
    "f12_anchor_pairs": lambda s, d: features.anchor_pairs(run_sql(s, d, PAIRS)).select("s1_idx", "src", "t_idx", F.coalesce("same_idx", F.lit(-1)).alias("same_idx"), F.coalesce("oth_idx", F.lit(-1)).alias("oth_idx"), "coh_p_same", "coh_p_oth"),
    "f12_coherence": lambda s, d: features.coherence(run_sql(s, d, PAIRS), run_sql(s, d, "SELECT 2 AS src, p_partkey AS idx, p_name AS name, p_type AS address FROM part UNION ALL SELECT 3, p_partkey, p_name, p_type FROM part")).select("s1_idx", "src", "t_idx", "coh_c_same", "coh_c_oth", "coh_a_same", "coh_a_oth"),
    "f13_siblings": lambda s, d: features.sibling_features(run_sql(s, d, PAIRS)).select("s1_idx", "src", "t_idx", F.col("sib_heq_oth").cast("long").alias("sib_heq_oth"), F.coalesce("sib_heq_cgap", F.lit(-999.0)).alias("sib_heq_cgap"), "sib_cgap"),
    "f15_lexical_pack": lexical,
    "f16_stack_features": lambda s, d: _r(features.stack_features(run_sql(s, d, "SELECT s.s1_idx, s.src, s.t_idx, s.p, b.p AS ce FROM scores s JOIN scores2 b ON s.s1_idx = b.s1_idx AND s.src = b.src AND s.t_idx = b.t_idx")), "lp", "lce", "ce_gap_t", "dce", digits=5).select("s1_idx", "src", "t_idx", "lp", "lce", "ce_gap_t", "dce", F.col("ce_rank_s1").cast("long").alias("ce_rank_s1")),
    "m01_fillers": lambda s, d: _r(mining.filler_rates(token_pairs(s, d)), "rate"),
    "m02_split_fillers": lambda s, d: mining.split_fillers(mining.filler_rates(token_pairs(s, d)), run_sql(s, d, "SELECT DISTINCT explode(split(p_name, ' ')) AS tok FROM part"), 0.3).select("tok", "kind"),
    "m03_weak_labels": weak,
    "m04_replaced_names": m04,
    "m05_token_aliases": lambda s, d: mining.token_aliases(token_pairs(s, d)),
    "m06_part_aliases": lambda s, d: mining.part_aliases(run_sql(s, d, "SELECT array(p_type, p_brand) AS a, array(lower(p_type), p_brand) AS b FROM part")),
    "m07_purity": lambda s, d: mining.pure(run_sql(s, d, "SELECT l_partkey % 50 AS k, l_returnflag AS v FROM lineitem"), "k", "v", 5, 0.5).select("k", "v", "n", "total"),
    "m08_admin_parts": lambda s, d: mining.admin_parts(run_sql(s, d, "SELECT p_partkey AS rec, p_type AS part FROM part UNION ALL SELECT p_partkey, p_brand FROM part"), 4, 0.15),
    "m08_source_parts": lambda s, d: mining.source_parts(run_sql(s, d, _SOURCE_PARTS), min_count=5, min_reference=3).select("part", "f1", "f23"),
    "m09_transliterations": lambda s, d: mining.transliterations(token_pairs(s, d)),
    "m10_enrich": lambda s, d: role(s, d, "records").select("idx", F.array_join(enrich(F.split("business_name", " "), F.create_map(F.lit("red"), F.lit("crimson")), F.array(F.lit("old"))), " ").alias("core_a")),
    "ml01_roles": lambda s, d: learn.roles(role(s, d, "s1"), 300, 700).groupBy("role", "fold").agg(F.count("*").alias("n")),
    "ml02_stage1": lambda s, d: ml_scores(s, d).groupBy("y").agg(F.count("*").alias("n"), F.avg("p1").alias("p")),
    "ml04_prune": lambda s, d: learn.prune(ml_scores(s, d), most=3).select("s1_idx", "src", "t_idx", "p1", "r1"),
    "ml06_isotonic": ml06, "ml06_rows": lambda s, d: ml06(s, d).select("s1_idx", "src", "t_idx", F.col("p").between(0, 1).alias("valid")),
    "io12_model_round_trip": io12,
    "ml07_ensemble": lambda s, d: learn.ensemble(labelled(s, d)).select("s1_idx", "src", "t_idx", "stacked"),
    "ml08_stack": ml08, "ml11_empty_model": ml11,
    "ml12_pseudo_labels": lambda s, d: learn.pseudo_labels(role(s, d, "scores"), 0.9, 0.1).select("s1_idx", "src", "t_idx", F.col("y").cast("int").alias("y")),
    "ml13_leave_one_out": lambda s, d: learn.leave_one_out(labelled(s, d), ["1-URGENT", "5-LOW"], rounds=3),
    "ml15_importance": ml15,
    "ml18_members": lambda s, d: learn.members_mean(run_sql(s, d, "SELECT s.s1_idx, s.src, s.t_idx, s.p AS m1, b.p AS m2 FROM scores s JOIN scores2 b ON s.s1_idx = b.s1_idx AND s.src = b.src AND s.t_idx = b.t_idx"), ["m1", "m2"]).select("s1_idx", "src", "t_idx", F.round("ce", 4).alias("ce")),
    "ml19_uncertain_band": lambda s, d: learn.uncertain_band(role(s, d, "scores"), 0.3, 0.7).select("s1_idx", "src", "t_idx"),
    "ml20_unit_vectors": lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(F.aggregate(F.transform(sim.unit(F.col("embedding")), lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("norm")),
    "o01_id_lists": lambda s, d: output.id_lists(*[_result_lists(s, d)[k] for k in (0, 2)]),
    "o02_invariants": o02, "o04_validator": o04,
    "o05_assemble": lambda s, d: output.assemble(output.id_lists(*[_result_lists(s, d)[k] for k in (0, 2)]), output.id_lists(*[_result_lists(s, d)[k] for k in (1, 2)]), _result_lists(s, d)[2], "5-LOW"),
    "io01_tsv": io01, "io06_stage_table": io06, "io15_submission": io15, "io19_mini_dataset": io19, "io21_text_pairs": io21,
}


def _idf_overlap(spark: SparkSession, sf: str) -> DataFrame:
    # two classes are known by their first ids
    pairs = name_pairs(spark, sf, left="country, business_name AS a").select("country", F.get("xs", F.lit(0)).alias("s1_idx"), F.lit(2).alias("src"), F.get("ys", F.lit(0)).alias("t_idx"), F.split("a", " ").alias("a"), F.split("b", " ").alias("b"), "xs", "ys")
    idf = features.token_idf(role(spark, sf, "records").withColumn("core", F.split("business_name", " ")), "core")
    new = ["core_widf", "core_wjac", "core_wc12", "core_wc21", "core_mass1"]
    every = features.idf_overlap(pairs, idf, "core").repartition(tasks(spark), "s1_idx", "t_idx")
    return alike.expand(every, *[F.round(c, 5).alias(c) for c in new]).select(F.col("ia").alias("s1_idx"), F.col("ib").alias("t_idx"), *new)


_TOK = """rec AS (SELECT idx, src, country, list_distinct(string_split(business_name, ' ')) AS core, list_distinct([number, regexp_extract(brand, '[0-9]+')]) AS nums, lower(country) AS loc FROM records),
  ks AS (SELECT country, idx, src, 'n' AS fam, unnest(core) AS key FROM rec
    UNION ALL SELECT country, idx, src, 'np', array_to_string(list_sort(core), '|') FROM rec WHERE len(core) = 2
    UNION ALL SELECT country, idx, src, 'nl', k || '|' || loc FROM (SELECT country, idx, src, loc, unnest(core) AS k FROM rec)
    UNION ALL SELECT country, idx, src, 'a1', k || '|brand' FROM (SELECT country, idx, src, unnest(nums) AS k FROM rec)
    UNION ALL SELECT country, idx, src, 'a2', k || '|' || loc FROM (SELECT country, idx, src, loc, unnest(nums) AS k FROM rec)
    UNION ALL SELECT country, idx, src, 'a4', array_to_string(list_sort(nums), '|') FROM rec WHERE len(nums) = 2)"""
_SCORED = f"""{_TOK}, nt AS (SELECT country, src, count(*) AS n_t FROM rec WHERE src > 1 GROUP BY country, src),
  wk AS (SELECT k.country, k.src, fam, key, count(*) AS df, ln(max(n_t) + 1.0::DOUBLE) - ln(count(*)::DOUBLE) AS w FROM ks k JOIN nt ON nt.country = k.country AND nt.src = k.src GROUP BY k.country, k.src, fam, key HAVING count(*) <= CASE WHEN fam IN ('n', 's', 'h0') THEN {CAPS['single']} WHEN fam IN ('fn', 'fs') THEN {CAPS['full']} ELSE {CAPS['pair']} END),
  sp AS (SELECT a.country, a.idx AS s1_idx, b.src, b.idx AS t_idx, a.fam, w, 1.0::DOUBLE / df AS inv FROM ks a JOIN ks b ON a.country = b.country AND a.fam = b.fam AND a.key = b.key AND a.src = 1 AND b.src > 1 JOIN wk ON wk.country = b.country AND wk.src = b.src AND wk.fam = b.fam AND wk.key = b.key)"""
_NEIGHBOURS = """nn AS (SELECT q.vec_id AS q_id, t.vec_id AS t_id, list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS cos FROM embeddings q, embeddings t WHERE q.vec_id % 50 = 0),
  nk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cos, 9) DESC, t_id) AS rank FROM nn), nb AS (SELECT * FROM nk WHERE rank <= 11 AND q_id <> t_id)"""
_DT = "dt AS (SELECT q.vec_id AS q_id, t.vec_id AS t_id FROM embeddings q JOIN embeddings t ON q.label = t.label WHERE q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id)"
_Q = f"q AS ({PAIRS})"
_LISTS = "SELECT 'S1-' || s1.s1_idx AS source1_entity_id, coalesce(string_agg('S' || src || '-' || t_idx, ',' ORDER BY 'S' || src || '-' || t_idx), '') AS {c} FROM s1 LEFT JOIN {t} ON {t}.s1_idx = s1.s1_idx GROUP BY s1.s1_idx"



def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns of at most 60 letters: one bit for each letter of *a*, folded over *b*."""
    full = f"((1::BIGINT << length({a})::INTEGER) - 1)"
    mask = f"coalesce(list_sum(list_transform(range(length({a})), lambda at_: CASE WHEN substr({a}, at_ + 1, 1) = ch_ THEN 1::BIGINT << at_::INTEGER ELSE 0 END)), 0)::BIGINT"
    row = f"list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), lambda ch_: {mask})), lambda v_, m_: ((v_ + (v_ & m_)) | (v_ - (v_ & m_))) & {full})"
    return f"(length({a}) - bit_count({row}))"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100 ELSE 200.0::DOUBLE * {lcs_sql(a, b)} / (length({a}) + length({b})) END"


def token_set_sql(rows: str, keep: str, a: str = "a", b: str = "b") -> str:
    """Rows of *rows* with columns *keep* and ts, the token-set ratio of columns *a* and *b*."""
    words = f"SELECT {keep}, list_distinct(list_filter(string_split({a}, ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split({b}, ' '), lambda w: w <> '')) AS y FROM ({rows})"
    parts = f"""SELECT *, array_to_string(list_sort(list_filter(x, lambda w: list_contains(y, w))), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS o,
      array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS t FROM ({words})"""
    sides = f"SELECT *, trim(c || ' ' || o) AS l, trim(c || ' ' || t) AS r FROM ({parts})"
    return f"""SELECT {keep}, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN c <> '' AND (o = '' OR t = '') THEN 100 WHEN c = '' THEN {ratio_sql('l', 'r')}
      ELSE greatest({ratio_sql('l', 'r')}, {ratio_sql('c', 'l')}, {ratio_sql('c', 'r')}) END::DOUBLE AS ts FROM ({sides})"""


def _sorted_sql(c: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda w: w <> '')), ' ')"


ORACLES = {
    "sim01_ratio": f"SELECT ia, ib, round({ratio_sql('a', 'b')}, 6) AS ratio FROM ({NAME_PAIRS})",
    "sim03_token_sort": f"SELECT ia, ib, round({ratio_sql('sa', 'sb')}, 6) AS token_sort FROM (SELECT *, {_sorted_sql('a')} AS sa, {_sorted_sql('b')} AS sb FROM ({NAME_PAIRS}))",
    "sim04_token_set": f"SELECT ia, ib, round(ts, 6) AS token_set FROM ({token_set_sql(NAME_PAIRS, 'ia, ib')})",
    "m03_weak_labels": f"SELECT ia, ib, CASE WHEN ts >= 80 OR regexp_matches(b, '[^\\x00-\\x7F]') THEN 0 WHEN ts < 45 THEN 1 ELSE -1 END::INT AS y FROM ({token_set_sql(NAME_PAIRS, 'ia, ib, b')})",
    "ml01_roles": "SELECT role, (s1_idx % 2)::INT AS fold, count(*) AS n FROM (SELECT s1_idx, CASE WHEN r <= 300 THEN 'val' ELSE 'fit' END AS role FROM (SELECT s1_idx, row_number() OVER (ORDER BY md5('42:' || s1_idx), s1_idx) AS r FROM s1) WHERE r <= 1000) GROUP BY ALL",
    "m08_source_parts": f"""WITH sp AS ({_SOURCE_PARTS}), f AS (SELECT part, count(DISTINCT rec) FILTER (src = 1) AS f1, count(DISTINCT (src, rec)) FILTER (src > 1) AS f23 FROM sp GROUP BY part),
      k AS (SELECT * FROM f WHERE f23 >= 5 AND f1 <= 0.01 * f23), n AS (SELECT part AS ref FROM f WHERE f1 >= 3), v AS (SELECT DISTINCT part FROM k, n WHERE {ratio_sql('part', 'ref')} >= 80)
      SELECT part, f1, f23 FROM k WHERE part NOT IN (SELECT part FROM v)""",
    "ml06_rows": f"WITH q AS ({PAIRS}) SELECT q.s1_idx, q.src, q.t_idx, true AS valid FROM q JOIN s1 ON q.s1_idx = s1.s1_idx",
    "io12_model_round_trip": f"WITH q AS ({PAIRS}) SELECT (q.s1_idx % 2)::INT AS fold, count(*) AS n, true AS equal FROM q JOIN s1 ON q.s1_idx = s1.s1_idx GROUP BY 1",
    "n01_fold": "SELECT doc_id, md5(strip_accents(lower(replace(coalesce(text, ''), 'ß', 'ss')))) AS folded FROM documents",
    "n03_skeleton": f"SELECT p_partkey, tok, {_sql_skeleton('tok')} AS k FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS tok FROM part)",
    "n04_names": "SELECT idx, array_to_string(CASE WHEN w[1] = w[2] THEN [w[1]] ELSE w END, ' ') AS name_norm, array_to_string(CASE WHEN w[1] = w[2] THEN [w[1]] ELSE w END, ' ') AS core, '' AS legal FROM (SELECT idx, string_split(lower(business_name), ' ') AS w FROM records)",
    "n06_addresses": "SELECT idx, number || ' brand ' || b || ' st ' || lower(country) AS addr_norm, number AS hno, '' AS state, CASE WHEN number = b THEN number ELSE number || ' ' || b END AS nums, lower(country) AS loc, 'brand' AS street FROM (SELECT *, regexp_extract(brand, '[0-9]+') AS b FROM records)",
    "n11_norm_part": "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS part FROM pages",
    "n13_ocr": "SELECT p_partkey, tok, CASE WHEN length(regexp_replace(tok, '[^A-Za-z]', '', 'g')) >= 3 AND regexp_matches(tok, '[015]') AND NOT regexp_matches(tok, '[2346789]') THEN translate(tok, '015', 'ols') ELSE tok END AS fixed FROM (SELECT p_partkey, unnest(string_split(translate(p_name || ' ' || p_brand, 'ols', '015'), ' ')) AS tok FROM part)",
    "n14_phonetic": "SELECT p_partkey, translate(lower(p_name), 'bfpvcgjkqsxzdtmn', '1111222222223355') AS k FROM part",
    "n15_house_ids": "SELECT p_partkey, 'c' || p_size || ',' || p_size || 'b' AS ids FROM part",
    "n18_street_text": "SELECT idx, trim(regexp_replace(regexp_replace(business_address, '[0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS street FROM records",
    "sim06_jaro_winkler": f"SELECT ia, ib, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM ({NAME_PAIRS})",
    "sim07_levenshtein_similarity": f"SELECT ia, ib, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS s FROM ({NAME_PAIRS})",
    "sim08_levenshtein": f"SELECT ia, ib, levenshtein(a, b)::BIGINT AS d FROM ({NAME_PAIRS})",
    "sim10_tfidf": TFIDF.format(tri="unnest(list_transform(range(1, length(name) - 1), lambda i: substr(name, i, 3)))"),
    "sim11_cosine": "SELECT q.vec_id AS q_id, t.vec_id AS t_id, round(list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 5) AS cos FROM embeddings q JOIN embeddings t ON q.label = t.label AND q.vec_id < t.vec_id",
    "b01_keys": f"WITH {_TOK} SELECT country, idx, src, fam, key FROM ks",
    "b08_block_sql_families": f"""WITH {_SCORED}, sc AS (SELECT country, s1_idx, src, t_idx, sum(w) AS bs, sum(CASE WHEN fam LIKE 'a%' THEN w ELSE 0 END) AS bs_addr, sum(inv) AS arcs, count(*) AS nkeys, count(CASE WHEN fam LIKE 'a%' THEN 1 END) AS nk_addr FROM sp GROUP BY ALL),
      rk AS (SELECT *, row_number() OVER (PARTITION BY country, s1_idx, src ORDER BY round(bs, 6) DESC, t_idx) AS r0, row_number() OVER (PARTITION BY country, s1_idx, src ORDER BY round(bs_addr, 6) DESC, t_idx) AS r1 FROM sc)
      SELECT country, s1_idx, src, t_idx, round(bs, 6) AS bs, round(bs_addr, 6) AS bs_addr, round(arcs, 6) AS arcs, nkeys, nk_addr FROM rk WHERE r0 <= {BUDGETS['bs']} OR (r1 <= {BUDGETS['bs_addr']} AND bs_addr > 0)""",
    "b14_dense_new_pairs": f"WITH {_NEIGHBOURS}, {_DT}, nw AS (SELECT nb.* FROM nb ANTI JOIN (SELECT * FROM dt WHERE t_id % 3 = 0) k ON k.q_id = nb.q_id AND k.t_id = nb.t_id), tau AS (SELECT quantile_cont(cos, 1 - 0.95) AS tau FROM nw SEMI JOIN dt ON dt.q_id = nw.q_id AND dt.t_id = nw.t_id) SELECT q_id, t_id, round(cos, 5) AS cos FROM nw, tau WHERE round(cos, 9) >= round(tau, 9)",
    "b15_variants": f"WITH {_NEIGHBOURS} SELECT q_id, t_id FROM nb WHERE rank <= 6 AND cos >= 0.2",
    "j09_inverted_index": f"WITH {_SCORED} SELECT s1_idx, src, t_idx, round(sum(w), 6) AS bs, count(*) AS nkeys FROM sp WHERE fam = 'a2' GROUP BY ALL",
    "j10_nearest": f"WITH {_NEIGHBOURS} SELECT q_id, t_id, round(cos, 5) AS cos, rank::INT AS rank FROM nb",
    "f02_flags": "SELECT a.idx AS ia, b.idx AS ib, CASE WHEN a.idx % 5 = 0 OR b.number = '' THEN -1 WHEN a.number = b.number THEN 1 ELSE 0 END::INT AS h_eq, (b.idx % 7 = 0)::INT AS a_missing2 FROM records a JOIN records b ON a.brand = b.brand AND a.country = b.country AND a.idx < b.idx",
    "f03_record_context": f"WITH {_Q} SELECT s1_idx, src, t_idx, count(*) OVER w AS cx_n, round(CASE WHEN max(bs) OVER w = 0 THEN NULL ELSE bs / nullif(max(bs) OVER w, 0) END, 6) AS cx_rel, round(c_tset - max(c_tset) OVER w, 6) AS cx_gap_c, round(a_tset - max(a_tset) OVER w, 6) AS cx_gap_a, row_number() OVER (PARTITION BY s1_idx ORDER BY c_tset DESC, src, t_idx) AS cx_rank_c FROM q WINDOW w AS (PARTITION BY s1_idx)",
    "f04_target_aggregates": f"WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY src, t_idx ORDER BY bs DESC, s1_idx) AS k FROM q) SELECT src, t_idx, count(*) AS tx_n, round(max(bs), 6) AS m1, round(min(CASE WHEN k <= 2 THEN bs END), 6) AS m2, max(c_tset) AS _mx_c_tset FROM r GROUP BY src, t_idx",
    "f05_competition": f"""WITH {_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY src, t_idx ORDER BY bs DESC, s1_idx) AS k FROM q), a AS (SELECT src, t_idx, count(*) AS n, max(bs) AS m1, min(CASE WHEN k <= 2 THEN bs END) AS m2, max(c_tset) AS mc FROM r GROUP BY src, t_idx)
      SELECT s1_idx, q.src, q.t_idx, CASE WHEN bs >= m1 THEN 1 WHEN bs >= m2 THEN 2 ELSE 3 END::INT AS tx_rank, round(bs - m1, 6) AS tx_gap, round(bs / nullif(m1, 0), 6) AS tx_rel, round(bs - CASE WHEN bs >= m1 THEN CASE WHEN n <= 1 THEN 0 ELSE m2 END ELSE m1 END, 6) AS tx_margin, c_tset - mc AS tx_gap_c FROM q JOIN a ON a.src = q.src AND a.t_idx = q.t_idx""",
    "f07_set_features": f"SELECT ia, ib, i AS core_inter, round(i / (n1 + n2 - i), 6) AS core_jac, round(i / n1, 6) AS core_c12, round(i / n2, 6) AS core_c21, n1 AS core_n1, n2 AS core_n2 FROM (SELECT ia, ib, len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))))::DOUBLE AS i, len(list_distinct(string_split(a, ' ')))::DOUBLE AS n1, len(list_distinct(string_split(b, ' ')))::DOUBLE AS n2 FROM ({NAME_PAIRS}))",
    "f08_idf_overlap": f"""WITH t AS (SELECT DISTINCT country, idx, unnest(string_split(business_name, ' ')) AS tok FROM records), n AS (SELECT country, count(*) AS n FROM records GROUP BY country), f AS (SELECT t.country, tok, ln((max(n) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) AS idf FROM t JOIN n ON n.country = t.country GROUP BY t.country, tok),
      p AS ({NAME_PAIRS.replace('SELECT ', 'SELECT a.country, ')}), u AS (SELECT DISTINCT country, ia, ib, tok, list_contains(string_split(a, ' '), tok) AS i1, list_contains(string_split(b, ' '), tok) AS i2 FROM (SELECT *, unnest(list_concat(string_split(a, ' '), string_split(b, ' '))) AS tok FROM p)),
      m AS (SELECT ia, ib, sum(CASE WHEN i1 AND i2 THEN idf ELSE 0 END) AS i, sum(idf) AS u, sum(CASE WHEN i1 THEN idf ELSE 0 END) AS m1, sum(CASE WHEN i2 THEN idf ELSE 0 END) AS m2 FROM u JOIN f ON f.country = u.country AND f.tok = u.tok GROUP BY ia, ib)
      SELECT ia AS s1_idx, ib AS t_idx, round(i, 5) AS core_widf, round(i / u, 5) AS core_wjac, round(i / m1, 5) AS core_wc12, round(i / m2, 5) AS core_wc21, round(m1, 5) AS core_mass1 FROM m""",
    "f11_general_context": f"WITH {_Q} SELECT s1_idx, src, t_idx, count(*) OVER (PARTITION BY s1_idx) AS cx_n, count(*) OVER (PARTITION BY s1_idx, src) AS cx_n_src, row_number() OVER (PARTITION BY s1_idx, src ORDER BY bs DESC, t_idx) AS cx_rank, row_number() OVER (PARTITION BY src, t_idx ORDER BY bs DESC, s1_idx) AS tx_rank, round(bs - max(bs) OVER (PARTITION BY src, t_idx), 6) AS tx_gap FROM q",
    "f12_anchor_pairs": f"""WITH {_Q}, a AS (SELECT s1_idx, src, t_idx AS a_idx, p1 AS ap FROM (SELECT *, row_number() OVER (PARTITION BY s1_idx, src ORDER BY p1 DESC, t_idx) AS r FROM q) WHERE r = 1)
      SELECT q.s1_idx, q.src, q.t_idx, CASE WHEN s.a_idx <> q.t_idx THEN s.a_idx ELSE -1 END AS same_idx, coalesce(o.a_idx, -1) AS oth_idx, coalesce(s.ap, -1) AS coh_p_same, coalesce(o.ap, -1) AS coh_p_oth FROM q LEFT JOIN a s ON s.s1_idx = q.s1_idx AND s.src = q.src LEFT JOIN a o ON o.s1_idx = q.s1_idx AND o.src = 5 - q.src""",
    "f13_siblings": f"""WITH {_Q}, a AS (SELECT src, t_idx, count(CASE WHEN h_eq = 1 THEN 1 END) AS n1, max(CASE WHEN h_eq = 1 THEN c_tset END) AS hm, max(c_tset) AS cm FROM q GROUP BY src, t_idx)
      SELECT s1_idx, q.src, q.t_idx, n1 - (h_eq = 1)::INT AS sib_heq_oth, coalesce(c_tset - hm, -999) AS sib_heq_cgap, c_tset - cm AS sib_cgap FROM q JOIN a ON a.src = q.src AND a.t_idx = q.t_idx""",
    "f16_stack_features": """WITH z AS (SELECT s.s1_idx, s.src, s.t_idx, s.p, b.p AS ce FROM scores s JOIN scores2 b ON s.s1_idx = b.s1_idx AND s.src = b.src AND s.t_idx = b.t_idx), y AS (SELECT *, count(*) OVER (PARTITION BY src, t_idx) AS n, max(ce) OVER (PARTITION BY src, t_idx) AS m1, nth_value(ce, 2) OVER (PARTITION BY src, t_idx ORDER BY ce DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m2 FROM z)
      SELECT s1_idx, src, t_idx, round(ln(p / (1 - p)), 5) AS lp, round(ln(ce / (1 - ce)), 5) AS lce, round(CASE WHEN n = 1 THEN ce WHEN ce >= m1 THEN ce - m2 ELSE ce - m1 END, 5) AS ce_gap_t, round(ce - p, 5) AS dce, row_number() OVER (PARTITION BY s1_idx ORDER BY ce DESC, src, t_idx) AS ce_rank_s1 FROM y""",
    "m05_token_aliases": f"""SELECT 'widgett' AS tok, 'widget' AS alias, count(*) AS n, count(*) AS total
      FROM ({NAME_PAIRS}) WHERE ib % 3 <> 0 AND list_contains(string_split(a, ' '), 'widget') HAVING count(*) >= 5""",
    "m01_fillers": f"""WITH p AS ({NAME_PAIRS}), x AS (SELECT string_split(a, ' ') AS a, CASE WHEN ib % 3 = 0 THEN list_append(string_split(b, ' '), 'shop') ELSE list_transform(string_split(a, ' '), lambda t: CASE WHEN t = 'widget' THEN 'widgett' ELSE t END) END AS b FROM p),
      t AS (SELECT a, unnest(list_distinct(b)) AS tok FROM x) SELECT tok, count(CASE WHEN NOT list_contains(a, tok) THEN 1 END) AS k, count(*) AS n, round((count(CASE WHEN NOT list_contains(a, tok) THEN 1 END) + 0.5) / (count(*) + 1.0)::DOUBLE, 6) AS rate FROM t GROUP BY tok HAVING count(*) >= 30""",
    "f15_lexical_pack": f"SELECT ia, ib, CASE WHEN contains(ia::VARCHAR, ib::VARCHAR) OR contains(ib::VARCHAR, ia::VARCHAR) THEN 3 ELSE 4 END::INT AS h_status, round(least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)), 6) AS len_ratio, 0 AS a_missing2 FROM ({NAME_PAIRS})",
    "m06_part_aliases": "SELECT lower(p_type) AS part, p_type AS alias, count(*) AS n, count(*) AS total FROM part GROUP BY p_type HAVING count(*) >= 5",
    "m07_purity": "WITH c AS (SELECT l_partkey % 50 AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY k)::BIGINT AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS r FROM c) SELECT k, v, n, total FROM r WHERE r = 1 AND n >= 5 AND n >= 0.5 * total",
    "m08_admin_parts": "WITH p AS (SELECT p_partkey AS rec, p_type AS part FROM part UNION ALL SELECT p_partkey, p_brand FROM part), n AS (SELECT part, count(*) AS n FROM p GROUP BY part), b AS (SELECT a.part, b.part AS other, count(*) AS both_n FROM p a JOIN p b ON a.rec = b.rec AND a.part <> b.part GROUP BY ALL) SELECT b.part, count(*) AS n_implying FROM b JOIN n ON n.part = b.other WHERE both_n >= 0.15 * n GROUP BY b.part HAVING count(*) >= 4",
    "m10_enrich": "SELECT idx, array_to_string(list_filter(list_transform(string_split(business_name, ' '), lambda t: CASE WHEN t = 'red' THEN 'crimson' ELSE t END), lambda t: t <> 'old'), ' ') AS core_a FROM records",
    "ml12_pseudo_labels": "SELECT s1_idx, src, t_idx, y::INT AS y FROM (SELECT *, CASE WHEN p >= 0.9 AND p >= max(p) OVER (PARTITION BY src, t_idx) THEN 1 WHEN p <= 0.1 THEN 0 END AS y FROM scores) WHERE y IS NOT NULL",
    "ml18_members": "SELECT s.s1_idx, s.src, s.t_idx, round((s.p + b.p) / 2, 4) AS ce FROM scores s JOIN scores2 b ON s.s1_idx = b.s1_idx AND s.src = b.src AND s.t_idx = b.t_idx",
    "ml19_uncertain_band": "SELECT s1_idx, src, t_idx FROM scores WHERE p BETWEEN 0.3 AND 0.7",
    "ml20_unit_vectors": "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings",
    "o01_id_lists": _LISTS.format(t="truth", c="matched_entity_ids"),
    "o02_invariants": "SELECT unnest(['missing_records', 'unknown_records', 'repeated_records', 'wrong_prefix', 'not_candidates', 'repeated_matches']) AS rule, 0::BIGINT AS violations",
    "o04_validator": "SELECT unnest(['header', 'columns', 'repeated_rows', 'repeated_ids', 'self_matches', 'wrong_prefix', 'unknown_ids', 'missing_records', 'extra_records']) AS rule, 0::BIGINT AS violations",
    "o05_assemble": f"WITH a AS ({_LISTS.format(t='truth', c='matched_entity_ids')}), b AS ({_LISTS.format(t='scores', c='matched_entity_ids')}) SELECT a.source1_entity_id, CASE WHEN country = '5-LOW' THEN b.matched_entity_ids ELSE a.matched_entity_ids END AS matched_entity_ids FROM a JOIN b ON a.source1_entity_id = b.source1_entity_id JOIN s1 ON 'S1-' || s1.s1_idx = a.source1_entity_id",
    "io01_tsv": "SELECT 'S1-' || idx AS entity_id, business_name, business_address, country FROM records",
    "io06_stage_table": "SELECT idx, business_name FROM records WHERE src = 2 AND country = 'SMALL'",
    "io15_submission": "SELECT 'S1-' || s1_idx AS source1_entity_id, 'S' || src || '-' || t_idx AS id FROM truth WHERE s1_idx IN (SELECT s1_idx FROM s1)",
    "io21_text_pairs": "SELECT a.idx AS s1_idx, b.src, b.idx AS t_idx, a.business_name || ' | ' || a.business_address AS a, b.business_name || ' | ' || b.business_address AS b FROM records a JOIN records b ON a.country = b.country AND a.brand = b.brand AND a.number = b.number WHERE a.src = 1 AND b.src > 1",
}


def queries() -> dict:
    return QUERIES


def oracles() -> dict:
    return {k: with_roles(v) for k, v in ORACLES.items()}
