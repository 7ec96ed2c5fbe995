"""Decision and evaluation operators as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import analysis, decide, evaluate, metric
from tessera.operators.decide import Params
from tessera.plans.roles import role, run_sql, with_roles

BEST = Params(margin=0.1, m0=0.5, empty_bias=2.5, coh=1.0)
PLAIN = Params(m0=0.5, empty_bias=2.5)
POINTS = [(i, m, 0.0, m0, b) for i, (m, m0, b) in enumerate((m, m0, b) for m in (0.0, 0.1) for m0 in (0.2, 0.5) for b in (1.0, 2.5))]
#: (point, margin, floor, m0, empty_bias, coh)
COH_POINTS = [(0, 0.0, 0.0, 0.5, 2.5, 0.0), (1, 0.1, 0.0, 0.5, 2.5, 1.0), (2, 0.0, 0.3, 0.2, 1.0, 1.0), (3, 0.05, 0.0, 0.5, 1.5, 0.5)]
BY_COUNTRY = [("1-URGENT", 0.1, 0.0, 0.5, 2.5), ("2-HIGH", 0.0, 0.0, 0.2, 1.0), ("3-MEDIUM", 0.05, 0.3, 0.5, 1.5), ("4-NOT SPECIFIED", 0.0, 0.0, 0.0, 1.0), ("5-LOW", 0.1, 0.2, 0.75, 2.0)]


def points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POINTS, "point int, margin double, floor double, m0 double, empty_bias double")


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- oracle pieces -----------------------------------------------------------------------------
COHERENT = "coh AS (SELECT s1_idx, src, t_idx, o / (1 + o + 1.0::DOUBLE * (sum(o) OVER (PARTITION BY src, t_idx) - o)) AS p FROM (SELECT *, p / (1 - p) AS o FROM scores))"


def select_sql(source: str, margin: str = "0", floor: str = "0", m0: str = "0", bias: str = "1", keys: str = "", empty: str | None = None, carry: str = "") -> str:
    """CTEs ending in ``chosen``: the expected-F0.5 selection of *source*."""
    k = f"{keys}, " if keys else ""
    none = f"exp(sum(ln(1 - p)) OVER (PARTITION BY {k}s1_idx))"
    none = f"coalesce({empty}, {none})" if empty else none
    return f"""ex AS (SELECT *, row_number() OVER (PARTITION BY {k}src, t_idx ORDER BY p DESC, s1_idx) = 1 AND
    round(p - coalesce(nth_value(p, 2) OVER (PARTITION BY {k}src, t_idx ORDER BY p DESC, s1_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 9) >= {margin} AS ok FROM {source}),
  q AS (SELECT *, CASE WHEN ok THEN p ELSE 0 END AS q FROM ex),
  k AS (SELECT *, row_number() OVER (PARTITION BY {k}s1_idx ORDER BY q DESC, src, t_idx)::DOUBLE AS k, sum(q) OVER (PARTITION BY {k}s1_idx ORDER BY q DESC, src, t_idx ROWS UNBOUNDED PRECEDING) AS gain,
    sum(p) OVER (PARTITION BY {k}s1_idx) AS tot, round({none} * {bias}, 9) AS ef0 FROM q),
  e AS (SELECT *, round(1.25::DOUBLE * gain / (0.25::DOUBLE * (tot + {m0}) + k), 9) AS ef FROM k),
  t AS (SELECT *, max(ef) OVER (PARTITION BY {k}s1_idx) AS top FROM e),
  b AS (SELECT *, min(CASE WHEN ef = top THEN k END) OVER (PARTITION BY {k}s1_idx) AS bk FROM t),
  chosen AS (SELECT {k}s1_idx, src, t_idx, p{carry} FROM b WHERE k <= bk AND top > ef0 AND ok AND p >= {floor})"""


def macro_sql(pred: str, by: str = "country") -> str:
    """CTEs ending in ``rec`` (per record), and the macro query over it."""
    return f"""c AS (SELECT coalesce(a.s1_idx, b.s1_idx) AS s1_idx, count(a.s1_idx) AS n_pred, count(b.s1_idx) AS n_true, count(CASE WHEN a.s1_idx = b.s1_idx THEN 1 END) AS tp
    FROM {pred} a FULL OUTER JOIN truth b ON a.s1_idx = b.s1_idx AND a.src = b.src AND a.t_idx = b.t_idx GROUP BY 1),
  rec AS (SELECT s1.s1_idx, country, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp,
    CASE WHEN coalesce(n_pred, 0) = 0 AND coalesce(n_true, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END::DOUBLE AS f05,
    tp / nullif(n_pred, 0)::DOUBLE AS prec, tp / nullif(n_true, 0)::DOUBLE AS rec FROM s1 LEFT JOIN c ON s1.s1_idx = c.s1_idx)"""


MACRO = """SELECT coalesce(country, 'ALL') AS country, count(*) AS n, round(avg(f05), 6) AS f05, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall,
  round(avg(CASE WHEN n_true = 0 THEN f05 END), 6) AS singleton_f, sum(tp)::BIGINT AS tp FROM rec GROUP BY GROUPING SETS ((country), ())"""

PAIRS = "SELECT s1_idx, src, t_idx FROM chosen"


def _macro(spark: SparkSession, sf: str, pred: DataFrame) -> DataFrame:
    out = metric.macro_f05(pred, role(spark, sf, "truth"), role(spark, sf, "s1"), by="country")
    return _r(out, "f05", "precision", "recall", "singleton_f").select("country", "n", "f05", "precision", "recall", "singleton_f", "tp")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _macro(spark, sf, decide.select(role(spark, sf, "scores"), PLAIN))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("s1_idx", "src", "t_idx")


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """Records with all their pairs, most probable first, as arrays."""
    return run_sql(spark, sf, "WITH r AS (SELECT s1_idx, p, row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) AS k FROM scores) SELECT s1_idx, transform(array_sort(collect_list(struct(k, p))), x -> x.p) AS ps FROM r GROUP BY s1_idx")


def d05(spark: SparkSession, sf: str) -> DataFrame:
    d = _sets(spark, sf).withColumn("d", decide.prefix_distribution(F.col("ps")))
    return d.select("s1_idx", *[F.round(F.coalesce(F.get("d", F.lit(k)), F.lit(0.0)) + 1.23e-7, 5).alias(f"p{k}") for k in range(3)])


#: the chance of each subset of a record's pairs: the oracle enumerates what the operator folds
_SUBSETS = """sets AS (SELECT s1_idx, list(p ORDER BY p DESC, src, t_idx) AS ps FROM scores GROUP BY s1_idx),
  sub AS (SELECT s1_idx, ps, len(ps) AS n, m, list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(len(ps)), lambda i: CASE WHEN (m >> i::INTEGER) & 1 = 1 THEN ps[i + 1] ELSE 1 - ps[i + 1] END)), lambda a, b: a * b) AS w
    FROM (SELECT s1_idx, ps, unnest(range((1 << len(ps)::INTEGER)::BIGINT)) AS m FROM sets))"""


def d06(spark: SparkSession, sf: str) -> DataFrame:
    curve = _sets(spark, sf).withColumn("ef", decide.expected_f_exact("ps", 0.5))
    return curve.select("s1_idx", *[F.round(F.coalesce(F.get("ef", F.lit(k)), F.lit(-1.0)), 5).alias(f"ef{k}") for k in range(4)])


def _ef_sql(k: int) -> str:
    if k == 0:
        return "round(sum(CASE WHEN m = 0 THEN w END) * exp(-0.5), 5)"
    return f"CASE WHEN max(n) >= {k} THEN round(sum(w * 1.25::DOUBLE * bit_count(m & {2**k - 1}) / ({k} + 0.25::DOUBLE * (bit_count(m) + 0.5))), 5) ELSE -1 END"


def _tuned(spark: SparkSession, sf: str, by: str | None = None) -> DataFrame:
    ids = role(spark, sf, "s1").withColumn("half", decide.half_of("s1_idx"))
    return _r(decide.tune(role(spark, sf, "scores"), role(spark, sf, "truth"), ids, points(spark), by), "f05")


def d09(spark: SparkSession, sf: str) -> DataFrame:
    """Every point of the grid scored in one job."""
    return points(spark).drop("floor").join(F.broadcast(_tuned(spark, sf).select("point", "f05")), "point")  # a row a point


def d09_coherent(spark: SparkSession, sf: str) -> DataFrame:
    """A grid with the weight of competing odds as a parameter."""
    pts = spark.createDataFrame(COH_POINTS, "point int, margin double, floor double, m0 double, empty_bias double, coh double")
    return _r(decide.tune(role(spark, sf, "scores"), role(spark, sf, "truth"), role(spark, sf, "s1"), pts), "f05").select("point", "f05")


def d12(spark: SparkSession, sf: str) -> DataFrame:
    """The best point of one hash half, scored on the other."""
    by = _tuned(spark, sf, "half")
    best = decide.best_points(by, "half")
    return best.select((1 - F.col("half")).alias("half"), "point").join(by, ["half", "point"]).select("half", "point", "f05")


def d13(spark: SparkSession, sf: str) -> DataFrame:
    """Add-rules (status, bin, floor): the gain in hits and misses by half; a rule holds if it gains on both."""
    cand = _labelled(spark, sf).where("p < 0.9").select(F.col("src").alias("status"), F.floor(F.col("p") * 5).cast("int").alias("bin"), "p", "y", decide.half_of("s1_idx").alias("half"))
    return _r(analysis.add_rules(cand, ["status", "bin"], [0.1, 0.3, 0.5]), "g0", "g1", digits=4)


_ADD_RULES = """WITH cand AS (SELECT s.s1_idx, s.src AS status, CAST(floor(s.p * 5) AS INT) AS bin, s.p, CASE WHEN t.s1_idx IS NULL THEN 0 ELSE 1 END AS y, CAST((s.s1_idx * 2654435761) % 1000 < 500 AS INT) AS half
    FROM scores s LEFT JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx WHERE s.p < 0.9),
  floors AS (SELECT CAST(0.1 AS DOUBLE) AS fl UNION ALL SELECT CAST(0.3 AS DOUBLE) UNION ALL SELECT CAST(0.5 AS DOUBLE)),
  g AS (SELECT status, bin, fl, CAST(sum(CASE WHEN half = 0 THEN y - 0.25 * (1 - y) ELSE 0 END) AS DOUBLE) AS g0, CAST(sum(CASE WHEN half = 1 THEN y - 0.25 * (1 - y) ELSE 0 END) AS DOUBLE) AS g1, count(*) AS n FROM cand JOIN floors ON p >= fl GROUP BY status, bin, fl)
  SELECT status, bin, fl, n, round(g0, 4) AS g0, round(g1, 4) AS g1, g0 > 0 AND g1 > 0 AS keep FROM g"""


REPLICATES = 200


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    truth, ids = role(spark, sf, "truth"), role(spark, sf, "s1")
    a = metric.per_record(decide.select(role(spark, sf, "scores"), PLAIN), truth, ids)
    b = metric.per_record(decide.select(role(spark, sf, "scores2"), PLAIN), truth, ids)
    return evaluate.paired_bootstrap(a, b, "country", REPLICATES)


def e04(spark: SparkSession, sf: str) -> DataFrame:
    return _r(_compared(spark, sf), "f05_a", "f05_b", "ci_low", "ci_high", "p_b_better", "delta")


def e05(spark: SparkSession, sf: str) -> DataFrame:
    return _r(evaluate.gate(_compared(spark, sf)), "ci_low", "worst_group")


EV = {
    "e06_layer_recall": """WITH l AS (SELECT t.s1_idx, CASE WHEN s.p IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS blocked, CASE WHEN s.p >= 0.2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS stage1, CASE WHEN s.p >= 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS scored
        FROM truth t LEFT JOIN scores s ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx)
        SELECT coalesce(country, 'ALL') AS country, count(*) AS n, CAST(round(avg(blocked), 6) AS DOUBLE) AS blocked, CAST(round(avg(stage1), 6) AS DOUBLE) AS stage1, CAST(round(avg(scored), 6) AS DOUBLE) AS scored FROM l JOIN s1 ON l.s1_idx = s1.s1_idx GROUP BY GROUPING SETS ((country), ())""",
    "e07_calibration": """WITH y AS (SELECT s.p, CASE WHEN t.s1_idx IS NULL THEN 0 ELSE 1 END AS y FROM scores s LEFT JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx)
        SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(CAST(y AS DOUBLE)), 6) AS rate, round(avg((p - y) * (p - y)), 6) AS brier FROM y GROUP BY 1""",
    "e09_errors": """WITH y AS (SELECT coalesce(s.s1_idx, t.s1_idx) AS s1_idx, s.p, CASE WHEN t.s1_idx IS NULL THEN 0 ELSE 1 END AS y FROM scores s FULL OUTER JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx),
        z AS (SELECT *, max(y) OVER (PARTITION BY s1_idx) AS any_true FROM y)
        SELECT count(CASE WHEN y = 0 AND p >= 0.5 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND p IS NULL THEN 1 END) AS fn_not_candidate, count(CASE WHEN y = 1 AND p < 0.5 THEN 1 END) AS fn_rejected, count(CASE WHEN y = 0 AND p >= 0.5 AND any_true = 0 THEN 1 END) AS fp_singleton FROM z""",
    "e12_slices": """WITH y AS (SELECT s.p, s.src, s.t_idx % 3 AS slice, CASE WHEN t.s1_idx IS NULL THEN 0 ELSE 1 END AS y FROM scores s LEFT JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx)
        SELECT src, slice, CAST(floor(p * 5) AS INT) AS bin, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM y GROUP BY src, slice, 3""",
    "e13_fn_origin": """WITH m AS (SELECT t.*, CASE WHEN a.s1_idx IS NOT NULL THEN 1 ELSE 0 END AS base, CASE WHEN b.s1_idx IS NOT NULL THEN 1 ELSE 0 END AS dense FROM truth t LEFT JOIN (SELECT * FROM scores WHERE p > 0.6) a ON a.s1_idx = t.s1_idx AND a.src = t.src AND a.t_idx = t.t_idx LEFT JOIN (SELECT * FROM scores2 WHERE p > 0.6) b ON b.s1_idx = t.s1_idx AND b.src = t.src AND b.t_idx = t.t_idx)
        SELECT base, dense, count(*) AS n FROM m GROUP BY base, dense""",
    "e14_structure": """WITH a AS (SELECT s1_idx, count(*) AS n FROM scores WHERE p > 0.6 GROUP BY s1_idx), b AS (SELECT s1_idx, count(*) AS n FROM scores2 WHERE p > 0.6 GROUP BY s1_idx),
        o AS (SELECT x.s1_idx, count(*) AS n FROM scores x JOIN scores2 y ON x.s1_idx = y.s1_idx AND x.src = y.src AND x.t_idx = y.t_idx WHERE x.p > 0.6 AND y.p > 0.6 GROUP BY x.s1_idx)
        SELECT country, count(*) AS n, round(avg(CAST(coalesce(a.n, 0) AS DOUBLE)), 6) AS mean_a, round(avg(CAST(coalesce(b.n, 0) AS DOUBLE)), 6) AS mean_b, count(CASE WHEN a.n IS NULL THEN 1 END) AS empty_a, count(CASE WHEN b.n IS NULL THEN 1 END) AS empty_b, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS overlap,
        count(CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) AND coalesce(a.n, 0) = coalesce(o.n, 0) THEN 1 END) AS same FROM s1 LEFT JOIN a ON a.s1_idx = s1.s1_idx LEFT JOIN b ON b.s1_idx = s1.s1_idx LEFT JOIN o ON o.s1_idx = s1.s1_idx GROUP BY country""",
    "e15_progression": """WITH a AS (SELECT * FROM scores WHERE p > 0.6), b AS (SELECT * FROM scores2 WHERE p > 0.6),
        d AS (SELECT 'removed' AS what, a.p FROM a LEFT JOIN b ON a.s1_idx = b.s1_idx AND a.src = b.src AND a.t_idx = b.t_idx WHERE b.s1_idx IS NULL UNION ALL SELECT 'added', b.p FROM b LEFT JOIN a ON a.s1_idx = b.s1_idx AND a.src = b.src AND a.t_idx = b.t_idx WHERE a.s1_idx IS NULL)
        SELECT what, CASE WHEN p < 0.7 THEN '0.6-0.7' WHEN p < 0.8 THEN '0.7-0.8' ELSE '0.8+' END AS bucket, count(*) AS n FROM d GROUP BY what, 2""",
    "e16_transfer": """WITH v AS (SELECT CAST(floor(p * 5) AS INT) AS bucket, avg(CASE WHEN t.s1_idx IS NULL THEN 0.0 ELSE 1.0 END) AS prec FROM scores s LEFT JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx GROUP BY 1),
        m AS (SELECT CAST(floor(p * 5) AS INT) AS bucket, count(*) AS n FROM scores2 GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n, CAST(round(sum(n * CAST(prec AS DOUBLE)) / sum(n), 4) AS DOUBLE) AS expected FROM m JOIN v ON m.bucket = v.bucket""",
    "e17_band": """WITH b AS (SELECT s1_idx, count(CASE WHEN p < 0.3 THEN 1 END) AS lo, count(CASE WHEN p BETWEEN 0.3 AND 0.7 THEN 1 END) AS mid, count(CASE WHEN p > 0.7 THEN 1 END) AS hi FROM scores GROUP BY s1_idx)
        SELECT CAST(lo > 0 AS INT) AS has_lo, CAST(mid > 0 AS INT) AS has_mid, CAST(hi > 0 AS INT) AS has_hi, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    "e20_rule_probe": """WITH a AS (SELECT *, count(*) OVER (PARTITION BY src, t_idx) AS claims FROM scores WHERE p > 0.5), r AS (SELECT *, CASE WHEN claims > 1 AND p < 0.8 THEN 'removed' ELSE 'kept' END AS what FROM a)
        SELECT what, src, count(*) AS n, round(avg(p), 6) AS p FROM r GROUP BY what, src""",
    "e20_twin_probe": """WITH a AS (SELECT *, max(p) OVER (PARTITION BY s1_idx, src, t_idx % 7) AS best FROM scores), r AS (SELECT *, CASE WHEN p < best THEN 'removed' ELSE 'kept' END AS what FROM a)
        SELECT what, src, count(*) AS n, round(avg(p), 6) AS p FROM r GROUP BY what, src""",
    "e20_band_probe": """WITH r AS (SELECT *, CASE WHEN t_idx % 100 >= 45 AND t_idx % 100 < 80 THEN 'removed' ELSE 'kept' END AS what FROM scores)
        SELECT what, src, count(*) AS n, round(avg(p), 6) AS p FROM r GROUP BY what, src""",
    "e20_number_profile": """WITH r AS (SELECT *, CAST(t_idx % 5 AS INT) AS status, CASE WHEN p < 0.4 THEN 'removed' ELSE 'kept' END AS what FROM scores)
        SELECT what, status, count(*) AS n, round(avg(p), 6) AS p FROM r GROUP BY what, status""",
    "e21_projection": """WITH m AS (SELECT country, count(*) AS n FROM s1 GROUP BY country), known AS (SELECT country, n, CASE country WHEN '1-URGENT' THEN CAST(0.98 AS DOUBLE) WHEN '2-HIGH' THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS f FROM m)
        SELECT round((CAST(0.96 AS DOUBLE) * sum(n) - sum(CASE WHEN country <> '5-LOW' THEN n * f ELSE 0 END)) / sum(CASE WHEN country = '5-LOW' THEN n END), 6) AS f_unknown FROM known""",
}

_SINGLE_SEL = select_sql("scores", m0="0.5", bias="2.5")


def _pifit_counts() -> str:
    return """WITH a AS (SELECT least(count(*), 9) AS k, s1_idx FROM truth GROUP BY s1_idx), b AS (SELECT least(count(*), 9) AS k, s1_idx FROM scores WHERE p > 0.6 GROUP BY s1_idx),
      ref AS (SELECT k, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM a) AS f FROM a GROUP BY k), obs AS (SELECT k, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM b) AS g FROM b GROUP BY k),
      mean AS (SELECT sum(k * f) AS mu FROM ref),
      z AS (SELECT coalesce(ref.k, obs.k) AS k, coalesce(g, 0) AS g, coalesce(f, 0) * coalesce(ref.k, obs.k) / (SELECT mu FROM mean) AS biased, 0 AS o FROM ref FULL OUTER JOIN obs ON ref.k = obs.k),
      sh AS (SELECT z.k, z.g, z.biased, coalesce(r.f, 0) AS shifted FROM z LEFT JOIN ref r ON r.k = z.k - 1)
      SELECT round(least(1, greatest(0, sum((g - biased) * (shifted - biased)) / sum((shifted - biased) * (shifted - biased)))), 4) AS false_share FROM sh"""


EV["e18_pifit"] = _pifit_counts()
EV["e19_tv_distance"] = """WITH a AS (SELECT least(count(*), 9) AS k, s1_idx FROM truth GROUP BY s1_idx), f AS (SELECT k, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM a) AS f FROM a GROUP BY k),
  b AS (SELECT least(count(*), 9) AS k, s1_idx FROM scores WHERE p > 0.6 GROUP BY s1_idx), g AS (SELECT k, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM b) AS g FROM b GROUP BY k)
  SELECT round(0.5 * sum(abs(coalesce(f, 0) - coalesce(g, 0))), 6) AS tv FROM f FULL OUTER JOIN g ON f.k = g.k"""
EV["e10_anatomy"] = """WITH c AS (SELECT coalesce(s.s1_idx, t.s1_idx) AS s1_idx, CASE WHEN t.s1_idx IS NOT NULL THEN 1 ELSE 0 END AS y, CASE WHEN s.s1_idx IS NOT NULL THEN 1 ELSE 0 END AS cand, CASE WHEN s.p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores s FULL OUTER JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx),
  r AS (SELECT s1_idx, sum(y) AS nt, sum(pred) AS np, sum(y * pred) AS tp, sum(y * cand) AS tc, sum(CASE WHEN pred = 1 OR (y = 1 AND cand = 1) THEN 1 ELSE 0 END) AS nu FROM c GROUP BY s1_idx),
  v AS (SELECT s1.s1_idx, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(tc, 0) AS tc, coalesce(nu, 0) AS nu FROM s1 LEFT JOIN r ON r.s1_idx = s1.s1_idx),
  f AS (SELECT CASE WHEN np + nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE CAST(1.25 AS DOUBLE) * tp / (CAST(0.25 AS DOUBLE) * nt + np) END AS now_f, CASE WHEN nt = 0 THEN 1.0 WHEN tc = 0 THEN 0.0 ELSE CAST(1.25 AS DOUBLE) * tc / (CAST(0.25 AS DOUBLE) * nt + tc) END AS ceiling_f,
    CASE WHEN nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE CAST(1.25 AS DOUBLE) * tp / (CAST(0.25 AS DOUBLE) * nt + tp) END AS clean_f, CASE WHEN nu + nt = 0 THEN 1.0 WHEN tc = 0 THEN 0.0 ELSE CAST(1.25 AS DOUBLE) * tc / (CAST(0.25 AS DOUBLE) * nt + nu) END AS added_f,
    CASE WHEN nt = 0 AND np > 0 THEN 'fp_on_singleton' WHEN tp = nt AND np = nt THEN 'perfect' WHEN tc < nt THEN 'retrieval' WHEN tp < nt THEN 'rejected' ELSE 'extra' END AS kind FROM v)
  SELECT kind, count(*) AS n, CAST(round(avg(now_f), 6) AS DOUBLE) AS now_f, CAST(round(avg(clean_f), 6) AS DOUBLE) AS clean_f, CAST(round(avg(added_f), 6) AS DOUBLE) AS added_f, CAST(round(avg(ceiling_f), 6) AS DOUBLE) AS ceiling_f, CAST(round(sum(1 - now_f), 4) AS DOUBLE) AS loss FROM f GROUP BY kind"""
EV["e11_siblings"] = """WITH s AS (SELECT *, count(*) OVER (PARTITION BY src, t_idx) AS claims, CASE WHEN p >= max(p) OVER (PARTITION BY src, t_idx) THEN 1 ELSE 0 END AS best FROM scores),
  y AS (SELECT s.*, CASE WHEN t.s1_idx IS NULL THEN 0 ELSE 1 END AS y FROM s LEFT JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx)
  SELECT CAST(least(claims, 5) AS INT) AS claims, best, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_true, round(avg(p), 6) AS p FROM y GROUP BY 1, 2"""

_JOIN_POINTS = "pts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {m}::DOUBLE, {f}::DOUBLE, {m0}::DOUBLE, {b}::DOUBLE)" for i, m, f, m0, b in POINTS) + ") v(point, margin, floor, m0, empty_bias)), gs AS (SELECT s.*, p2.* FROM scores s CROSS JOIN pts p2)"
_GRID = f"{_JOIN_POINTS}, {select_sql('gs', 'margin', 'floor', 'm0', 'empty_bias', 'point')}"
_GRID_REC = f"""{_GRID}, h AS (SELECT point, c.s1_idx, count(*) AS n_pred, count(t.s1_idx) AS tp FROM chosen c LEFT JOIN truth t ON t.s1_idx = c.s1_idx AND t.src = c.src AND t.t_idx = c.t_idx GROUP BY ALL),
  n AS (SELECT s1_idx, count(*) AS n_true FROM truth GROUP BY s1_idx),
  r AS (SELECT pts.point, margin, m0, empty_bias, (s1.s1_idx * 2654435761) % 1000 < 500 AS half, CASE WHEN coalesce(n_pred, 0) + coalesce(n_true, 0) = 0 THEN 1.0 WHEN coalesce(tp, 0) = 0 THEN 0.0 ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * coalesce(n_true, 0) + n_pred) END AS f
    FROM s1 CROSS JOIN pts LEFT JOIN n ON n.s1_idx = s1.s1_idx LEFT JOIN h ON h.point = pts.point AND h.s1_idx = s1.s1_idx)"""
_COH_GS = "pts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {m}::DOUBLE, {f}::DOUBLE, {m0}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, m, f, m0, b, c in COH_POINTS) + """) v(point, margin, floor, m0, empty_bias, coh)),
  gs AS (SELECT s1_idx, src, t_idx, CASE WHEN coh = 0 THEN p0 ELSE o / (1 + o + coh * (tt - o)) END AS p, point, margin, floor, m0, empty_bias
    FROM (SELECT s1_idx, src, t_idx, p AS p0, p / (1 - p) AS o, sum(p / (1 - p)) OVER (PARTITION BY src, t_idx) AS tt FROM scores) CROSS JOIN pts)"""
_COH_REC = _GRID_REC.replace(_JOIN_POINTS, _COH_GS)
_COUNTRY = "cp AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {m}::DOUBLE, {f}::DOUBLE, {m0}::DOUBLE, {b}::DOUBLE)" for c, m, f, m0, b in BY_COUNTRY) + ") v(country, margin, floor, m0, empty_bias)), cs AS (SELECT s.*, cp.* FROM scores s JOIN s1 ON s.s1_idx = s1.s1_idx JOIN cp ON cp.country = s1.country)"
_Q0 = "SELECT s1_idx, round(CAST((s1_idx % 10) / 10.0 AS DOUBLE), 1) AS q0 FROM s1 WHERE s1_idx % 3 = 0"

def _roles(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [role(spark, sf, n) for n in names]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.with_label(*_roles(spark, sf, "scores", "truth"))


def _over(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [df.where("p > 0.6") for df in _roles(spark, sf, "scores", "scores2")]


#: the SQL of EV is the oracle of these
ANALYSIS = {
    "e06_layer_recall": lambda s, d: analysis.layer_recall(*_roles(s, d, "scores", "truth", "s1"), {"blocked": 0.0, "stage1": 0.2, "scored": 0.5}),
    "e07_calibration": lambda s, d: analysis.calibration(_labelled(s, d)),
    "e09_errors": lambda s, d: analysis.errors(*_roles(s, d, "scores", "truth")),
    "e10_anatomy": lambda s, d: analysis.anatomy(*_roles(s, d, "scores", "truth", "s1")),
    "e11_siblings": lambda s, d: analysis.siblings(_labelled(s, d)),
    "e12_slices": lambda s, d: analysis.slices(_labelled(s, d).withColumn("slice", F.col("t_idx") % 3), ["src", "slice"]),
    "e13_fn_origin": lambda s, d: analysis.origin(role(s, d, "truth"), dict(zip(("base", "dense"), _over(s, d)))),
    "e14_structure": lambda s, d: analysis.structure(*_over(s, d), role(s, d, "s1")),
    "e15_progression": lambda s, d: analysis.progression(*_over(s, d), F.expr("CASE WHEN p < 0.7 THEN '0.6-0.7' WHEN p < 0.8 THEN '0.7-0.8' ELSE '0.8+' END")),
    "e16_transfer": lambda s, d: analysis.transfer(_labelled(s, d), role(s, d, "scores2")),
    "e17_band": lambda s, d: analysis.bands(role(s, d, "scores")),
    "e18_pifit": lambda s, d: analysis.false_share(role(s, d, "truth"), _over(s, d)[0]),
    "e19_tv_distance": lambda s, d: analysis.tv_distance(role(s, d, "truth"), _over(s, d)[0]),
    "e20_rule_probe": lambda s, d: analysis.probe(role(s, d, "scores").where("p > 0.5"), analysis.claimed(0.8), ["src"]),
    "e20_twin_probe": lambda s, d: analysis.probe(role(s, d, "scores").withColumn("place", F.col("t_idx") % 7), analysis.twin("place", "p"), ["src"]),
    "e20_band_probe": lambda s, d: analysis.probe(role(s, d, "scores").withColumn("likeness", F.col("t_idx") % 100), analysis.band("likeness", 45, 80), ["src"]),
    "e20_number_profile": lambda s, d: analysis.probe(role(s, d, "scores").withColumn("status", (F.col("t_idx") % 5).cast("int")), F.col("p") < 0.4, ["status"]),
    "e21_projection": lambda s, d: analysis.projection(role(s, d, "s1"), {"1-URGENT": 0.98, "2-HIGH": 0.97}, 0.96, "5-LOW", rest=0.95),
}

QUERIES = {
    "flagship_select_macro": flagship,
    "d01_coherent": lambda s, d: _r(decide.coherent(role(s, d, "scores"), 1.0), "p"),
    "d02_exclusivity": lambda s, d: decide.exclusivity(role(s, d, "scores"), 0.1).select("s1_idx", "src", "t_idx", "ok"),
    "d03_select": lambda s, d: _pairs(decide.select(role(s, d, "scores"), PLAIN)),
    "d03_select_coherent": lambda s, d: _pairs(decide.select(role(s, d, "scores"), BEST)),
    "d04_threshold": lambda s, d: _pairs(decide.threshold_select(role(s, d, "scores"), 0.5)),
    "d05_prefix_distribution": d05,
    "d06_expected_f": d06,
    "d07_select_exact": lambda s, d: _pairs(decide.select_exact(role(s, d, "scores"), Params(m0=0.5, empty_bias=1.5), max_n=6)),
    "d08_select_q": lambda s, d: _pairs(decide.select_q(role(s, d, "scores"), run_sql(s, d, _Q0), PLAIN)),
    "d09_grid": d09,
    "d09_coherent_grid": d09_coherent,
    "d10_by_country": lambda s, d: _pairs(decide.select_by_country(role(s, d, "scores"), role(s, d, "s1"), s.createDataFrame(BY_COUNTRY, "country string, margin double, floor double, m0 double, empty_bias double"))),
    "d11_quick": lambda s, d: _macro(s, d, decide.select(role(s, d, "scores2"), PLAIN)),
    "d12_half_tuning": d12,
    "d13_add_rules": d13,
    "e01_macro": lambda s, d: _macro(s, d, decide.threshold_select(role(s, d, "scores"), 0.5)),
    "e02_closed_form": lambda s, d: metric.per_record(decide.threshold_select(role(s, d, "scores"), 0.3), role(s, d, "truth"), role(s, d, "s1")).agg(F.round(F.avg("f05"), 6).alias("f05"), F.count("*").alias("n")),
    "e03_per_record": lambda s, d: _r(metric.per_record(decide.threshold_select(role(s, d, "scores"), 0.5), role(s, d, "truth"), role(s, d, "s1")), "f05").select("s1_idx", "country", "n_pred", "n_true", "tp", "f05"),
    "e04_bootstrap": e04,
    "e05_gate": e05,
    "e08_segments": lambda s, d: metric.per_record(decide.threshold_select(role(s, d, "scores"), 0.5), role(s, d, "truth"), role(s, d, "s1")).groupBy(F.least("n_true", F.lit(5)).cast("int").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("f05"), 6).alias("f05")),
    **ANALYSIS,
}

_CUTS = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in evaluate.POISSON)
#: both runs by record, the same draws, the replicates' differences
_BOOT = f"""fa AS (WITH {select_sql('scores', m0='0.5', bias='2.5')}, {macro_sql('chosen')} SELECT s1_idx, country, f05 FROM rec),
  fb AS (WITH {select_sql('scores2', m0='0.5', bias='2.5')}, {macro_sql('chosen')} SELECT s1_idx, f05 FROM rec),
  d AS (SELECT fa.s1_idx, fa.country, fa.f05 AS fa, fb.f05 AS fb FROM fa JOIN fb ON fa.s1_idx = fb.s1_idx),
  u AS (SELECT *, CAST('0x' || substr(md5('42:' || r || ':' || s1_idx), 1, 8) AS BIGINT)::DOUBLE / {1 << 32} AS u FROM d, (SELECT unnest(range({REPLICATES + 1})) AS r)),
  w AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE {_CUTS} END AS w FROM u),
  rp AS (SELECT coalesce(country, 'ALL') AS country, r, sum(w) AS n, sum(w * fa) / sum(w) AS fa, sum(w * fb) / sum(w) AS fb FROM w GROUP BY GROUPING SETS ((country, r), (r))),
  bt AS (SELECT country, max(CASE WHEN r = 0 THEN n END)::BIGINT AS n, max(CASE WHEN r = 0 THEN fa END) AS f05_a, max(CASE WHEN r = 0 THEN fb END) AS f05_b,
    quantile_cont(fb - fa, 0.025) FILTER (r > 0) AS ci_low, quantile_cont(fb - fa, 0.975) FILTER (r > 0) AS ci_high, avg((fb > fa)::INT::DOUBLE) FILTER (r > 0) AS p_b_better FROM rp GROUP BY country)"""
_THRESH = "th AS (SELECT s1_idx, src, t_idx, p FROM (SELECT *, row_number() OVER (PARTITION BY src, t_idx ORDER BY p DESC, s1_idx) AS r FROM scores WHERE p >= {x}) WHERE r = 1)"

ORACLES = {
    "flagship_select_macro": f"WITH {_SINGLE_SEL}, {macro_sql('chosen')} {MACRO}",
    "d01_coherent": f"WITH {COHERENT} SELECT s1_idx, src, t_idx, round(p, 6) AS p FROM coh",
    "d02_exclusivity": f"WITH {select_sql('scores', margin='0.1')} SELECT s1_idx, src, t_idx, ok FROM ex",
    "d03_select": f"WITH {_SINGLE_SEL} {PAIRS}",
    "d03_select_coherent": f"WITH {COHERENT}, {select_sql('coh', '0.1', '0', '0.5', '2.5')} {PAIRS}",
    "d04_threshold": f"WITH {_THRESH.format(x=0.5)} SELECT s1_idx, src, t_idx FROM th",
    "d05_prefix_distribution": f"WITH {_SUBSETS} SELECT s1_idx, " + ", ".join(f"round(coalesce(sum(CASE WHEN bit_count(m) = {k} THEN w END), 0) + 0.000000123, 5) AS p{k}" for k in range(3)) + " FROM sub GROUP BY s1_idx",
    "d06_expected_f": f"WITH {_SUBSETS} SELECT s1_idx, " + ", ".join(f"{_ef_sql(k)} AS ef{k}" for k in range(4)) + " FROM sub GROUP BY s1_idx",
    "d07_select_exact": f"""WITH {select_sql('scores')}, o AS (SELECT *, row_number() OVER (PARTITION BY s1_idx ORDER BY ok DESC, p DESC, src, t_idx) AS n FROM ex), o6 AS (SELECT * FROM o WHERE n <= 6),
      st AS (SELECT s1_idx, list(p ORDER BY n) AS ps, count(CASE WHEN ok THEN 1 END) AS n_ok FROM o6 GROUP BY s1_idx),
      sb AS (SELECT s1_idx, n_ok, m, list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(len(ps)), lambda i: CASE WHEN (m >> i::INTEGER) & 1 = 1 THEN ps[i + 1] ELSE 1 - ps[i + 1] END)), lambda a, b: a * b) AS w FROM (SELECT *, unnest(range((1 << len(ps)::INTEGER)::BIGINT)) AS m FROM st)),
      ef AS (SELECT s1_idx, kk, round(CASE WHEN kk = 0 THEN sum(CASE WHEN m = 0 THEN w ELSE 0 END) * exp(-0.5) * 1.5 ELSE sum(w * 1.25::DOUBLE * bit_count(m & ((1 << kk::INTEGER) - 1)::BIGINT) / (kk + 0.25::DOUBLE * (bit_count(m) + 0.5))) END, 9) AS v FROM sb, (SELECT unnest(range(7)) AS kk) WHERE kk <= n_ok GROUP BY s1_idx, kk),
      bk AS (SELECT s1_idx, kk FROM (SELECT *, row_number() OVER (PARTITION BY s1_idx ORDER BY v DESC, kk) AS r FROM ef) WHERE r = 1)
      SELECT o6.s1_idx, src, t_idx FROM o6 JOIN bk ON bk.s1_idx = o6.s1_idx WHERE n <= kk AND ok""",
    "d08_select_q": f"WITH e0 AS ({_Q0}), sq AS (SELECT s.*, q0 FROM scores s LEFT JOIN e0 ON e0.s1_idx = s.s1_idx), {select_sql('sq', m0='0.5', bias='2.5', empty='q0')} {PAIRS}",
    "d09_grid": f"WITH {_GRID_REC} SELECT point, margin, m0, empty_bias, round(avg(f), 6) AS f05 FROM r GROUP BY ALL",
    "d09_coherent_grid": f"""WITH {_COH_REC} SELECT point, round(avg(f), 6) AS f05 FROM r GROUP BY point""",
    "d10_by_country": f"WITH {_COUNTRY}, {select_sql('cs', 'margin', 'floor', 'm0', 'empty_bias')} {PAIRS}",
    "d11_quick": f"WITH {select_sql('scores2', m0='0.5', bias='2.5')}, {macro_sql('chosen')} {MACRO}",
    "d12_half_tuning": f"WITH {_GRID_REC}, hp AS (SELECT half, point, round(avg(f), 6) AS f05 FROM r GROUP BY half, point), best AS (SELECT half, point FROM (SELECT *, row_number() OVER (PARTITION BY half ORDER BY f05 DESC, point) AS k FROM hp) WHERE k = 1) SELECT (NOT best.half)::INT AS half, best.point, hp.f05 FROM best JOIN hp ON hp.half = NOT best.half AND hp.point = best.point",
    "d13_add_rules": _ADD_RULES,
    "e01_macro": f"WITH {_THRESH.format(x=0.5)}, {macro_sql('th')} {MACRO}",
    "e02_closed_form": f"WITH {_THRESH.format(x=0.3)}, {macro_sql('th')} SELECT round(avg(f05), 6) AS f05, count(*) AS n FROM rec",
    "e03_per_record": f"WITH {_THRESH.format(x=0.5)}, {macro_sql('th')} SELECT s1_idx, country, n_pred, n_true, tp, round(f05, 6) AS f05 FROM rec",
    "e04_bootstrap": f"WITH {_BOOT} SELECT country, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("f05_a", "f05_b", "ci_low", "ci_high", "p_b_better")) + ", round(f05_b - f05_a, 6) AS delta FROM bt",
    "e05_gate": f"""WITH {_BOOT}, g AS (SELECT max(CASE WHEN country = 'ALL' THEN ci_low END) AS ci_low, min(CASE WHEN country <> 'ALL' THEN f05_b - f05_a END) AS worst_group FROM bt)
      SELECT round(ci_low, 6) AS ci_low, round(worst_group, 6) AS worst_group, ci_low > 0 AND worst_group >= 0 AS accept FROM g""",
    "e08_segments": f"WITH {_THRESH.format(x=0.5)}, {macro_sql('th')} SELECT least(n_true, 5)::INT AS segment, count(*) AS n, round(avg(f05), 6) AS f05 FROM rec GROUP BY 1",
    **EV,
}


def queries() -> dict:
    return QUERIES


def oracles() -> dict:
    return {k: with_roles(v) for k, v in ORACLES.items()}
