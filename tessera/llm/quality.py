"""Weak supervision for document quality (native).

Every rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation estimates, without
labels, how often each rule's vote is right; a document is kept when the posterior probability that it is good reaches ``THRESHOLD``.  A hard base (too few words,
mostly repeated windows) comes first.

Documents enter the estimation only as counts of vote patterns, of which there are at most
3 ** len(RULES) at any input size.  The whole iteration is one SQL expression over that one row; the
posteriors are joined back by pattern code.  There is no shuffle of texts.

Edge cases: a null or empty text has no words, fails the base and abstains on every rule; an empty
table gives an empty result; repeated rows get equal verdicts; null ids pass through; extra columns
do not take part, and in :func:`filter_documents` they pass through.  Ties at the threshold are kept.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import packed, stage, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
ROUNDS = 40
#: Share of good documents that the posterior assumes before any vote.  It is given, not estimated:
#: most rules vote one way only, and a free balance would then drown every lone vote.
CLASS_BALANCE = 0.5
#: Start of the estimation, and the pseudo-votes that hold a rule there while it has few votes.
ACCURACY, PSEUDO = 0.8, 4.0
#: Estimates stay within these bounds.
LEAST, MOST = 0.02, 0.98

#: name, bad if, good if; SQL over the features.  Whatever is neither is an abstention.
RULES = [
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "false"),
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "false"),
    ("repeat_words", "100 * n_repeat_words > 30 * n_words", "false"),
    ("capitals", "10 * n_upper > 3 * word_chars", "false"),
    ("shouting", "10 * n_exclaim > n_words", "false"),
    ("letters", "10 * n_letters < 7 * word_chars", "10 * n_letters >= 9 * word_chars AND 10 * n_upper <= word_chars"),
    ("prose", "false", "100 * n_symbols <= n_words AND 100 * n_exclaim <= n_words AND 100 * n_repeat_words <= 15 * n_words"),
]

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_letters"]


def _kept_length(pattern: str) -> Column:
    return F.length(F.regexp_replace("_t", pattern, "")).cast("long")


#: Words that lie in a repeated 3-word window.  wh: hashes of all windows; ws: (hash, start), sorted; rp: starts of repeated windows.
_SORTED = "if(size(wh) < 2 OR size(array_distinct(wh)) = size(wh), cast(array() AS array<struct<h:bigint,i:int>>), sort_array(transform(wh, (h, i) -> struct(h AS h, i AS i))))"
_REPEATED = "filter(transform(ws, (x, k) -> if(x.h = get(ws, k - 1).h OR x.h = get(ws, k + 1).h, x.i, -1)), i -> i >= 0)"
_COVERED = "cast(if(size(rp) = 0, 0, size(array_distinct(flatten(array(rp, transform(rp, i -> i + 1), transform(rp, i -> i + 2)))))) AS bigint)"


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row__``, the columns *keep* of *docs* (all by default), and ``_f``, the quality features."""
    keep = docs.columns if keep is None else keep
    words = F.expr(r"regexp_extract_all(_t, '[^\\x20\\x09-\\x0D]+', 0)")
    lines = F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    return (
        docs.select(packed(docs, keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
        .select(
            "row__",
            words.alias("_w"), lines.alias("_l"),
            F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("_wc"),
            _kept_length(r"[^#*$%&|<>]+").alias("_sy"), _kept_length(r"\P{Lu}+").alias("_up"),
            _kept_length(r"[^!]+").alias("_ex"), _kept_length(r"\P{L}+").alias("_le"),
        )
        .select("*", F.expr("if(size(_w) < 3, cast(array() AS array<bigint>), transform(slice(_w, 3, size(_w)), (x, i) -> xxhash64(_w[i], _w[i + 1], x)))").alias("wh"))
        .select("*", F.expr(_SORTED).alias("ws"))
        .select("*", F.expr(_REPEATED).alias("rp"))
        .select(
            "row__",
            F.struct(
                F.size("_w").cast("long").alias("n_words"), F.col("_wc").alias("word_chars"), F.col("_sy").alias("n_symbols"),
                F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                F.expr(_COVERED).alias("n_repeat_words"), F.col("_up").alias("n_upper"), F.col("_ex").alias("n_exclaim"), F.col("_le").alias("n_letters"),
            ).alias("_f"),
        )
    )


def _sql_votes(prefix: str) -> list[str]:
    """CASE expressions of the rules over features named *prefix* + name."""
    def own(cond: str) -> str:
        for f in sorted(FEATURES, key=len, reverse=True):
            cond = re.sub(rf"\b{f}\b", f"{prefix}{f}", cond)
        return cond

    return [f"CASE WHEN {own('n_words = 0')} THEN 0 WHEN {own(bad)} THEN -1 WHEN {own(good)} THEN 1 ELSE 0 END" for _, bad, good in RULES]


def vote(featured: DataFrame) -> DataFrame:
    """Add ``_v``: the pattern of votes as one number, base 3, first rule lowest."""
    code = " + ".join(f"{3**k} * (1 + {v})" for k, v in enumerate(_sql_votes("_f.")))
    return featured.withColumn("_v", F.expr(f"cast({code} AS int)"))


def posteriors(patterns: DataFrame) -> DataFrame:
    """(_v, p_good) for the vote patterns of *patterns* (_v, n): EM as one expression over one row."""
    n = len(RULES)
    e_step = f"""transform(pats, p -> named_struct('n', p.n, 'v', p.v, 'g', 1D / (1D + exp(-(
        {math.log(CLASS_BALANCE / (1 - CLASS_BALANCE))}D + aggregate(sequence(0, {n - 1}), 0D, (acc, j) -> acc + p.v[j] * ln(m[j] / (1D - m[j]))))))))"""
    right = "if(p.v[j] = 1, p.g, if(p.v[j] = -1, 1D - p.g, 0D))"
    share = f"(aggregate(w, {PSEUDO * ACCURACY}D, (s, p) -> s + p.n * {right})) / (aggregate(w, {PSEUDO}D, (s, p) -> s + p.n * abs(p.v[j])))"
    m_step = f"transform(array({e_step}), w -> transform(sequence(0, {n - 1}), j -> least({MOST}D, greatest({LEAST}D, {share}))))[0]"
    start = f"array_repeat({ACCURACY}D, {n})"
    digits = ", ".join(f"pmod(_v div {3**k}, 3) - 1" for k in range(n))
    one = patterns.agg(F.sort_array(F.collect_list(F.expr(f"named_struct('c', _v, 'n', cast(n AS double), 'v', array({digits}))"))).alias("pats")).where(F.size("pats") > 0)
    return (
        one.withColumn("m", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (m, i) -> {m_step})"))
        .select(F.explode(F.expr(f"transform(arrays_zip(pats, {e_step}), z -> named_struct('_v', z.pats.c, 'p_good', z.`1`.g))")).alias("x"))
        .select("x._v", F.col("x.p_good"))
    )


def judge(featured: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``p_good`` and ``kept`` to staged rows with ``_f`` and ``_v``."""
    found = posteriors(featured.groupBy("_v").agg(F.count("*").alias("n")))
    base = (F.col("_f.n_words") < MIN_WORDS) | (100 * F.col("_f.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_f.n_words"))
    # at most 3 ** len(RULES) rows of two numbers
    return (
        featured.join(F.broadcast(found), "_v")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= THRESHOLD))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    staged = stage(vote(features(docs, keep=["doc_id"])), "quality")
    return judge(staged).select(
        "row__.doc_id", *[F.col(f"_f.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", F.round("p_good", 6).alias("p_good"),
    )


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of *docs* that pass, with their own columns."""
    staged = stage(vote(features(docs, text_col)), "quality-docs")
    return judge(staged).where("kept").select("row__.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents the rules reject go."""
    return filter_documents(docs)


def _oracle() -> str:
    n = len(RULES)
    right = "CASE p.v[j] WHEN 1 THEN p.g WHEN -1 THEN 1 - p.g ELSE 0 END"
    m = f"least({MOST}, greatest({LEAST}, ({PSEUDO * ACCURACY} + list_sum([p.n * {right} for p in w])) / ({PSEUDO} + list_sum([p.n * abs(p.v[j]) for p in w]))))"
    terms = " + ".join(f"p.v[{j}] * ln(m[{j}] / (1 - m[{j}]))" for j in range(1, n + 1))
    e_step = f"[{{'c': p.c, 'n': p.n, 'v': p.v, 'g': 1 / (1 + exp(-({math.log(CLASS_BALANCE / (1 - CLASS_BALANCE))} + {terms})))}} for p in pats]"
    digits = ", ".join(f"(c // {3**k}) % 3 - 1" for k in range(n))
    code = " + ".join(f"{3**k} * (1 + {v})" for k, v in enumerate(_sql_votes("")))
    return rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (
    SELECT rid, i + unnest([0, 1, 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1) GROUP BY rid
), f AS (
  SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaim, length(regexp_replace(t, '\P{{L}}+', '', 'g'))::BIGINT AS n_letters
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w) w LEFT JOIN rep USING (rid)
), v AS (SELECT *, ({code})::INTEGER AS c FROM f),
p AS (SELECT list({{'c': c, 'n': n, 'v': [{digits}]}} ORDER BY c) AS pats FROM (SELECT c, count(*)::DOUBLE AS n FROM v GROUP BY c)),
em(it, m) AS (
  SELECT 0, [{ACCURACY}::DOUBLE for j in range({n})]
  UNION ALL
  SELECT it + 1, [{m} for j in range(1, {n + 1})] FROM (SELECT it, {e_step} AS w FROM em, p WHERE it < {ROUNDS})
), post AS (SELECT x.c AS c, x.g AS g FROM (SELECT unnest({e_step}) AS x FROM em, p WHERE it = {ROUNDS}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND g >= {THRESHOLD} AS kept, round(g, 6) AS p_good
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM v) JOIN post USING (c)
"""


ORACLE = _oracle()
