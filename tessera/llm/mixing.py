"""Soft-membership mixing to target weights (native).

A multinomial logistic regression, fitted on the labelled table, gives every document a posterior over the
domains.  A document then belongs to every domain by its posterior, and nonnegative document rates
are fitted so that the expected domain token totals  S_k = sum_i rate_i * tokens_i * p_ik  meet the
targets in the least-squares sense, by projected gradient.  Squares are weighted by the inverse Gram
matrix of the posteriors of all documents; on that scale a gradient step of length one never raises the
sum of squares.  Where rates are at their bound, longer steps pay off: each round tries ``STEPS`` of that
gradient and of the one scaled by the Gram matrix of the free documents, all in one aggregate over a
compact table (id, tokens, posteriors), and takes the best.  The rates are an expression of such sums.
Nothing else leaves the executors.

The classifier is fitted on about ``MAX_LABELLED`` labelled documents (all, if they are fewer), chosen by
a hash of their id, and keeps the ``VOCABULARY`` most telling features; both bounds hold at every input size.
Everything else (scores, totals, gradients) covers all documents.

Edge cases: labels that are null in the id or in either label are ignored; without any label every
posterior is uniform; a null or empty text has no tokens, its prior as posterior, and no weight in
the totals; a domain without documents of its own (``LEAST_OWN``) is left out of the fit, and every total that
misses its target is warned of; an empty table gives an empty result;
repeated rows get equal rates; repeated labels of one id count once (the least); null document ids
pass through; extra columns are ignored, or pass through in :func:`mix`.
"""

from __future__ import annotations

import math
import warnings

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import packed, stage, table

#: Labelled documents that fit the classifier, about, where there are more.
MAX_LABELLED = 20_000
#: Features the classifier keeps, the labelled documents that must have one, and the nats of evidence each needs.
VOCABULARY, LEAST_DOCS, LEAST_NATS = 400, 5, 20.0
#: Of the logistic regression.
FIT_ROUNDS, RIDGE = 60, 1e-3
#: Rounds of the rates, at most; they end when every total is this near to its target, as a share of the budget.
ROUNDS, TOLERANCE = 30, 1e-5
#: Mean posterior, over a domain's own expected tokens, below which it has no documents of its own: its mass is what the
#: classifier spreads over documents of other domains, and lifting it would only repeat those.
LEAST_OWN = 0.1
#: Lengths tried by the Gram matrix of the free documents, and by that of all.
STEPS = (1.0, 0.5, 0.2, 0.05), (1.0, 3.0, 10.0, 40.0)
#: A total further than this from its target, as a share of the budget, is warned of.
MISS = 1e-3
#: Upper end of the projection: rates are only nonnegative, so that a domain of little mass meets its target too.
MAX_RATE = math.inf
#: Target share of tokens by domain (quality, toxic).
TARGETS = {"clean": 0.95, "toxic": 0.03, "low": 0.015, "low_toxic": 0.005}
#: Target shares in the pipeline, where documents of low quality have gone already: by toxicity alone.
STAGE_TARGETS = {"clean": 0.965, "toxic": 0.035}
#: The budget makes clean documents, as they stand, this many times their tokens.
CLEAN_RATE = 1.1

#: A token of the totals: a word between ASCII white space, as the other operators count them.
_WORD = r"[^\\x20\\x09-\\x0D]+"
#: A feature: a capital before a capital, a run of letters, or a mark other than a stop and a comma.
_TOKEN = r"\\p{Lu}(?=\\p{Lu})|\\p{L}+|[^\\p{L}\\p{N}\\s.,]"


def domain_of(quality: Column, toxic: Column) -> Column:
    names = list(TARGETS)
    return F.when(quality == 1, F.when(toxic == 1, names[1]).otherwise(names[0])).otherwise(F.when(toxic == 1, names[3]).otherwise(names[2]))


def _features(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """*keep*, n_tokens (words of the whole text), and the distinct features: marks of _TOKEN, their size class, and the share of distinct ones."""
    return (
        docs.select(*keep, F.expr(f"regexp_extract_all(coalesce(`{text_col}`, ''), '{_TOKEN}', 0)").alias("_w"), F.expr(f"cast(regexp_count(coalesce(`{text_col}`, ''), '{_WORD}') AS bigint)").alias("n_tokens"))
        .select("*", F.array_distinct("_w").alias("_d"))
        .withColumn("_x", F.expr("concat(_d, array(concat('<n', int(log2(1 + size(_w))), '>'), concat('<r', int(10D * size(_d) / greatest(1, size(_w))), '>')))"))
        .drop("_w", "_d")
    )


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str, text_col: str) -> tuple[list[float], list]:
    """(log odds of each domain for a document without any feature, rows (x, w)): at most VOCABULARY rows."""
    known = stage(labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain")), "labels")
    step = max(1, -(-known.count() // MAX_LABELLED))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    known = stage(known.select(F.col("doc_id").alias("_id"), "domain"), "labelled")
    # about MAX_LABELLED rows of an id and a name
    sample = stage(_features(docs.join(F.broadcast(known), F.col(f"`{id_col}`") == F.col("_id")), [F.col("domain")], text_col), "labelled-features")
    sizes = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return [0.0] * len(domains), []
    counts = [F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]
    by = sample.select("domain", F.explode("_x").alias("x")).groupBy("x").agg(F.count("*").alias("n"), *counts).where(F.col("n") >= LEAST_DOCS)
    # mutual information of having the feature and the domain, in nats times documents
    def part(c: Column, n: Column, d: int) -> Column:
        return F.when(c > 0, c * F.log(c * total / (n * max(d, 1)))).otherwise(0.0)

    tell = sum((part(F.col(f"c{k}"), F.col("n"), sizes.get(d, 0)) + part(F.lit(sizes.get(d, 0)) - F.col(f"c{k}"), F.lit(total) - F.col("n"), sizes.get(d, 0)) for k, d in enumerate(domains)), F.lit(0.0))
    names = [r.x for r in by.select("x", tell.alias("tell")).where(F.col("tell") >= LEAST_NATS).orderBy(F.desc("tell"), "x").limit(VOCABULARY).collect()]
    seen = [d for d in domains if sizes.get(d)]
    if len(seen) < 2 or not names:
        return [math.log((sizes.get(d, 0) + 0.5) / (total + 0.5 * len(domains))) for d in domains], []
    known_names = F.array(*[F.lit(x) for x in names])
    # staged: inside the lambda below, the intersection would be worked out for each name
    rows = stage(sample.select("domain", F.array_intersect("_x", known_names).alias("_x")), "labelled-known").select(
        array_to_vector(F.transform(known_names, lambda x: F.array_contains("_x", x).cast("double"))).alias("features"),
        F.coalesce(*[F.when(F.col("domain") == d, float(k)) for k, d in enumerate(seen)]).alias("label"),
    )
    model = LogisticRegression(family="multinomial", maxIter=FIT_ROUNDS, regParam=RIDGE, standardization=False).fit(stage(rows, "labelled-vectors"))
    base, slope = model.interceptVector.toArray(), model.coefficientMatrix.toArray()
    # a domain without labels gets no share
    of = {d: k for k, d in enumerate(seen)}
    return [float(base[of[d]]) if d in of else -1e3 for d in domains], [
        (x, [float(slope[of[d], j]) if d in of else 0.0 for d in domains]) for j, x in enumerate(names)
    ]


def posteriors(docs: DataFrame, prior: list[float], vocabulary: list, keep: list[Column], text_col: str = "text") -> DataFrame:
    """*keep*, n_tokens and ``p``, the posteriors, for every row; there is no shuffle."""
    k = len(prior)
    rows = _features(docs, keep, text_col)
    if not vocabulary:
        score = F.array(*[F.lit(x) for x in prior])
    else:
        names = F.array(*[F.lit(x) for x, _ in vocabulary])
        # arrays_overlap of a set by hash: only the vocabulary's features of a document remain
        rows = rows.withColumn("_x", F.array_intersect("_x", names))
        sums = []
        weights = F.create_map(*[y for x, w in vocabulary for y in (F.lit(x), F.array(*[F.lit(v) for v in w]))])
        rows = rows.withColumn("_m", F.transform("_x", lambda x: F.element_at(weights, x)))
        for j in range(k):
            sums.append(F.expr(f"aggregate(_m, {prior[j]!r}D, (a, m) -> a + m[{j}])"))
        score = F.array(*sums)
    return (
        rows.withColumn("_s", score).withColumn("_top", F.array_max("_s"))
        .withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.col("_top"))))
        .withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, e: a + e))
        .withColumn("p", F.transform("_e", lambda e: e / F.col("_z")))
        .drop("_x", "_m", "_s", "_top", "_e", "_z")
    )


def fit_rates(scored: DataFrame, targets: list[float], budget: float | None = None, clean_rate: float = CLEAN_RATE) -> tuple[Column, list[float], list[float]]:
    """(rate expression over ``p``, reached totals, target totals) for staged *scored* (n_tokens, p)."""
    k = len(targets)

    p, t = F.col("p"), F.col("n_tokens")

    def totals(rates: list[Column]) -> list[list[float]]:
        """Totals at each of *rates*."""
        rows = scored.select("p", "n_tokens", *[r.alias(f"_r{i}") for i, r in enumerate(rates)])
        row = rows.agg(*[F.sum(F.col(f"_r{i}") * t * p[j]) for i in range(len(rates)) for j in range(k)]).first()
        return [[x or 0.0 for x in row[i * k : (i + 1) * k]] for i in range(len(rates))]

    def gram_of(rate: Column) -> list[list[float]]:
        """Gram matrix of the documents that *rate* leaves above the bound."""
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        free = F.when(F.col("_r") > 0, t)
        row = scored.select("p", "n_tokens", rate.alias("_r")).agg(*[F.sum(free * p[i] * p[j]) for i, j in cells]).first()
        gram = [[0.0] * k for _ in range(k)]
        for (i, j), x in zip(cells, row):
            gram[i][j] = gram[j][i] = x or 0.0
        return gram

    rate: Column = F.lit(1.0)
    (now,), full = totals([rate]), gram_of(rate)
    gram = full
    budget = clean_rate * now[0] / targets[0] if budget is None else budget
    want = [w * budget for w in targets]
    fitted = [x > 0 and full[j][j] >= LEAST_OWN * x for j, x in enumerate(now)]

    def miss(totals: list[float]) -> list[float]:
        return [a - b if f else 0.0 for a, b, f in zip(totals, want, fitted)]

    def squares(totals: list[float]) -> float:
        return sum(a * b for a, b in zip(miss(totals), _solve(full, miss(totals), fitted)))

    for _ in range(ROUNDS):
        if all(abs(x) <= TOLERANCE * budget for x in miss(now)):
            break
        moves = [[x * step for x in _solve(matrix, miss(now), fitted)] for matrix, steps in zip((gram, full), STEPS) for step in steps]
        tried = [F.greatest(F.lit(0.0), rate - sum((p[j] * m for j, m in enumerate(move)), F.lit(0.0))) for move in moves]
        reached = totals(tried)
        best = min(range(len(tried)), key=lambda i: squares(reached[i]))
        if squares(reached[best]) >= (1 - 1e-6) * squares(now):
            break
        rate, now = tried[best], reached[best]
        gram = gram_of(rate)
    return rate, now, want


def _solve(matrix: list[list[float]], right: list[float], fitted: list[bool]) -> list[float]:
    """The solution of a small system over the *fitted* domains; directions in which the matrix has no weight are left alone."""
    n = len(right)
    top = max((matrix[i][i] for i in range(n) if fitted[i]), default=0.0)
    rows = [[*matrix[i], right[i]] for i in range(n)]
    for i in range(n):
        rows[i][i] += 1e-9 * top
    used = [i for i in range(n) if fitted[i] and matrix[i][i] > 1e-9 * top]
    for i in used:
        for r in used:
            if r != i:
                f = rows[r][i] / rows[i][i]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[i])]
    return [rows[i][n] / rows[i][i] if i in used else 0.0 for i in range(n)]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row of *docs*: ``row__`` (its columns *keep*, all by default), n_tokens, p, rate and copies.

    *labels* has (doc_id, domain).  ``copies`` rounds the rate up or down by a hash of id and text,
    so that it is the rate on average.
    """
    targets = TARGETS if targets is None else targets
    domains = list(targets)
    prior, vocabulary = fit(docs, labels, domains, id_col, text_col)
    row = packed(docs, docs.columns if keep is None else keep)
    chance = (F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(1 << 20)) / float(1 << 20)).alias("_u")
    scored = stage(posteriors(docs, prior, vocabulary, [row, chance], text_col), "posteriors")
    rate, reached, wanted = fit_rates(scored, list(targets.values()))
    missed = {d: (a, b) for d, a, b in zip(domains, reached, wanted) if abs(a - b) > MISS * sum(wanted)}
    if missed:
        warnings.warn(f"token totals (reached, wanted) that miss their targets: {missed}", stacklevel=2)
    return scored.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + F.col("_u")).cast("int")).drop("_u")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), _labels(spark, sf_dir), keep=["doc_id"])
    return mixed.select("row__.doc_id", "n_tokens", *[F.round(F.col("p")[j], 6).alias(f"p_{d}") for j, d in enumerate(TARGETS)], F.round("rate", 6).alias("rate"), "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document appears as often as its copies say, which may be never; domains are those of STAGE_TARGETS."""
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"))
    mixed = mix(docs, labels, STAGE_TARGETS).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row__.*")
