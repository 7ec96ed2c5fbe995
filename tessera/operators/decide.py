"""Decision layer: from scored pairs to one match set for each reference record.

Scores have columns s1_idx, src, t_idx, p.  All selections are window queries over two partitionings,
by reference record and by target; ties are broken by (src, t_idx) and (s1_idx), so results do not
depend on row order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.metric import f05

BETA2 = 0.25
PAIR = ["s1_idx", "src", "t_idx"]


@dataclass(frozen=True)
class Params:
    """margin: lead a target's best record needs; floor: least p; m0: expected matches missing from the
    candidates; empty_bias: factor on the value of the empty set; coh: weight of competing odds."""

    margin: float = 0.0
    floor: float = 0.0
    m0: float = 0.0
    empty_bias: float = 1.0
    exclusive: bool = True
    coh: float = 0.0


def coherent(scores: DataFrame, coh: float | Column) -> DataFrame:
    """One owner for each target: p' = o / (1 + o + coh * (sum of o over the target - o))."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    odds = scores.withColumn("_o", p / (1 - p))
    total = F.sum("_o").over(W.partitionBy("src", "t_idx"))
    c = F.lit(coh) if not isinstance(coh, Column) else coh
    return odds.withColumn("p", F.col("_o") / (1 + F.col("_o") + c * (total - F.col("_o")))).drop("_o")


def exclusivity(scores: DataFrame, margin: float | Column = 0.0, exclusive: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Add ``ok``: the pair is its target's best and leads the runner-up by *margin* (a sole pair leads by p)."""
    keys = keys or []
    if not exclusive:
        return scores.withColumn("ok", F.lit(True))
    best = W.partitionBy(*keys, "src", "t_idx").orderBy(F.desc("p"), "s1_idx")
    whole = best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lead = F.col("p") - F.coalesce(F.nth_value("p", 2).over(whole), F.lit(0.0))
    m = F.lit(margin) if not isinstance(margin, Column) else margin
    return scores.withColumn("ok", (F.row_number().over(best) == 1) & (F.round(lead, 9) >= m))


def _expected(q: DataFrame, m0: Column, empty: Column, keys: list[str]) -> DataFrame:
    """Add k, ef (of the first k pairs by q), ef0 and best k to rows with ok, q and p."""
    by = [*keys, "s1_idx"]
    order = W.partitionBy(*by).orderBy(F.desc("q"), "src", "t_idx")
    every = W.partitionBy(*by)
    k = F.row_number().over(order).cast("double")
    gain = F.sum("q").over(order.rowsBetween(W.unboundedPreceding, 0))
    ef = F.round((1 + BETA2) * gain / (BETA2 * (F.sum("p").over(every) + m0) + k), 9)
    rows = q.withColumn("k", k).withColumn("ef", ef).withColumn("ef0", F.round(empty, 9))
    rows = rows.withColumn("_top", F.max("ef").over(every))
    return rows.withColumn("best_k", F.min(F.when(F.col("ef") == F.col("_top"), F.col("k"))).over(every))


def _none(keys: list[str]) -> Column:
    """Chance that a record has no match; 0 if one is certain."""
    every = W.partitionBy(*keys, "s1_idx")
    return F.when(F.max("p").over(every) >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(-F.col("p"))).over(every)))


def select_with(scores: DataFrame, margin: Column, floor: Column, m0: Column, empty_bias: Column, keys: list[str] | None = None, empty: Column | None = None, exclusive: bool = True) -> DataFrame:
    """Pairs chosen by expected F0.5; parameters are columns, so a grid is one query over *keys*."""
    keys = keys or []
    rows = exclusivity(scores, margin, exclusive, keys).withColumn("q", F.when(F.col("ok"), F.col("p")).otherwise(0.0))
    none = _none(keys) if empty is None else F.coalesce(empty, _none(keys))
    rows = _expected(rows, m0, none * empty_bias, keys)
    return rows.where((F.col("k") <= F.col("best_k")) & (F.col("_top") > F.col("ef0")) & F.col("ok") & (F.col("p") >= floor))


def select(scores: DataFrame, prm: Params = Params()) -> DataFrame:
    """s1_idx, src, t_idx, p of the chosen pairs."""
    rows = coherent(scores.select(*PAIR, "p"), prm.coh) if prm.coh else scores.select(*PAIR, "p")
    return select_with(rows, F.lit(prm.margin), F.lit(prm.floor), F.lit(prm.m0), F.lit(prm.empty_bias), exclusive=prm.exclusive).select(*PAIR, "p")


def select_q(scores: DataFrame, empties: DataFrame, prm: Params = Params()) -> DataFrame:
    """Like :func:`select`, with the chance of an empty set from *empties* (s1_idx, q0) where it has one."""
    rows = scores.select(*PAIR, "p").join(empties.select("s1_idx", "q0"), "s1_idx", "left")
    return select_with(rows, F.lit(prm.margin), F.lit(prm.floor), F.lit(prm.m0), F.lit(prm.empty_bias), empty=F.col("q0"), exclusive=prm.exclusive).select(*PAIR, "p")


def threshold_select(scores: DataFrame, threshold: float) -> DataFrame:
    """Baseline: p at least *threshold*, and each target goes to its best record."""
    best = W.partitionBy("src", "t_idx").orderBy(F.desc("p"), "s1_idx")
    return scores.where(F.col("p") >= threshold).withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*PAIR, "p")


def prefix_distribution(p: Column) -> Column:
    """Array of the chances of 0, 1, .. successes among independent trials with chances in array *p*."""
    def step(d: Column, x: Column) -> Column:
        stay = F.transform(d, lambda v: v * (1 - x))
        move = F.transform(d, lambda v: v * x)
        return F.zip_with(F.concat(stay, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), move), lambda a, b: a + b)

    return F.aggregate(p, F.array(F.lit(1.0)), step)


def expected_f_exact(p: str, m0: float = 0.0) -> Column:
    """Array over k = 0..n of the exact expected F0.5 of keeping the first k of array column *p*.

    The hits inside the prefix and the matches outside it are independent Poisson-binomial counts.
    """
    inside = "aggregate(slice({p}, 1, k), array(1D), (d, x) -> zip_with(concat(transform(d, v -> v * (1D - x)), array(0D)), concat(array(0D), transform(d, v -> v * x)), (a, b) -> a + b))"
    outside = inside.replace("slice({p}, 1, k)", "slice({p}, k + 1, size({p}))")
    value = f"""aggregate(transform({inside}, (pa, a) -> aggregate(transform({outside}, (pb, b) ->
        pa * pb * {1 + BETA2}D * a / (k + {BETA2}D * (a + b + {m0}D))), 0D, (s, v) -> s + v)), 0D, (s, v) -> s + v)"""
    none = f"aggregate({{p}}, 1D, (s, x) -> s * (1D - x)) * exp(-{m0}D)"
    return F.expr(f"transform(sequence(0, size({{p}})), k -> if(k = 0, {none}, {value}))".replace("{p}", p))


def select_exact(scores: DataFrame, prm: Params = Params(), max_n: int = 40) -> DataFrame:
    """Selection by the exact expected F0.5: usable pairs first, at most *max_n* of a record are weighed."""
    rows = coherent(scores.select(*PAIR, "p"), prm.coh) if prm.coh else scores.select(*PAIR, "p")
    rows = exclusivity(rows, prm.margin, prm.exclusive)
    order = W.partitionBy("s1_idx").orderBy(F.desc("ok"), F.desc("p"), "src", "t_idx")
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_n)
    sets = rows.groupBy("s1_idx").agg(
        F.expr("transform(array_sort(collect_list(struct(k, p))), x -> x.p)").alias("ps"), F.count_if("ok").alias("n_ok")
    )
    curve = sets.withColumn("ef", expected_f_exact("ps", prm.m0)).withColumn(
        "ef", F.expr(f"transform(slice(ef, 1, cast(n_ok AS int) + 1), (x, i) -> round(if(i = 0, x * {prm.empty_bias}D, x), 9))")
    )
    best = curve.select("s1_idx", (F.array_position("ef", F.array_max("ef")) - 1).alias("best_k"))
    return rows.join(best, "s1_idx").where((F.col("k") <= F.col("best_k")) & F.col("ok") & (F.col("p") >= prm.floor)).select(*PAIR, "p")


#: Points of a grid, at most: they travel in the plan as literals.
MAX_POINTS = 10_000


def _points(points: DataFrame) -> list[dict]:
    """The points as rows of the driver: a parameter list that somebody wrote, of at most MAX_POINTS."""
    rows = [{"coh": 0.0, **r.asDict()} for r in points.limit(MAX_POINTS + 1).collect()]
    if len(rows) > MAX_POINTS:
        raise ValueError(f"a grid has at most {MAX_POINTS} points")
    return rows


def _record_sets(scores: DataFrame, points: list[dict]) -> DataFrame:
    """One row a record: for each weight of competing odds in *points*, its pairs in order of preference, the sum and the chance of none.

    One window over the targets serves all weights: p' rises with p among the pairs of a target, so the best
    and the runner-up are the same at each, and what p' is follows from three numbers (odds, the runner-up's
    odds, the target's total).
    """
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    rows = scores.select(*PAIR, "p").withColumn("_o", p / (1 - p))
    best = W.partitionBy("src", "t_idx").orderBy(F.desc("p"), "s1_idx")
    whole = best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({
        "_first": F.row_number().over(best) == 1, "_p2": F.nth_value("p", 2).over(whole), "_o2": F.nth_value("_o", 2).over(whole), "_total": F.sum("_o").over(whole),
    })
    aggs = []
    for n, c in enumerate(sorted({pt["coh"] for pt in points})):
        def at(odds: str, plain: str, c: float = c) -> Column:
            return F.col(odds) / (1 + F.col(odds) + F.lit(c) * (F.col("_total") - F.col(odds))) if c else F.col(plain)

        mine = at("_o", "p")
        lead = F.when(F.col("_first"), F.round(mine - F.coalesce(at("_o2", "_p2"), F.lit(0.0)), 9))
        pair = F.struct((-mine).alias("np"), "src", "t_idx", mine.alias("p"), lead.alias("lead"))
        none = F.when(F.max(mine) >= 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.log1p(-mine))))
        aggs += [F.array_sort(F.collect_list(pair)).alias(f"ps{n}"), F.sum(mine).alias(f"sum{n}"), none.alias(f"none{n}")]
    return rows.groupBy("s1_idx").agg(*aggs)


def _fold(pairs: Column, total: Column, none: Column, pt: dict, hit=None) -> Column:
    """(value, -k, kept, hits) of the best prefix of *pairs* at point *pt*: k is 0 where the empty set is no worse."""
    zero = F.lit(0)
    empty = F.struct(F.round(none * F.lit(float(pt["empty_bias"])), 9).alias("value"), zero.alias("k"), zero.alias("kept"), zero.alias("hits"))
    start = F.struct(F.lit(0.0).alias("gain"), zero.alias("k"), zero.alias("kept"), zero.alias("hits"), empty.alias("best"))
    share = BETA2 * (total + F.lit(float(pt["m0"])))

    def step(s: Column, x: Column) -> Column:
        keep = x["p"] >= F.lit(float(pt["floor"]))
        gain, k, kept = s["gain"] + x["p"], s["k"] + 1, s["kept"] + F.when(keep, 1).otherwise(0)
        hits = s["hits"] + (F.when(keep & hit(x), 1).otherwise(0) if hit else zero)
        value = F.round((1 + BETA2) * gain / (share + k), 9)
        best = F.greatest(s["best"], F.struct(value.alias("value"), (-k).alias("k"), kept.alias("kept"), hits.alias("hits")))
        return F.struct(gain.alias("gain"), k.alias("k"), kept.alias("kept"), hits.alias("hits"), best.alias("best"))

    return F.aggregate(_usable(pairs, pt), start, step, lambda s: s["best"])


def _usable(pairs: Column, pt: dict) -> Column:
    return F.filter(pairs, lambda x: x["lead"] >= F.lit(float(pt["margin"])))


def grid(scores: DataFrame, points: DataFrame) -> DataFrame:
    """point, pair and p of the choices at every point; *points* has point, margin, floor, m0, empty_bias and maybe coh.

    Points are weighed inside the row of a record, whose pairs are a few dozen; neither shuffle nor sort grows with the grid.
    """
    pts = _points(points)
    if not pts:
        return scores.select(F.lit(0).alias("point"), *PAIR, "p").where("false")
    sets = _record_sets(scores, pts)
    which = sorted({pt["coh"] for pt in pts})

    def chosen(pt: dict) -> Column:
        n = which.index(pt["coh"])
        k = -_fold(F.col(f"ps{n}"), F.col(f"sum{n}"), F.col(f"none{n}"), pt)["k"]
        kept = F.filter(F.slice(_usable(F.col(f"ps{n}"), pt), F.lit(1), k), lambda x: x["p"] >= F.lit(float(pt["floor"])))
        return F.transform(kept, lambda x: F.struct(F.lit(pt["point"]).alias("point"), x["src"].alias("src"), x["t_idx"].alias("t_idx"), x["p"].alias("p")))

    return sets.select("s1_idx", F.explode(F.concat(*map(chosen, pts))).alias("c")).select("c.point", "s1_idx", "c.src", "c.t_idx", "c.p")


def tune(scores: DataFrame, truth: DataFrame, ids: DataFrame, points: DataFrame, by: str | None = None) -> DataFrame:
    """(by, point, n, f05): macro F0.5 over the records of *ids* at every point of a grid, by column *by* of *ids* if given.

    Scores and truth meet in the row of a record; each task sends one partial sum for each point and group.
    Records without scores count with the empty set; scores of records that *ids* does not have are left out.
    """
    pts = _points(points)
    which = sorted({pt["coh"] for pt in pts})
    wanted = truth.select(*PAIR).distinct().groupBy("s1_idx").agg(F.collect_list(F.struct("src", "t_idx")).alias("_true"))
    keep = ["s1_idx"] + ([by] if by else [])
    rows = ids.select(*keep).join(_record_sets(scores, pts), "s1_idx", "left").join(wanted, "s1_idx", "left")
    n_true = F.coalesce(F.size("_true"), F.lit(0))

    def hit(x: Column) -> Column:
        return F.coalesce(F.array_contains("_true", F.struct(x["src"].alias("src"), x["t_idx"].alias("t_idx"))), F.lit(False))

    values = []
    for pt in pts:
        n = which.index(pt["coh"])
        pairs = F.coalesce(F.col(f"ps{n}"), F.array().cast("array<struct<np:double,src:int,t_idx:bigint,p:double,lead:double>>"))
        values.append(_fold(pairs, F.col(f"sum{n}"), F.col(f"none{n}"), pt, hit))
    rows = rows.select(*keep[1:], n_true.alias("n_true"), F.posexplode(F.array(*values)).alias("_i", "_b"))
    scored = rows.select(*keep[1:], "_i", "n_true", F.col("_b.kept").alias("n_pred"), F.col("_b.hits").alias("tp"))
    sums = scored.groupBy(*keep[1:], "_i").agg(F.count("*").alias("n"), F.avg(f05()).alias("f05"))
    point = F.element_at(F.array(*[F.lit(pt["point"]) for pt in pts]), F.col("_i") + 1)
    return sums.select(*keep[1:], point.alias("point"), "n", "f05")


def best_points(tuned: DataFrame, by: str | None = None) -> DataFrame:
    """The best point of each group of :func:`tune`'s result, the smaller of equals."""
    best = F.min_by(F.struct(*tuned.columns), F.struct(-F.col("f05"), F.col("point"))).alias("b")
    return tuned.groupBy(*([by] if by else [])).agg(best).select("b.*")


def select_by_country(scores: DataFrame, countries: DataFrame, points: DataFrame) -> DataFrame:
    """Selection with the parameters of each record's country; *points* has country and the parameters."""
    rows = scores.select(*PAIR, "p").join(countries.select("s1_idx", "country"), "s1_idx").join(F.broadcast(points), "country")
    return select_with(rows, F.col("margin"), F.col("floor"), F.col("m0"), F.col("empty_bias")).select(*PAIR, "p")


def half_of(column: Column | str) -> Column:
    """Multiplicative hash split of integer ids: 1 or 0."""
    c = F.col(column) if isinstance(column, str) else column
    return ((c * 2654435761) % 1000 < 500).cast("int")
