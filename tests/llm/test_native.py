"""Quality rules, mixing, decontamination and sharding against brute force, and their edge cases."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, quality, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(None if t is ... else first + k, None if t is ... else t, "en", "s", 1) for k, t in enumerate(texts)], DOC)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def test_quality_features(spark):
    texts = [None, "", " \n\t", "a b c a b c a", "x\nx\n\n \ny é#|", "the one line\nthe one line\nother", "w " * 60, "one two " * 5 + "İstanbul ÉÀ!!"]
    rows = quality.judge(quality.vote(quality.features(docs(spark, texts), keep=["doc_id"]))).collect()
    for r in rows:
        assert (r._f.n_words, r._f.word_chars, r._f.n_symbols, r._f.n_dup_lines, r._f.n_repeat_words) == base(texts[r.row__.doc_id])
        assert r.base_failed and not r.kept


def test_quality_keeps_clean_and_drops_junk(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.filter_documents(d).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(d, "doc_id").collect()
    clean = [r for r in labels if r.quality == 1 and len(WORD.findall(r.text)) >= 50]
    junk = [r for r in labels if r.quality == 0]
    assert sum(r.doc_id in kept for r in clean) >= 0.97 * len(clean)
    assert sum(r.doc_id in kept for r in junk) <= 0.1 * len(junk)
    assert quality.filter_documents(d.limit(0)).count() == 0


def test_clashing_columns_pass(spark):
    d = docs(spark, ["word " * 60, None, "short"])
    for c in ("_f", "_t", "_v", "_w", "r", "w", "n_words", "p", "key", "maybe", "matches", "copies", "row__", "kept", "item_id", "gone0"):
        d = d.withColumn(c, F.lit(1))
    from tessera.llm import minhash

    assert quality.filter_documents(d).columns == d.columns
    judged_ = decontam.judged(d, spark.createDataFrame([(1, "word word")], "item_id long, text string"), d.columns)
    assert judged_.where("contaminated").select("row__.*").columns == d.columns
    mixed = mixing.mix(d, spark.createDataFrame([(0, "clean")], "doc_id long, domain string"), {"clean": 0.5, "toxic": 0.5})
    assert mixed.count() == 3 and mixed.select("row__.*").columns == d.columns
    assert minhash.drop_near_duplicates(d).columns == d.columns and sharding.shard(d).count() == 3


def windows(item):
    w = ALNUM.findall((item or "").translate(LOW))
    return [tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w else []


def brute(text, items):
    w = ALNUM.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item_id, item in items:
        for g in windows(item):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(item_id)
    return len(w), len(hit), len(found), sorted(str(x) for x in found if x is not None)


def test_decontamination(spark):
    long = " ".join(f"q{k}" for k in range(30))
    items = [(1, long), (2, "short item here"), (3, None), (4, ""), (5, "the the the the the the the the the the the the the the"), (11, "short item here"), (None, "q1 q2")]
    texts = [
        None, "", "nothing of it", f"intro {long.upper()} end", " ".join(f"q{k}" for k in range(5, 19)), " ".join(f"q{k}" for k in range(12)), "a short, ITEM-here! short item here",
        "the " * 40, "Straße é short item here " + "pad " * 200, "short item here", "q1 q2 x q1 q2", "ÉCOLE école short item hereÉ",
    ]
    d = docs(spark, texts)
    d = d.unionByName(d.where("doc_id = 3")).unionByName(d.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    got = decontam.judged(d, spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"]).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        n, nh, k, named = brute(r.row__.text, items)
        assert (r.n_words, r.n_hit, r.n_items, list(r["items"])) == (n, nh, k, named), r.row__.text
        assert r.contaminated == (nh > 0 and 20 * nh >= n)


def test_joins_that_do_not_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"t{j}" for j in range(k, k + 16))) for k in range(0, 60, 4)], "item_id long, text string")
    texts = ["pad " + " ".join(f"t{j}" for j in range(k, k + 20)) + " pad" for k in range(0, 60, 7)]
    found = lambda: sorted(map(tuple, decontam.judged(docs(spark, texts), items, ["doc_id"]).collect()), key=str)
    small = found()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert found() == small and any(r[-1] for r in small)


def test_decontamination_of_empty_tables(spark):
    some, none = docs(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    assert decontam.judged(some, none, ["doc_id"]).first().n_hit == 0
    assert decontam.judged(some.limit(0), none, ["doc_id"]).count() == 0


def test_proximity(spark):
    texts = ["red x x blue", "red x x x x blue", "blue red", None, "the red the the blue the red", "the the the", "RED, Blue!", ""]
    d = docs(spark, texts)
    d = d.unionByName(d.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    items = [(1, "red blue"), (2, "the"), (None, "the red"), (4, "blue nowhere"), (5, ""), (6, None), (7, "Red red BLUE")]
    got = sorted(((r.key.id, r.item_id, r.start, r.stop) for r in decontam.proximity_matches(decontam.keyed(d), spark.createDataFrame(items, "item_id long, text string"), 4).collect()), key=str)
    want = []
    for r in d.collect():
        w = ALNUM.findall((r.text or "").translate(LOW))
        for item_id, text in items:
            terms = set(ALNUM.findall((text or "").translate(LOW)))
            for i in range(len(w)):
                at = [k for k in range(i, min(i + 4, len(w))) if w[k] in terms]
                if w[i] in terms and {w[k] for k in at} == terms:
                    want.append((r.doc_id, item_id, i, at[-1]))
    assert got == sorted(want, key=str) and len(want) > 10


def plan(sizes, n):
    """Smallest capacity for a contiguous walk over sizes in descending order."""
    sizes = sorted(sizes, reverse=True)
    cap = max([*sizes, -(-sum(sizes) // n)])
    while True:
        k, load = 1, 0
        for s in sizes:
            k, load = (k + 1, s) if load + s > cap else (k, load + s)
        if k <= n:
            return cap
        cap += 1


@pytest.mark.parametrize("n", [1, 3, 40])
def test_sharding(spark, n):
    texts = [None, "", "aa", "aa", "aa", "é", "long " * 30, *[f"t{k}" * (k % 7 + 1) for k in range(60)], "aa", ...]
    rows = sharding.shard(docs(spark, texts), n).collect()
    assert len(rows) == len(texts)
    by_text, groups, shards = {}, {}, {}
    values = {k: ("" if t in (None, ...) else t) for k, t in enumerate(texts)}
    for r in rows:
        t = values[r.doc_id] if r.doc_id is not None else ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
        assert by_text.setdefault(t, r.shard) == r.shard and 0 <= r.shard < n
        groups[t] = groups.get(t, 0) + r.size
        shards.setdefault(r.shard, []).append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    cap = plan(list(groups.values()), n)
    assert max(sum(r.size for r in own) for own in shards.values()) <= cap == rows[0].capacity
    assert sharding.shard(docs(spark, []), n).count() == 0


def balanced(sizes, n, cap):
    """Loads of the shards, cut as the operator's docstring says, one group after another."""
    sizes = sorted(sizes, reverse=True)
    at = [0]
    for s in sizes:
        at.append(at[-1] + s)
    m, back = len(sizes), [len(sizes)]
    for _ in range(n):
        back.append(next(r for r in range(m + 1) if at[r] >= at[back[-1]] - cap))
    cuts = [0]
    for j in range(n - 1):
        r = cuts[-1]
        fair = at[r] + (at[-1] - at[r]) // (n - j)
        q = max(k for k in range(m + 1) if at[k] <= fair)
        q += q < m and 2 * fair > at[q] + at[q + 1]
        most = min(max(k for k in range(m + 1) if at[k] <= at[r] + cap), max(r + 1, m - (n - 1 - j)))
        cuts.append(max(back[n - 1 - j], min(r + 1, m), min(most, q)))
    return [at[b] - at[a] for a, b in zip(cuts, [*cuts[1:], m])]


def test_a_large_group_leaves_no_shard_empty(spark):
    texts = [f"text {k:06d}" for k in range(2000)] + ["copy 000000"] * 100
    rows = sharding.shard(docs(spark, texts), 40).collect()
    loads = [0] * 40
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads) == rows[0].capacity == 2700 and loads == balanced([27] * 2000 + [2700], 40, 2700)
    assert min(loads) > 0.9 * sum(loads[1:]) / 39 and max(loads[1:]) < 1.1 * sum(loads[1:]) / 39


@pytest.mark.parametrize("n", [2, 5, 7])
def test_balanced_cuts(spark, n):
    import random

    r = random.Random(n)
    texts = [f"{k} " + "x" * r.choice([0, 3, 3, 40, 200, 900]) for k in range(30)] + ["same"] * r.choice([1, 60])
    rows = sharding.shard(docs(spark, texts), n).collect()
    groups, loads = {}, [0] * n
    for x in rows:
        groups[x.text_crc32] = groups.get(x.text_crc32, 0) + x.size
        loads[x.shard] += x.size
    cap = plan(list(groups.values()), n)
    assert loads == balanced(list(groups.values()), n, cap) and max(loads) <= cap


def labelled(spark):
    texts = [f"fine prose number {k} with words" if k % 3 else f"idiot clown {k} with words" for k in range(120)] + [None, ""]
    d = docs(spark, texts)
    lab = spark.createDataFrame([(k, "clean" if k % 3 else "toxic") for k in range(120)] + [(None, "clean"), (5, None)], "doc_id long, domain string")
    return d, lab


def test_mixing_meets_targets(spark):
    d, lab = labelled(spark)
    targets = {"clean": 0.8, "toxic": 0.2}
    rows = mixing.mix(d, lab, targets).collect()
    assert len(rows) == 122 and all(0 <= r.rate <= mixing.MAX_RATE and r.copies >= 0 for r in rows)
    for r in rows:
        assert sum(r.p) == pytest.approx(1)
        if r.row__.doc_id < 120:
            assert max(range(2), key=lambda k: r.p[k]) == (0 if r.row__.doc_id % 3 else 1)
    total = [sum(r.rate * r.n_tokens * r.p[k] for r in rows) for k in range(2)]
    assert total[0] / sum(total) == pytest.approx(0.8, abs=1e-3)
    # at the optimum the least-squares gradient vanishes for documents between the bounds
    want = [0.8 * sum(total), 0.2 * sum(total)]
    assert total == pytest.approx(want, rel=1e-3)


def test_mixing_counts_words(spark):
    texts = ["plain words here", "ALL CAPS, AND: 3.14 (or 2,5)!", "12 345\t6,789\n0", "$$$ ### !!!", " \x0b\f\r\n ", "", None, "a\u00a0b \u3000 é"]
    rows = mixing.mix(docs(spark, texts), labelled(spark)[1], {"clean": 0.8, "toxic": 0.2}).collect()
    assert {r.row__.doc_id: r.n_tokens for r in rows} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}


def test_mixing_lifts_rare_domains(spark, recwarn):
    texts = [f"idiot clown {k} with words" if k % 40 == 0 else f"fine prose number {k} with words" for k in range(400)]
    lab = spark.createDataFrame([(k, "toxic" if k % 40 == 0 else "clean") for k in range(400)], "doc_id long, domain string")
    rows = mixing.mix(docs(spark, texts), lab, {"clean": 0.6, "toxic": 0.4}).collect()
    total = [sum(r.rate * r.n_tokens * r.p[k] for r in rows) for k in range(2)]
    assert total[1] / sum(total) == pytest.approx(0.4, abs=1e-3) and max(r.rate for r in rows) > 4
    assert not [w for w in recwarn if "miss their targets" in str(w.message)]


def test_mixing_warns_of_missed_targets(spark):
    d, lab = labelled(spark)
    with pytest.warns(UserWarning, match="miss their targets.*'none'"):
        mixing.mix(d, lab, {"clean": 0.6, "toxic": 0.2, "none": 0.2})


def least_squares(t, p, want, rounds=1000):
    """Totals of the nonnegative rates of least weighted squares, one rate after another (coordinate descent)."""
    import numpy as np

    a = (t[:, None] * p).T
    weight = np.linalg.inv(a @ p)
    r, s = np.ones(len(t)), a.sum(1)
    for _ in range(rounds):
        for j in np.flatnonzero(t):
            g, h = a[:, j] @ weight @ (s - want), a[:, j] @ weight @ a[:, j]
            new = max(0.0, r[j] - g / h)
            s, r[j] = s + a[:, j] * (new - r[j]), new
    return s


@pytest.mark.parametrize("targets", [[0.6, 0.3, 0.1], [0.05, 0.05, 0.9], [0.98, 0.0, 0.02], [0.2, 0.8, 0.0]])
def test_rates_are_the_least_squares(spark, targets):
    """Totals against an independent solution, with rates at their bound and targets out of reach."""
    import numpy as np

    r = np.random.default_rng(3)
    p = r.dirichlet([0.5, 0.4, 0.3], 40) * 0.7 + 0.1
    p /= p.sum(1, keepdims=True)
    t = r.integers(0, 300, 40)
    scored = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens long, p array<double>")
    budget = 1.3 * float(t.sum())
    rate, reached, want = mixing.fit_rates(scored, targets, budget)
    rates = np.array([x.r for x in scored.select(rate.alias("r")).collect()])
    assert rates.min() >= 0 and ((t * rates)[:, None] * p).sum(0) == pytest.approx(reached)
    best = least_squares(t.astype(float), p, np.array(want))
    weight = np.linalg.inv((t[:, None] * p).T @ p)
    cost = lambda s: (s - np.array(want)) @ weight @ (s - np.array(want))
    start = cost((t[:, None] * p).sum(0))
    assert cost(np.array(reached)) <= cost(best) + 2e-3 * start
    assert reached == pytest.approx(best, abs=0.02 * budget)


def test_domains_without_documents_are_not_lifted(spark):
    """Mass that the classifier spreads thinly over documents of other domains is no reason to repeat them."""
    scored = spark.createDataFrame([(100, [0.98 - 0.0001 * k, 0.02 + 0.0001 * k]) for k in range(100)], "n_tokens long, p array<double>")
    rate, reached, want = mixing.fit_rates(scored, [0.7, 0.3])
    rates = [x.r for x in scored.select(rate.alias("r")).collect()]
    assert max(rates) < 1.5 and min(rates) > 0.8 and reached[0] == pytest.approx(want[0], rel=1e-3)


def test_repeated_labels(spark):
    d, lab = labelled(spark)
    once = mixing.mix(d, lab, {"clean": 0.8, "toxic": 0.2}).collect()
    twice = mixing.mix(d, lab.unionByName(lab).unionByName(lab.where("doc_id = 0").withColumn("domain", F.lit("zz"))), {"clean": 0.8, "toxic": 0.2}).collect()
    assert {r.row__.doc_id: round(r.rate, 6) for r in once} == {r.row__.doc_id: round(r.rate, 6) for r in twice}


def test_mixing_without_labels_or_rows(spark):
    d, lab = labelled(spark)
    rows = mixing.mix(d, lab.limit(0), {"clean": 0.5, "toxic": 0.5}).collect()
    assert all(r.p == pytest.approx([0.5, 0.5]) for r in rows)
    assert mixing.mix(d.limit(0), lab, {"clean": 0.5, "toxic": 0.5}).count() == 0


def test_native_plans_have_no_python(spark, sf):
    for f in (quality.op1_quality_rules, decontam.op8_decontamination, mixing.op7_mixing, sharding.op10_sharding):
        plan_ = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan_)


def test_digest_of_items(spark, sf):
    r = decontam.op8_decontamination(spark, sf).where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest()
