"""Minimax contiguous partition of atomic groups into a fixed number of shards (native).

Rows with equal texts form one atomic group.  Groups are ordered by (bytes descending, digest) and
cut into contiguous shards.  The capacity is the smallest one for which a greedy walk needs at most
``n_shards`` shards; it is found by binary search.  Of the partitions with that capacity, the cuts are made
for balance: each shard takes its share of the bytes that remain, as near as whole groups allow, but
never more than the capacity, and never so little that the rest would not fit the shards that are left
(greedy walks from the end say how far back each may begin).  So one large group, which sets the
capacity by itself, leaves no shard empty.

No walk looks at single groups: in that order equal sizes are adjacent, so the whole order is
described by one (size, count) run for each distinct size, with the groups and bytes before it.  The
run list has one entry for each distinct group size, at most the square root of twice the total bytes,
and the search is SQL over it.  Ranks and slots are taken in two levels (bucket offset plus rank in the
bucket), so no window holds a whole shard.

Edge cases: a null text counts as the empty text; an empty table gives an empty result; repeated
rows are separate rows of one group; a null ``doc_id`` is sharded like any other row; extra columns
are ignored.  Shards stay empty only where there are fewer groups than shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.store import stage, table

N_SHARDS = 40
OVERHEAD = 16
#: Rank buckets of a shard; raise it with the rows of a shard.
SLOT_BUCKETS = 251

#: shards needed for capacity {cap}: a walk over runs e of (s size, c count)
_WALK = """aggregate(e, struct(1L AS k, 0L AS ld), (a, r) ->
  if(r.c <= ({cap} - a.ld) div r.s,
     struct(a.k AS k, a.ld + r.c * r.s AS ld),
     struct(a.k + (r.c - ({cap} - a.ld) div r.s + {cap} div r.s - 1L) div ({cap} div r.s) AS k,
            ((r.c - ({cap} - a.ld) div r.s - 1L) % ({cap} div r.s) + 1L) * r.s AS ld)))"""

def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _last(condition: str, value: str) -> str:
    """*value* of the last run r that meets *condition*; 0 if none does."""
    return f"aggregate(filter(e, r -> {condition}), 0L, (z, r) -> {value})"


def _bytes_at(rank: str) -> str:
    """Bytes of the groups before *rank*."""
    return _last(f"r.g <= {rank}", f"r.b + least(r.c, {rank} - r.g) * r.s")


def _rank_to(byte: str) -> str:
    """The last rank with at most *byte* bytes before it."""
    return _last(f"r.b <= {byte}", f"r.g + least(r.c, ({byte} - r.b) div r.s)")


def _rank_from(byte: str) -> str:
    """The first rank with at least *byte* bytes before it."""
    return _last(f"r.b < {byte}", f"r.g + least(r.c, ({byte} - r.b + r.s - 1L) div r.s)")


def _back(n: int) -> str:
    """Array: how far back the last k shards may begin, for k from 0; greedy walks from the end."""
    step = _let("p", "element_at(a, -1)", _let("t", f"{_bytes_at('p')} - cap", _rank_from("t")))
    return f"aggregate(sequence(1, {n}), array(m), (a, k) -> concat(a, array({step})))"


def _cuts(n: int) -> str:
    """Array: ranks at which shards 1.. start, each as near to its share of what remains as ``back`` and ``cap`` allow."""
    lower = f"greatest(get(back, {n - 1} - j), least(a.r + 1L, m))"
    upper = f"least({_rank_to('u')}, greatest(a.r + 1L, m - ({n - 1}L - j)))"
    near = f"if(q < m AND 2L * t > {_bytes_at('q')} + {_bytes_at('(q + 1L)')}, q + 1L, q)"
    cut = _let("t", f"a.b + (tot - a.b) div ({n}L - j)", _let("q", _rank_to("t"), _let("u", "a.b + cap", f"greatest({lower}, least({upper}, {near}))")))
    return f"""aggregate(sequence(0, {n - 2}), struct(0L AS r, 0L AS b, cast(array() AS array<bigint>) AS cuts),
      (a, j) -> {_let("c", cut, f"struct(c AS r, {_bytes_at('c')} AS b, concat(a.cuts, array(c)) AS cuts)")}).cuts"""


def size_runs(groups: DataFrame) -> DataFrame:
    """(s, c, g, b) for each distinct size of *groups* (g_bytes), largest first: groups of it, and groups and bytes before them."""
    by = W.orderBy(F.desc("s"))
    runs = groups.groupBy(F.col("g_bytes").alias("s")).agg(F.count("*").alias("c"))
    return runs.select("s", "c", (F.sum("c").over(by) - F.col("c")).alias("g"), (F.sum(F.col("s") * F.col("c")).over(by) - F.col("s") * F.col("c")).alias("b"))


def shard_plan(runs: DataFrame, n_shards: int) -> DataFrame:
    """One row (cap, cuts): the smallest feasible capacity, and the ranks at which shards 1.. start; none without groups."""
    used = _WALK.format(cap="((z.lo + z.hi) div 2)")
    search = f"""aggregate(sequence(1, 63),
      struct(greatest(e[0].s, (tot + {n_shards}L - 1L) div {n_shards}L) AS lo, tot AS hi),
      (z, i) -> if(z.lo >= z.hi, z,
        if(({used}).k <= {n_shards}L, struct(z.lo AS lo, (z.lo + z.hi) div 2 AS hi),
           struct((z.lo + z.hi) div 2 + 1L AS lo, z.hi AS hi)))).hi"""
    return (
        runs.agg(F.sort_array(F.collect_list(F.struct("g", "s", "c", "b"))).alias("e")).where(F.size("e") > 0)
        .withColumns({"tot": F.expr("element_at(e, -1).b + element_at(e, -1).s * element_at(e, -1).c"), "m": F.expr("element_at(e, -1).g + element_at(e, -1).c")})
        .withColumn("cap", F.expr(search))
        .withColumn("back", F.expr(_back(n_shards)))
        .select("cap", (F.expr(_cuts(n_shards)) if n_shards > 1 else F.array().cast("array<bigint>")).alias("cuts"))
    )


def shard(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, group_bytes, capacity`` for every row of *docs*."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("gid"),
        ),
        "shard-rows",
    )
    groups = stage(base.groupBy("gid").agg(F.sum("size").alias("g_bytes")), "shard-groups")
    runs = stage(size_runs(groups), "shard-runs")
    plan = shard_plan(runs, n_shards).first()  # one row of at most n_shards numbers
    cap, cuts = (plan.cap, plan.cuts) if plan else (0, [])
    # rank of a group = groups of larger sizes + groups of its size in lower digest buckets + rank in its bucket
    ahead = runs.select(F.col("s").alias("g_bytes"), F.col("g").alias("ahead"))
    bucket = F.substring("gid", 1, 2)
    by_bucket = groups.groupBy("g_bytes", bucket.alias("gb")).agg(F.count("*").alias("n"))
    in_size = by_bucket.select(
        "g_bytes", "gb", (F.sum("n").over(W.partitionBy("g_bytes").orderBy("gb")) - F.col("n")).alias("within")
    ).join(ahead, "g_bytes")
    ranked = (
        groups.withColumn("gb", bucket)
        .withColumn("r", F.row_number().over(W.partitionBy("g_bytes", "gb").orderBy("gid")))
        .join(in_size, ["g_bytes", "gb"])
        .select("gid", "g_bytes", (F.col("ahead") + F.col("within") + F.col("r") - 1).alias("rk"))
    )
    placed = ranked.select(
        "gid", "g_bytes", F.lit(cap).cast("long").alias("cap"),
        sum((F.when(F.col("rk") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("shard"),
    )
    rows = stage(
        base.join(placed, "gid").select(
            "doc_id", "size", "text_crc32", "shard", "gid", "g_bytes", "cap",
            F.coalesce(F.expr(f"pmod(doc_id, {SLOT_BUCKETS}L)"), F.lit(-1)).alias("sb"),
        ),
        "shard-placed",
    )
    counts = rows.groupBy("shard", "sb").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "shard", "sb", (F.sum("n").over(W.partitionBy("shard").orderBy("sb")) - F.col("n")).alias("off")
    )
    # at most n_shards * (SLOT_BUCKETS + 1) rows
    return rows.join(F.broadcast(offsets), ["shard", "sb"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int"),
        (F.col("off") + F.row_number().over(W.partitionBy("shard", "sb").orderBy("doc_id", "gid")) - 1).cast("long").alias("slot"),
        F.col("g_bytes").alias("group_bytes"), F.col("cap").alias("capacity"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row's shard and slot."""
    return op10_columns(shard(docs))


def op10_columns(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "group_bytes", "capacity")


ORACLE = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {OVERHEAD} AS size, sha256(coalesce(text, '')) AS gid FROM documents
), groups AS (SELECT gid, sum(size)::BIGINT AS gb FROM base GROUP BY gid),
ordered AS (SELECT gid, gb, row_number() OVER (ORDER BY gb DESC, gid) AS rk, sum(gb) OVER (ORDER BY gb DESC, gid ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM groups),
cl AS (SELECT list(gb ORDER BY rk) AS l, max(gb) AS mx, sum(gb)::BIGINT AS tot FROM ordered),
walk(lo, hi) AS (
  SELECT greatest(mx, (tot + {N_SHARDS} - 1) // {N_SHARDS}), tot FROM cl
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT lo, hi, mid, list_reduce(list_prepend({{'k': 1::BIGINT, 'ld': 0::BIGINT}}, list_transform(l, lambda x: {{'k': 0::BIGINT, 'ld': x}})),
          lambda a, b: CASE WHEN a.ld + b.ld > mid THEN {{'k': a.k + 1, 'ld': b.ld}} ELSE {{'k': a.k, 'ld': a.ld + b.ld}} END).k <= {N_SHARDS} AS ok
        FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, l FROM walk, cl WHERE lo < hi))
), cap AS (SELECT min(hi) AS c FROM walk),
pre AS (SELECT 0::BIGINT AS r, 0::BIGINT AS b UNION ALL SELECT rk, upto FROM ordered),
back(k, r) AS (
  SELECT 0, max(r) FROM pre
  UNION ALL
  SELECT k + 1, (SELECT min(p.r) FROM pre p WHERE p.b >= (SELECT o.b FROM pre o WHERE o.r = back.r) - (SELECT c FROM cap)) FROM back WHERE k < {N_SHARDS}
), cuts(j, r, b) AS (
  SELECT 0, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT j + 1, cut, (SELECT p.b FROM pre p WHERE p.r = cut) FROM (
    SELECT j, greatest(low, least(r + 1, m), least(most, greatest(r + 1, m - ({N_SHARDS - 1} - j)), CASE WHEN q < m AND 2 * t > bq + bn THEN q + 1 ELSE q END)) AS cut
    FROM (SELECT *, (SELECT p.b FROM pre p WHERE p.r = q) AS bq, (SELECT p.b FROM pre p WHERE p.r = q + 1) AS bn
      FROM (SELECT *, (SELECT max(p.r) FROM pre p WHERE p.b <= t) AS q, (SELECT max(p.r) FROM pre p WHERE p.b <= x.b + x.c) AS most, (SELECT y.r FROM back y WHERE y.k = {N_SHARDS - 1} - x.j) AS low
        FROM (SELECT j, r, b, b + (tot - b) // ({N_SHARDS} - j) AS t, (SELECT max(r) FROM pre) AS m, (SELECT c FROM cap) AS c FROM cuts, cl WHERE j < {N_SHARDS - 1}) x)))
), placed AS (SELECT gid, (SELECT count(*) FROM cuts WHERE j > 0 AND r < o.rk) AS shard FROM ordered o),
tab AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda z: 0::UBIGINT)),
   lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
crc AS (SELECT gid, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::BIGINT, 2))::UBIGINT)),
   lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM (SELECT gid, any_value(t) AS t, hex(encode(any_value(t))) AS h FROM base GROUP BY gid), tab)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY coalesce((doc_id % {SLOT_BUCKETS} + {SLOT_BUCKETS}) % {SLOT_BUCKETS}, -1), doc_id, gid) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM base JOIN placed USING (gid) JOIN crc USING (gid)
"""
