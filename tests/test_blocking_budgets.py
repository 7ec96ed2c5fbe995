"""The blocking queries keep the union of all five budgets, on a table where lists of candidates are longer than these."""

import random

import duckdb
from pyspark.sql import functions as F

from tessera.operators import blocking
from tessera.plans import linkage
from tessera.plans.roles import with_roles

GROUPS = {"bs": blocking.FAMILIES, "bs_name": blocking.NAME, "bs_pure": blocking.PURE, "bs_addr": blocking.ADDRESS, "bs_num": blocking.NUMBER}
COLUMNS = ["country", "s1_idx", "src", "t_idx", "bs", "bs_addr", "arcs", "nkeys", "nk_addr"]


def five_ranks() -> str:
    """The SQL of b08_block_sql_families with a rank for each budget, and in_<score>: inside that score's budget."""
    sums = ", ".join(f"sum(CASE WHEN fam IN {g} THEN w ELSE 0 END) AS {c}" for c, g in GROUPS.items())
    ranks = ", ".join(f"row_number() OVER (PARTITION BY country, s1_idx, src ORDER BY round({c}, 6) DESC, t_idx) AS r_{c}" for c in GROUPS)
    inside = {f"in_{c}": f"(r_{c} <= {k}" + ("" if c == "bs" else f" AND {c} > 0") + ")" for c, k in linkage.BUDGETS.items()}
    return with_roles(f"""WITH {linkage._SCORED}, sc AS (SELECT country, s1_idx, src, t_idx, {sums}, sum(inv) AS arcs, count(*) AS nkeys, count(CASE WHEN fam LIKE 'a%' THEN 1 END) AS nk_addr FROM sp GROUP BY ALL),
      rk AS (SELECT *, {ranks} FROM sc)
      SELECT country, s1_idx, src, t_idx, round(bs, 6) AS bs, round(bs_addr, 6) AS bs_addr, round(arcs, 6) AS arcs, nkeys, nk_addr, {', '.join(f'{x} AS {c}' for c, x in inside.items())} FROM rk WHERE {' OR '.join(inside.values())}""")


def test_query_keeps_all_five_budgets(spark, tmp_path):
    draw = random.Random(1)
    rows = [(k, f"{draw.choice(['red', 'blue', 'green', 'pink', 'grey'])} {draw.choice(['bolt', 'nut', 'gear', 'valve'])}", f"Brand#{draw.randint(1, 3)}", "SMALL", draw.randint(10, 13), 1.0) for k in range(900)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(five_ranks()).df()
    # the name and the pure-name budget add pairs that no other budget has
    beyond = want[~want.in_bs & ~want.in_bs_addr & ~want.in_bs_num]
    assert (beyond.in_bs_name & ~beyond.in_bs_pure).any() and beyond.in_bs_pure.any()
    got = linkage.QUERIES["b08_block_sql_families"](spark, str(tmp_path)).select(*COLUMNS).toPandas()
    key = ["s1_idx", "src", "t_idx"]
    got, want = got.sort_values(key), want[COLUMNS].sort_values(key)
    assert [tuple(r) for r in got.itertuples(index=False)] == [tuple(r) for r in want.itertuples(index=False)]


def test_each_budget_keeps_its_best(spark):
    """Of 60 candidates the total takes the first 50; each of the last ten has one other score that no other candidate has."""
    others = list(blocking.BUDGETS)[1:]
    rows = [("US", 1, 2, t, 100.0 - t, *[float(t >= 50 and t % 5 == k) for k in range(4)]) for t in range(60)]
    pairs = spark.createDataFrame(rows, "country string, s1_idx long, src int, t_idx long, " + ", ".join(f"{c} double" for c in ("bs", *others)))
    kept = {r.t_idx for r in blocking.keep_budgets(pairs).select(F.col("t_idx")).collect()}
    assert kept == {t for t in range(60) if t < 50 or t % 5 < 4}
