"""The driver tables in the roles of record linkage: scores, truth, reference ids, records.

Each role is one SELECT that Spark and DuckDB both run, so that a query and its oracle start from the
same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ROLES = {
    # scored pairs: one row for each (s1_idx, src, t_idx)
    "scores": """SELECT CAST(l_orderkey AS BIGINT) AS s1_idx, CAST(2 + l_linenumber % 2 AS INT) AS src, CAST(l_partkey AS BIGINT) AS t_idx,
        greatest(CAST(0.01 AS DOUBLE), least(CAST(0.99 AS DOUBLE), max(round(l_discount * 10, 1)))) AS p
        FROM lineitem GROUP BY l_orderkey, 2 + l_linenumber % 2, l_partkey""",
    "truth": "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS s1_idx, CAST(2 + l_linenumber % 2 AS INT) AS src, CAST(l_partkey AS BIGINT) AS t_idx FROM lineitem WHERE l_returnflag = 'R'",
    "s1": "SELECT CAST(o_orderkey AS BIGINT) AS s1_idx, o_orderpriority AS country FROM orders",
    # name and address records; src 1 is the reference table
    "records": """SELECT p_partkey AS idx, CAST(1 + p_partkey % 3 AS INT) AS src, p_type AS country, p_name AS business_name,
        concat(CAST(p_size AS VARCHAR(10)), ' ', p_brand, ' street, ', p_type, ' city') AS business_address, CAST(p_size AS VARCHAR(10)) AS number, p_brand AS brand FROM part""",
    # a second scoring of the same pairs, for stacking and comparison
    "scores2": """SELECT CAST(l_orderkey AS BIGINT) AS s1_idx, CAST(2 + l_linenumber % 2 AS INT) AS src, CAST(l_partkey AS BIGINT) AS t_idx,
        greatest(CAST(0.01 AS DOUBLE), least(CAST(0.99 AS DOUBLE), max(round(l_discount * 5 + l_tax * 6, 2)))) AS p
        FROM lineitem GROUP BY l_orderkey, 2 + l_linenumber % 2, l_partkey""",
}


def named(sql: str) -> list[str]:
    """Roles that *sql* reads."""
    return [r for r in ROLES if re.search(rf"\b(?:FROM|JOIN)\s+{r}\b", sql)]


def with_roles(sql: str) -> str:
    """*sql* with the roles it reads as common table expressions in front."""
    ctes = ", ".join(f"{r} AS ({ROLES[r]})" for r in named(sql))
    if not ctes:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {head[1] or ''}{ctes}, {sql[head.end():]}" if head else f"WITH {ctes} {sql}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run *sql* over the tables below *sf_dir*; each table is bound to its data frame, not to a global view."""
    sql = with_roles(sql)
    frames = {}
    for t in TABLES:
        sql, n = re.subn(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
        if n:
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **frames)


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, ROLES[name])


def sql_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
