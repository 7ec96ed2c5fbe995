"""Pairs of records by classes of alike records: what depends on the class is computed once for two classes, then every pair gets its row.

The rows are those of the join of all records of a place; only the work on them is done by class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Ids of one row; a larger class is several rows, so that no row grows with it.
CHUNK = 4096


def classes(records: DataFrame, place: list[str], kind: list[str], ids: str, idx: str = "idx") -> DataFrame:
    """(place, kind, ids): records equal in all columns, their ids ascending, at most CHUNK of them in a row."""
    every = records.groupBy(*place, *kind).agg(F.sort_array(F.collect_list(idx)).alias("_ids"))
    starts = F.sequence(F.lit(1), F.size("_ids"), F.lit(CHUNK))
    return every.select(*place, *kind, F.explode(F.transform(starts, lambda k: F.slice("_ids", k, F.lit(CHUNK)))).alias(ids))


def class_pairs(left: DataFrame, right: DataFrame, place: list[str], parts: int, by: list[str]) -> DataFrame:
    """Classes *left* (ids xs) and *right* (ids ys) of the same place that have a pair of ascending ids, dealt to *parts* tasks.

    Rows equal in *by* go to eight tasks at most, which lets a task remember what it has computed for them.
    """
    met = left.join(right.hint("shuffle_hash"), place).where(F.get("xs", F.lit(0)) < F.element_at("ys", -1))
    return met.repartition(parts, *by, F.pmod(F.xxhash64(*place), F.lit(8)))


def expand(pairs: DataFrame, *keep: str | Column) -> DataFrame:
    """(keep, ia, ib): every pair of ascending ids of the two classes; two nested loops of generated code."""
    one = pairs.select(*keep, "ys", F.explode("xs").alias("ia"))
    names = [c for c in one.columns if c != "ys"]
    return one.select(*names, F.explode("ys").alias("ib")).where("ia < ib")


@F.pandas_udf(LongType())
def count_pairs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Pairs of ascending ids of two ascending lists, without listing them."""
    for xs, ys in batches:
        yield pd.Series([int(np.searchsorted(x, y).sum()) for x, y in zip(xs, ys)], dtype="int64")
