"""Embeddings, exact: nearest neighbours (a bounded set of queries is sent to every block of targets), and all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are multiplied with a batch of targets at a time, and sent to an executor at a time.
QUERY_BLOCK, QUERY_BOUND = 1024, 100_000
#: Vectors of a block, and those that a task takes at a time, when all pairs of a group are listed.
PAIR_BLOCK, PAIR_TASK = 1024, 8192


def top_k(queries: DataFrame, targets: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(q_id, t_id, cos, rank): the *k* most similar targets of each query, by cosine.

    Queries are dealt into blocks; each block meets each target batch in one matrix product, keeps its k
    best there, and one window keeps the k best of all.  Targets are never shuffled as vectors.
    """
    q = queries.select(F.col(id_col).cast("long").alias("q_id"), F.col(vec_col).alias("v")).collect() if queries.count() <= QUERY_BOUND else None
    if q is None:
        raise ValueError(f"more than {QUERY_BOUND} queries: call for a part of them at a time")
    ids = np.array([r.q_id for r in q], np.int64)
    matrix = np.array([r.v for r in q], np.float64).reshape(len(q), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    sent = targets.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, m = sent.value
        for batch in batches:
            if not len(batch) or not len(own):
                continue
            t = np.stack(batch["v"].to_numpy()).astype(np.float64)
            t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
            t_ids = batch["t_id"].to_numpy()
            for at in range(0, len(own), QUERY_BLOCK):
                sim = m[at : at + QUERY_BLOCK] @ t.T
                few = min(k, sim.shape[1])
                pick = np.argpartition(-sim, few - 1, axis=1)[:, :few]
                yield pd.DataFrame({"q_id": np.repeat(own[at : at + QUERY_BLOCK], few), "t_id": t_ids[pick].ravel(), "cos": np.take_along_axis(sim, pick, 1).ravel()})

    near = targets.select(F.col(id_col).cast("long").alias("t_id"), F.col(vec_col).alias("v")).mapInPandas(best, "q_id long, t_id long, cos double")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc(F.round("cos", 9)), "t_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _units(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lengths): rows of length one; a vector that is null, has a null or no length is zero, with length -1 but for the last."""
    rows = [None if v is None or None in v else v for v in vectors.to_pylist()] if vectors.null_count or vectors.flatten().null_count else None
    if rows is None:
        size = np.diff(vectors.offsets.to_numpy())
        if len(size) and (size == size[0]).all():
            m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0), size
        rows = vectors.to_pylist()
    size = np.array([-1 if v is None else len(v) for v in rows], np.int64)
    m = np.zeros((len(rows), max(0, *size, 0)))
    for k, v in enumerate(rows):
        if v:
            m[k, : len(v)] = v
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm != 0), size


def group_pairs(vectors: DataFrame, group: str, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 5) -> DataFrame:
    """(q_id, t_id, cos): all pairs of ascending ids of one group, cosines rounded half away from zero; 0 where a side has no direction.

    A group is dealt by hash into blocks of about PAIR_BLOCK vectors, and two blocks meet in one matrix product.
    """
    rows = vectors.where(F.col(group).isNotNull() & F.col(id_col).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
    blocks = rows.groupBy("g").agg(F.ceil(F.count("*") / PAIR_BLOCK).alias("n"), F.count("*").alias("size"))
    met = blocks.agg(F.sum(F.col("size") * (F.col("n") + 1))).first()[0] or 0
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // PAIR_TASK))
    dealt = rows.join(blocks, "g").groupBy("g", F.pmod(F.xxhash64("i"), F.col("n")).alias("k")).agg(F.collect_list(F.struct("i", F.coalesce("v", F.array(F.lit(None).cast("double"))).alias("v"))).alias("x"))
    one, two = (dealt.select("g", F.col("k").alias(f"k{s}"), F.col("x.i").alias(f"i{s}"), F.col("x.v").alias(f"v{s}")) for s in (1, 2))
    both = one.join(two, "g").where("k1 <= k2").repartition(int(parts), "g", "k1", "k2")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in ("k1", "k2", "i1", "i2", "v1", "v2")}
                a, b = (at[c].values.to_numpy(zero_copy_only=False) for c in ("i1", "i2"))
                (m, p), (n, q) = _units(at["v1"].values), _units(at["v2"].values)
                wide = max(m.shape[1], n.shape[1])
                m, n = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (m, n))
                same = at["k1"].as_py() == at["k2"].as_py()
                for start in range(0, len(a), 128):  # a slice of the block, as far as the output is held
                    own = slice(start, start + 128)
                    cos = m[own] @ n.T
                    cos[(p[own, None] != q) | (p[own, None] < 0)] = 0.0
                    kept = a[own, None] < b if same else a[own, None] != b
                    x, y = np.broadcast_to(a[own, None], kept.shape)[kept], np.broadcast_to(b, kept.shape)[kept]
                    c = cos[kept]
                    c = np.copysign(np.floor(np.abs(c) * 10**digits + 0.5) / 10**digits, c) + 0.0
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(c)], names=["q_id", "t_id", "cos"])

    return both.mapInArrow(product, "q_id long, t_id long, cos double")


def new_pairs(neighbours: DataFrame, known: DataFrame) -> DataFrame:
    """Neighbours that are no candidates yet; *known* has q_id and t_id."""
    return neighbours.join(known.select("q_id", "t_id"), ["q_id", "t_id"], "left_anti")


def cut(neighbours: DataFrame, truth: DataFrame, keep: float = 0.95) -> DataFrame:
    """Neighbours above the cosine that keeps a share *keep* of the true new pairs."""
    true = neighbours.join(truth.select("q_id", "t_id"), ["q_id", "t_id"], "left_semi")
    tau = true.agg(F.percentile("cos", 1 - keep).alias("tau"))
    return neighbours.join(F.broadcast(tau), F.round("cos", 9) >= F.round("tau", 9)).drop("tau")  # one row
