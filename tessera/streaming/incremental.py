"""Incremental linkage: new targets against a static key index, micro-batch by micro-batch.

The reference side's keys and the target side's key frequencies are tables; each micro-batch of new
targets is keyed, weighted with the frequencies known so far, joined and appended.  A batch that is
delivered twice overwrites its own partition, so the output has each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocking


def candidates(batch: DataFrame, s1_keys: DataFrame, frequencies: DataFrame, families: tuple[str, ...] = blocking.FAMILIES, **caps: int) -> DataFrame:
    """Scored pairs of new targets *batch* (country, src, idx, ..); *frequencies* has country, src, fam, key, df, n_t."""
    own = blocking.keys(batch, families, extra=("src",))
    fresh = own.groupBy("country", "src", "fam", "key").agg(F.count("*").alias("new"))
    known = fresh.join(frequencies, ["country", "src", "fam", "key"], "left").withColumn("df", F.col("new") + F.coalesce("df", F.lit(0)))
    n = frequencies.groupBy("country", "src").agg(F.max("n_t").alias("n")).join(batch.groupBy("country", "src").agg(F.count("*").alias("m")), ["country", "src"], "right")
    weights = known.where(F.col("df") <= blocking.cap_of(F.col("fam"), **caps)).join(F.broadcast(n), ["country", "src"])
    weights = weights.select("country", "src", "fam", "key", "df", (F.log(F.coalesce("n", F.lit(0)) + F.col("m") + 1.0) - F.log(F.col("df").cast("double"))).alias("w"), (1.0 / F.col("df")).alias("inv_df"))
    return blocking.score_pairs(s1_keys, own.join(weights, ["country", "src", "fam", "key"]))


def link_stream(stream: DataFrame, s1_keys: DataFrame, frequencies: DataFrame, out: str, checkpoint: str, budgets: dict[str, int] = blocking.BUDGETS, **caps: int) -> StreamingQuery:
    """Start a query that writes the candidates of each micro-batch of *stream* to ``out/batch=<n>``."""

    def run(batch: DataFrame, number: int) -> None:
        pairs = blocking.keep_budgets(candidates(batch, s1_keys, frequencies, **caps), budgets)
        pairs.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
