"""Shared staging area: intermediate tables that every executor can read again.

Tables are written below ``spark.checkpoint.dir`` (the folder the cluster shares).  That cuts
lineage and survives lost executors: a lost task is simply run again from the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where the session names no shared folder, which is allowed on a local master alone.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
    return f"file://{LOCAL_FALLBACK}"


#: Paths made in the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The paths made inside; those that are still listed at the end are deleted.  Nothing lazy may read them any more."""
    _scopes.append(made := [])
    try:
        yield made
    finally:
        _scopes.pop()
        for path in made:
            forget(spark, path)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write *df* to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a staged path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, keep: list[str]) -> Column:
    """The columns *keep* of *df* as one struct ``row__``, so that their names meet none of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row__")
