"""Readers and writers: unquoted TSV, Parquet with tolerated drift, stage tables, submissions, JSON dictionaries."""

from __future__ import annotations

import tempfile
import uuid
import io
import json
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
#: Result files up to this size are zipped on the driver.
ZIP_BYTES = 1 << 30


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder: below the shared one if the session names it, a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}/tessera-files"
    return f"{base}/{name}-{uuid.uuid4().hex[:8]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """*df*, written and read again: what follows reads rows and does not compute them anew."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated text with a header, no quoting and no inference: every column is a string."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", inferSchema=False, schema=schema, mode="PERMISSIVE")


def write_tsv(df: DataFrame, path: str, files: int = 1) -> None:
    """Unquoted tab-separated text with a header; empty strings stay empty."""
    df.coalesce(files).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(source1_entity_id, tid): one row for each matched id; a record without matches has none."""
    return explode_ids(read_tsv(spark, path), "matched_entity_ids").select("source1_entity_id", F.col("id").alias("tid"))


def explode_ids(df: DataFrame, column: str) -> DataFrame:
    ids = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn("id", F.explode(ids)).drop(column)


def with_index(df: DataFrame, key: str) -> DataFrame:
    """Add idx 0.. in an order fixed by *key* (hash bucket, then key): bucket offsets plus ranks inside each bucket."""
    bucketed = df.withColumn("_b", F.expr(f"conv(substr(md5(cast({key} AS string)), 1, 2), 16, 10)").cast("int"))
    counts = bucketed.groupBy("_b").agg(F.count("*").alias("_n"))
    offset = counts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_off"))  # at most 256 rows
    rank = F.row_number().over(W.partitionBy("_b").orderBy(key))
    return bucketed.join(F.broadcast(offset), "_b").withColumn("idx", F.col("_off") + rank - 1).drop("_b", "_off")


def load(spark: SparkSession, root: str, split: str, src: int | None = None, country: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Stage table of a split, with partition filters and column pruning pushed into the scan."""
    df = spark.read.parquet(f"{root}/{split}")
    if src is not None:
        df = df.where(F.col("src") == src)
    if country is not None:
        df = df.where(F.col("country") == country)
    return df.select(*columns) if columns else df


def save_stage(df: DataFrame, root: str, name: str) -> None:
    """Stage table partitioned by country and source; only the partitions written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country", "src").parquet(f"{root}/{name}")
    # dynamic overwrite commits partitions by themselves and leaves no marker of its own
    fs, marker = _hadoop(df.sparkSession, f"{root}/{name}/_SUCCESS")
    fs.create(marker, True).close()


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether a stage table was committed."""
    fs, marker = _hadoop(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def scan_drifted(spark: SparkSession, paths: Iterable[str], schema: T.StructType) -> DataFrame:
    """Parquet parts whose columns drift: missing ones are null, others are ignored."""
    return spark.read.schema(schema).parquet(*paths)


def available(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """Those of *wanted* that the table has; only the schema is read."""
    have = set(spark.read.parquet(path).columns)
    return [c for c in wanted if c in have]


def save_dictionary(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, ensure_ascii=False, sort_keys=True)


def load_dictionary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_submission(spark: SparkSession, path: str, column: str = "matched_entity_ids") -> DataFrame:
    """A submission as (source1_entity_id, id) from a TSV file, a folder of them, or a zip of one TSV.

    A zip is unpacked on the driver, so one beyond ZIP_BYTES, packed or unpacked, is refused; its TSV can be read unpacked.
    """
    head = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 2).alias("m"), "path").limit(2).collect()
    if len(head) == 1 and bytes(head[0].m) == b"PK":
        _bounded(head[0].length, path)
        content = spark.read.format("binaryFile").load(path).select("content").first().content
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next(n for n in z.namelist() if n.endswith((".tsv", ".csv", ".txt")))
            _bounded(z.getinfo(name).file_size, path)
            lines = z.read(name).decode("utf-8", "replace").splitlines()
        header = lines[0].split("\t")
        rows = [tuple((x.split("\t") + [""] * len(header))[: len(header)]) for x in lines[1:] if x]
        df = spark.createDataFrame(rows, T.StructType([T.StructField(h, T.StringType()) for h in header]))
    else:
        df = read_tsv(spark, path)
    return explode_ids(df, column).select("source1_entity_id", "id")


def _bounded(size: int, path: str) -> None:
    if size > ZIP_BYTES:
        raise ValueError(f"{path}: {size} bytes, over the {ZIP_BYTES} that the driver unpacks")


def zip_file(source: str, target: str) -> None:
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(source, source.rsplit("/", 1)[-1])


def text_pairs(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with both texts, 'name | address', for a text-pair scorer."""
    def text(df: DataFrame, out: str, *keys: str) -> DataFrame:
        return df.select(*keys, F.concat_ws(" | ", F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))).alias(out))

    a = text(s1.withColumnRenamed("idx", "s1_idx"), "a", "s1_idx")
    b = text(targets.withColumnRenamed("idx", "t_idx"), "b", "src", "t_idx")
    return pairs.join(a, "s1_idx").join(b, ["src", "t_idx"])


def mini_dataset(s1: DataFrame, truth: DataFrame, targets: DataFrame, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(records, targets): *n* records of each country, all their true targets, and 3n other targets of each country and source."""
    def first(df: DataFrame, most: int, *by: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), "idx"), "idx")
        return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")

    own = first(s1, n, "country")
    true = truth.join(own.select(F.col("idx").alias("s1_idx")), "s1_idx", "left_semi").select("src", F.col("t_idx").alias("idx")).distinct()
    hit = targets.join(true, ["src", "idx"], "left_semi")
    return own, hit.unionByName(first(targets.join(true, ["src", "idx"], "left_anti"), 3 * n, "country", "src"))
