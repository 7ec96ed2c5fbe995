"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit integers give all signature coordinates: sigma scatters the shingle
hashes once, and coordinate k is the least value of pi over the scattered hashes shifted by k around
the circle.  Rows of equal shingle sets are one class; only class representatives are banded.

Links are found in steps, each confirmed on full shingle sets:

1. In every bucket, each member against the bucket's smallest member.  Connected components of the
   confirmed links settle nearly all buckets.
2. In buckets that still hold more than one component, members against members of other components,
   in blocks of about ``BLOCK`` by ``BLOCK``.  A pair is looked at in the first bucket that its ends
   share, if its signatures allow the threshold; full sets are sent only of members that have such a
   pair.  A block yields a spanning forest of its links, so its output is smaller than its input.

So no bucket is ever expanded into rows of pairs, none is capped, and only the chance of banding
(``(1 - t ** ROWS) ** BANDS``, 1.5e-5 at the threshold itself) separates the result from all links.

Edge cases: a null, empty or blank text has no shingles and is linked with nothing; a text of fewer
words than the shingle width, but not none, has its whole word sequence as one shingle; an empty
table gives an empty result; ``doc_id`` names a document, so repeated rows of one share its class, and
rows of one id with several texts are one node with the links of all of them;
a row with a null id is never linked and kept; extra columns are ignored, or pass through in
:func:`drop_near_duplicates`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import by_key, small_batches, text_slices
from tessera.llm.components import components
from tessera.llm.hashing import mix, shingles, words
from tessera.llm.store import stage, table

BANDS, ROWS = 28, 5
COORDS = BANDS * ROWS
#: Signatures that agree in less than threshold minus this need no exact check (4.4 standard errors).
SLACK = 0.15
#: Members of a bucket are compared in blocks of so many by so many.
BLOCK = 512
#: Links of one document that are verified together.
CHUNK = 256
#: Pairs up to this many (under 100 bytes each) are broadcast to find their texts, more are joined by shuffle.
BROADCAST_IDS = 400_000

U32 = np.uint32


def _sigma(x: np.ndarray) -> np.ndarray:
    """From 64-bit shingle hashes to points of the 32-bit circle."""
    return (mix(x) >> np.uint64(32)).astype(U32)


def _pi(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit integers."""
    np.right_shift(x, U32(16), out=out)
    out ^= x
    out *= U32(0x7FEB352D)
    out ^= out >> U32(15)
    out *= U32(0x846CA68B)
    return out


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, COORDS) coordinates; *first* marks where each document's non-empty set begins."""
    out = np.empty((len(first) - 1, COORDS), U32)
    step = 1 << 15
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + step, "right")) - 1)
        x = _sigma(sets[first[i] : first[j]])
        at = first[i:j] - first[i]
        y = np.empty_like(x)
        for k in range(COORDS):
            out[i:j, k] = np.minimum.reduceat(_pi(x - U32(k), y), at)
        i = j
    return out


def _profiles(width: int):
    """Arrow function: id, text -> id, set size, set fingerprint, band keys, sketch."""
    seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, off in text_slices(batch, "text"):
                sets, first = shingles(*words(data, off), width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                keys: list = [None] * (b - a)
                sketch: list = [None] * (b - a)
                if len(full):
                    starts = first[:-1][full]
                    f1[full] = np.add.reduceat(sets, starts).view(np.int64)
                    f2[full] = np.add.reduceat(mix(sets ^ np.uint64(0x51ED270B35A1C3D7)), starts).view(np.int64)
                    sig = signatures(sets, np.append(starts, len(sets)))
                    acc = np.tile(seeds, (len(full), 1))
                    for r in range(ROWS):
                        acc = mix(acc ^ sig[:, r::ROWS].astype(np.uint64))
                    small = (sig & U32(255)).astype(np.uint8)
                    for at, k in enumerate(full.tolist()):
                        keys[k] = acc[at].view(np.int64)
                        sketch[k] = small[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n), pa.array(f1), pa.array(f2), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["doc", "n_shingles", "f1", "f2", "bands", "sketch"],
                )

    return run


def profiles(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        _profiles(width), "doc long, n_shingles long, f1 long, f2 long, bands array<bigint>, sketch binary"
    )


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def _verify(width: int, threshold: int):
    """Arrow function over rows (g, role, doc, set), sorted: the centre of each g against its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["u", "chunk"]):
            docs = group.column("doc").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            centres = sum(r == 0 for r in group.column("role").to_pylist())  # role 0 sorts first; more than one for an id of several texts
            u, v = [], []
            for d, s in zip(docs[centres:], sets[centres:]):
                for c in sets[:centres]:
                    both = _overlap(c, s)
                    if 100 * both >= threshold * (len(c) + len(s) - both):
                        u.append(docs[0])
                        v.append(d)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(batch.schema.get_field_index("roles"))
            ids = batch.column(0).to_pylist()
            for a, b, data, off in text_slices(batch, "text"):
                sets, first = shingles(*words(data, off), width)
                blobs = [sets[first[i] : first[i + 1]].tobytes() for i in range(b - a)]
                part = roles.slice(a, b - a).to_pylist()
                rows = [(r["u"], r["chunk"], r["role"], ids[a + i], blobs[i]) for i in range(b - a) for r in part[i]]
                for at in range(0, len(rows), 512):
                    cols = list(zip(*rows[at : at + 512]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                        names=["u", "chunk", "role", "doc", "set"],
                    )

    return run


def confirm(texts: DataFrame, pairs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Those of *pairs* (u, v) whose full shingle sets reach *threshold* percent.

    *texts* has one row (doc, text) for each document.  A document's set is sent once for each
    ``CHUNK`` of its partners.
    """
    cut = pairs.withColumn("chunk", F.expr("pmod(xxhash64(v), greatest(1L, 1L + n div %d))" % CHUNK))
    wanted = (
        cut.select("u", "chunk", F.lit(0).alias("role"), F.col("u").alias("doc"))
        .unionByName(cut.select("u", "chunk", F.lit(1).alias("role"), F.col("v").alias("doc")))
        .groupBy("doc").agg(F.collect_set(F.struct("u", "chunk", "role")).alias("roles"))
    )
    few = pairs.count() <= BROADCAST_IDS
    found = texts.join(F.broadcast(wanted) if few else wanted, "doc").select("doc", "text", "roles")
    sets = found.mapInArrow(_sets(width), "u long, chunk long, role int, doc long, set binary")
    return (
        sets.repartition("u", "chunk").sortWithinPartitions("u", "chunk", "role", "doc")
        .mapInArrow(_verify(width, threshold), "u long, v long")
    )


def _agreeing(least: int):
    """Arrow function: rows with two sketches -> those that agree in *least* coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array((one == two).sum(1) >= least))

    return run


_BLOCK_ROW = "key long, i long, j long, doc long, was long, block long, sketch binary, bands array<bigint>"


def _open_pairs(group: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the pairs that this block has to decide."""
    was, block = group.column("was").to_numpy(), group.column("block").to_numpy()
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    sk = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
    band = int(np.flatnonzero(bands[0] == key)[0])
    for at in range(0, len(x), 32):
        xs = x[at : at + 32]
        ask = was[xs][:, None] != was[y][None, :]
        if i == j:
            ask &= xs[:, None] < y[None, :]
        for r in range(band):
            ask &= bands[xs, r][:, None] != bands[y, r][None, :]
        p, q = np.nonzero(ask)
        for k in range(0, len(p), 1 << 16):
            a, b = xs[p[k : k + (1 << 16)]], y[q[k : k + (1 << 16)]]
            near = (sk[a] == sk[b]).sum(1) >= least
            yield a[near], b[near]


def _undecided(least: int):
    """Arrow function over block rows: those members that have a pair to decide in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key", "i", "j"]):
            need = np.zeros(group.num_rows, bool)
            for a, b in _open_pairs(group, least):
                need[a] = need[b] = True
            if need.any():
                yield from group.filter(pa.array(need)).combine_chunks().to_batches()

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of the incidence matrix."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(every)))
    column = np.repeat(np.where(count > 1, np.cumsum(count > 1) - 1, -1), count)
    owner, column = owner[column >= 0], column[column >= 0]
    out = np.zeros((n, n), np.float32)
    wide = max(64, (1 << 22) // n)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + wide, wide))
    for k in range(len(edges) - 1):
        m = np.zeros((n, wide), np.float32)
        part = slice(edges[k], edges[k + 1])
        m[owner[part], column[part] - k * wide] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _forest(least: int, threshold: int):
    """Arrow function over block rows with sets: a spanning forest of the links that hold in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["key", "i", "j"]):
            sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            size, doc = np.array([len(x) for x in sets]), group.column("doc").to_pylist()
            both = None  # all intersections at once pay off only where many pairs are open
            up = list(range(len(doc)))

            def top(k: int) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            u, v = [], []
            for a, b in _open_pairs(group, least):
                if both is None and len(a) > 4 * len(doc):
                    both = _overlaps(sets)
                o = both[a, b] if both is not None else np.array([_overlap(sets[x], sets[y]) for x, y in zip(a.tolist(), b.tolist())], np.int64)
                yes = 100 * o >= threshold * (size[a] + size[b] - o)
                for x, y in zip(a[yes].tolist(), b[yes].tolist()):
                    p, q = top(x), top(y)
                    if p != q:
                        up[p] = q
                        u.append(doc[x])
                        v.append(doc[y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _send_sets(width: int):
    """Arrow function: (doc, text, was, sketch, bands, roles) -> a block row with the set for each role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table_ = pa.Table.from_batches([batch])
            for a, b, data, off in text_slices(batch, "text"):
                sets, first = shingles(*words(data, off), width)
                blobs = [sets[first[k] : first[k + 1]].tobytes() for k in range(b - a)]
                part = table_.slice(a, b - a)
                roles = part.column("roles").to_pylist()
                at = np.repeat(np.arange(b - a), [len(r) for r in roles])
                flat = [r for x in roles for r in x]
                for k in range(0, len(flat), 256):
                    own, some = at[k : k + 256], flat[k : k + 256]
                    rest = part.select(["doc", "was", "sketch", "bands"]).take(pa.array(own)).combine_chunks()
                    yield from pa.table({
                        **{c: pa.array([r[c] for r in some], pa.int64()) for c in ("key", "i", "j")}, "doc": rest.column("doc"), "was": rest.column("was"),
                        "block": pa.array([r["block"] for r in some], pa.int64()), "sketch": rest.column("sketch"), "bands": rest.column("bands"),
                        "set": pa.array([blobs[x] for x in own.tolist()], pa.binary()),
                    }).combine_chunks().to_batches()

    return run


def _settle(texts: DataFrame, members: DataFrame, reps: DataFrame, labels: DataFrame, width: int, threshold: int, least: int) -> DataFrame | None:
    """Links between components that buckets of *members* still hold; None if there is nothing to decide."""
    labelled = stage(_relabel(members, labels, "was"), "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("was").alias("x"), F.max("was").alias("y")).where("x <> y").select("key")
    blocks = (
        labelled.join(open_keys, "key", "left_semi")
        .select("key", "doc", "was", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("g"))
        .withColumn("block", F.expr("pmod(xxhash64(doc), g)"))
        .join(reps, "doc").where(F.array_contains("bands", F.col("key"))).withColumn("o", F.explode(F.expr("sequence(0L, g - 1L)")))
        .select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "doc", "was", "block", "sketch", "bands")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )
    rows = stage(blocks.mapInArrow(_undecided(least), _BLOCK_ROW), "undecided")
    # an id of several texts has a row for each of its signatures, and meets each of its texts below
    wanted = rows.groupBy("doc", "bands").agg(
        F.first("was").alias("was"), F.first("sketch").alias("sketch"), F.collect_set(F.struct("key", "i", "j", "block")).alias("roles")
    )
    if rows.isEmpty():
        return None
    found = texts.join(wanted, "doc").select("doc", "text", "was", "sketch", "bands", "roles")
    return (
        found.mapInArrow(_send_sets(width), _BLOCK_ROW + ", set binary")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInArrow(_forest(least, threshold), "u long, v long").distinct()
    )


def _relabel(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("doc"), F.col("component").alias("_c")), "doc", "left").select(
        *rows.columns, F.coalesce("_c", "doc").alias(name)
    )


def _counted(pairs: DataFrame) -> DataFrame:
    """Staged pairs (u, v) with n, the number of partners of u."""
    pairs = stage(pairs, "pairs")
    return pairs.join(pairs.groupBy("u").agg(F.count("*").alias("n")), "u")


def _same_id(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between an id that has several sets and the representatives of their classes."""
    by = ["n_shingles", "f1", "f2"]
    several = some.groupBy("doc").agg(F.min(F.struct(*by)).alias("a"), F.max(F.struct(*by)).alias("b")).where("a <> b").select("doc")
    return some.select("doc", *by).join(several, "doc").join(classes, by).where("doc <> rep").select(F.col("doc").alias("u"), F.col("rep").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: links of at least *threshold* percent Jaccard."""
    least = int(COORDS * (threshold / 100 - SLACK))
    rows = stage(profiles(docs, width, id_col, text_col), "profiles")
    some = rows.where("n_shingles > 0 AND doc IS NOT NULL")
    # classes of equal sets; the least id stands for the class
    classes = stage(some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("n")), "classes")
    reps = stage(
        some.join(classes, ["n_shingles", "f1", "f2"]).where("doc = rep").select("doc", "bands", "sketch").dropDuplicates(["doc", "bands"]), "reps"
    )
    banded = reps.select("doc", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("m")).where("m > 1")
    members = stage(banded.join(buckets, "key"), "members")

    def texts() -> DataFrame:
        return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")

    # step 1: every member against the least of its bucket
    star = members.where("doc <> least").select(F.col("least").alias("u"), F.col("doc").alias("v")).distinct()
    sketches = reps.select("doc", "sketch")
    star = (
        star.join(sketches.withColumnRenamed("doc", "u").withColumnRenamed("sketch", "su"), "u")
        .join(sketches.withColumnRenamed("doc", "v").withColumnRenamed("sketch", "sv"), "v")
        .select("u", "v", "su", "sv").mapInArrow(_agreeing(least), "u long, v long")
    )
    links = confirm(texts(), _counted(star), width, threshold)
    labels = components(links.unionByName(_same_id(some, classes)))
    # step 2: buckets that still hold several components
    more = _settle(texts(), members, reps, labels, width, threshold, least)
    if more is not None:
        # earlier components are stars already
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    merged = stage(
        classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component_id")),
        "merged",
    )
    return (
        rows.select("doc", "n_shingles", "f1", "f2").join(merged, ["n_shingles", "f1", "f2"], "left")
        .select("doc", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))
        .select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=80)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of *docs* that stand for their group, with their own columns."""
    gone = near_duplicates(docs, **options).where("NOT kept").select("doc_id").distinct()
    id_col = options.get("id_col", "doc_id")
    name = next(n for n in map("gone{}".format, itertools.count()) if n not in docs.columns)
    return docs.join(gone.withColumnRenamed("doc_id", name), F.col(f"`{id_col}`") == F.col(name), "left_anti")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays."""
    return drop_near_duplicates(docs)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(node, far) AS (SELECT doc_id, doc_id FROM w UNION SELECT node, y FROM reach JOIN edge ON x = far),
comp AS (SELECT node, min(far) AS c FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w JOIN comp ON node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
