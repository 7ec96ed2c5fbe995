"""Repeated passages by the common-prefix interval tree of an enhanced suffix array.

The suffixes of a corpus do not fit one machine, so they are dealt out by content first.  Every
window of ``MIN_BYTES`` bytes has one anchor, the ``GRAM``-byte string in it of least hash; equal
windows have equal anchors at the same place, so all occurrences of a window meet where its anchor
is sent:

1. Each document's anchors are sent by hash, 20 bytes each; those that occur once are dropped.
2. Documents are joined with their repeated anchors, and send the windows around these.
3. Each part builds an enhanced suffix array over the suffixes that begin where a repeat can begin:
   in windows whose occurrences differ in the byte before (left-extension diversity), and at the
   first window of an anchor.  One stack scan over the common prefixes of neighbours yields the
   interval tree.  An interval whose members differ to the left is a maximal repeat group, and its
   members are all of its occurrences, not just neighbours in the array.

The tree is given as two tables of linear size: suffixes by rank, and intervals of ranks with the
length of the common prefix.  A group that reaches past its anchor's windows (at most
``2 * MIN_BYTES - GRAM`` bytes) goes on in the interval of the next anchor, which starts inside it;
such intervals are marked ``open_left`` or ``open_right``.

For removal, the scan also keeps the earliest occurrence of every interval: each suffix gets the
length of the longest prefix that begins earlier as well, which is the depth of the deepest interval
in which it is not the earliest.  The union of these spans is every byte under a string of
``MIN_BYTES`` bytes that starts earlier.

Documents are ordered by (id, hash of id and text).  Edge cases: a null text is empty; texts shorter
than ``MIN_BYTES`` have no windows; rows that repeat both id and text are one document and get equal
results; a null id comes first in the order; an empty table gives an empty result; extra columns are
ignored.  Equality is by 64-bit hashes of the windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import small_batches, text_slices
from tessera.llm.hashing import mix, powers
from tessera.llm.store import stage, table

MIN_BYTES = 100
GRAM = 32
#: Texts are worked on in pieces of at most so many bytes; the low bits of a hash hold the place in it.
PIECE, PLACE_BITS = 1 << 19, 22
#: Bytes of windows that a part works on at a time, if they are of more than one anchor.
WORK_BYTES = 3 << 18

_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
U = np.uint64


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def _hashes(total: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    _, down = powers(len(total))
    return mix((total[starts + width] - total[starts]) * down[starts])


def anchors(data: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document, hash, anchor, first window, last window) for the anchors of documents *off* of *data*, in order."""
    n = len(data)
    grams = least - GRAM + 1
    if n < least:
        return tuple(np.zeros(0, t) for t in (np.int64, U, np.int64, np.int64, np.int64))
    total = _prefix(data)
    h = mix((total[GRAM:] - total[:-GRAM]) * powers(n + 1)[1][: n - GRAM + 1])
    low = U((1 << PLACE_BITS) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=U)
    width = 1
    while 2 * width <= grams:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < grams:
        v = np.minimum(v[: len(v) - (grams - width)], v[grams - width :])
    place = (v & low).astype(np.int64)
    # windows that lie within one document
    begin, end = off[:-1], off[1:] - least + 1
    doc = np.repeat(np.arange(len(begin)), np.maximum(end - begin, 0))
    window = np.concatenate([np.arange(a, b) for a, b in zip(begin.tolist(), end.tolist()) if b > a]) if len(doc) else np.zeros(0, np.int64)
    own = place[window]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    return doc[first], h[own[first]], own[first], window[first], window[last]


def _pieces(batch: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each document, bytes, offsets, bytes before each document): long texts in pieces that overlap by a window."""
    for a, b, data, off in text_slices(batch, "text", PIECE):
        if len(data) <= 2 * PIECE:
            yield np.arange(a, b), data, off, np.zeros(b - a, np.int64)
        else:  # a single long text
            for at in range(0, len(data), PIECE):
                part = data[at : at + PIECE + least - 1]
                yield np.array([a]), part, np.array([0, len(part)]), np.array([at])


def _lists(order: np.ndarray, group: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Distinct sorted groups, and each column as one list for each group."""
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(g)).astype(np.int32))
    return g[first], [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in cols]


def _send_anchors(least: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for rows, data, off, base in _pieces(batch, least):
                doc, h, place, _, _ = anchors(data, off, least)
                if not len(doc):
                    continue
                part = (h % U(parts)).astype(np.int32)
                group, cols = _lists(np.argsort(part, kind="stable"), part, h.view(np.int64), keys[rows[doc]], place - off[doc] + base[doc])
                yield pa.RecordBatch.from_arrays([pa.array(group), *cols], names=["part", "h", "key", "place"])

    return run


def _repeated(parts: int):
    """Arrow function: anchors of one partition that occur twice or more, sent on by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        h, key, place = (np.concatenate(x) for x in zip(*held))
        del held
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        pick = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        key, place = key[pick], place[pick]
        part = (key.view(U) % U(parts)).astype(np.int32)
        group, cols = _lists(np.argsort(part, kind="stable"), part, key, place)
        for k in range(0, len(group), 256):
            yield pa.RecordBatch.from_arrays([pa.array(group[k : k + 256]), *(c.slice(k, 256) for c in cols)], names=["part", "key", "place"])

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated anchors of one partition's documents, as one row for each document."""
    held = [(b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    key, place = (np.concatenate(x) for x in zip(*held))
    group, (places,) = _lists(np.argsort(key, kind="stable"), key, place)
    for k in range(0, len(group), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(group[k : k + 4096]), places.slice(k, 4096)], names=["key", "places"])


def _ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of *data* in ascending order of start, a piece of about PIECE bytes at a time."""
    out = np.empty(len(start), U)
    stop = start + size
    k = 0
    while k < len(start):
        m = max(k + 1, int(np.searchsorted(start, start[k] + PIECE, "right")))
        first, last = int(start[k]), int(stop[k:m].max())
        total = _prefix(data[first:last])
        out[k:m] = mix((total[stop[k:m] - first] - total[start[k:m] - first]) * powers(len(total))[1][start[k:m] - first])
        k = m
    return out


def _collapse(h, ids, keys, at, size, same) -> tuple[np.ndarray, np.ndarray]:
    """(first, others): of anchors with equal windows around them (hashes *same*), the earliest, and those that follow it.

    Every window of the others begins earlier too, so they are covered whole and need no suffixes.  Rows that
    repeat id and text have the same anchors: those are not earlier ones, and one of each is enough.
    """
    order = np.lexsort((at, keys, ids, size, same, h))
    a, b = order[1:], order[:-1]
    new = np.concatenate([[True], (h[a] != h[b]) | (same[a] != same[b]) | (size[a] != size[b])])
    twin = np.concatenate([[False], (ids[a] == ids[b]) & (keys[a] == keys[b]) & (at[a] == at[b])])
    return np.sort(order[new]), order[~new & ~twin]


def _send_windows(least: int, parts: int, collapse: bool):
    """Documents with their repeated anchors -> by part: hash, document, place, byte before, length and bytes of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy()
            keys = batch.column(1).to_numpy()
            wanted = batch.column(batch.schema.get_field_index("places"))
            lens = wanted.value_lengths().to_numpy()
            flat = wanted.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(lens)])
            for rows, data, off, base in _pieces(batch, least):
                doc, h, place, lo, hi = anchors(data, off, least)
                mine = place - off[doc] + base[doc]
                ok = np.zeros(len(doc), bool)
                edge = np.searchsorted(doc, np.arange(len(rows) + 1))
                for k, r in enumerate(rows.tolist()):
                    a, b = edge[k], edge[k + 1]
                    ok[a:b] = np.isin(mine[a:b], flat[starts[r] : starts[r + 1]])
                doc, h, lo, hi = doc[ok], h[ok], lo[ok], hi[ok]
                if not len(doc):
                    continue
                at = lo - off[doc] + base[doc]
                before = np.where(at > 0, data[np.maximum(lo - 1, 0)].astype(np.int16), np.int16(-1))
                before = np.where((at > 0) & (lo == off[doc]), np.int16(-2), before)  # the byte before is in the piece before
                size = (hi + least - lo).astype(np.int32)
                own_ids, own_keys = ids[rows[doc]], keys[rows[doc]]
                if collapse:
                    one, more = _collapse(h, own_ids, own_keys, at, size, _ranges(data, lo, size))
                    if len(more):
                        part = (h[more] % U(parts)).astype(np.int32)
                        group, cols = _lists(np.argsort(part, kind="stable"), part, own_keys[more], at[more], size[more])
                        none = pa.nulls(len(group))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(group), none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int64())), cols[0], cols[1], none.cast(pa.list_(pa.int16())), cols[2], none.cast(pa.binary())],
                            names=["part", "h", "id", "key", "at", "before", "size", "bytes"],
                        )
                    h, lo, at, before, size, own_ids, own_keys = (x[one] for x in (h, lo, at, before, size, own_ids, own_keys))
                part = (h % U(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                group, cols = _lists(order, part, h.view(np.int64), own_ids, own_keys, at, before, size)
                own = size[order].astype(np.int64)
                ends = np.cumsum(own)
                take = np.repeat(lo[order] - (ends - own), own) + np.arange(ends[-1])
                blob = data[take].tobytes()
                cut = np.concatenate([[0], ends[np.append(np.flatnonzero(np.diff(part[order])), len(order) - 1)]])
                blobs = pa.array([pack(blob[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(group), *cols, blobs], names=["part", "h", "id", "key", "at", "before", "size", "bytes"])

    return run


def scan_tree(lcp: list[int], rank: list[int], left: list[int]) -> tuple[list[tuple[int, int, int, bool]], list[int]]:
    """Stack scan of an enhanced suffix array.

    *lcp* has the common prefix of each suffix with the one before it (0 where there is none),
    *rank* the place of each suffix in text order, *left* the byte before it (below 0: none).
    Returns the intervals (length, first, last, differs to the left), children before parents, and
    for each suffix the longest prefix that an earlier place has too.
    """
    n = len(lcp)
    found: list[tuple[int, int, int, bool]] = []
    cover = [0] * n
    # of each open interval: length, first suffix, earliest suffix, byte before (None: they differ)
    stack: list[list] = []
    for k in range(n + 1):
        here = lcp[k] if k < n else 0
        first, best, byte = (k - 1, k - 1, left[k - 1] if left[k - 1] >= 0 else None) if k else (0, 0, None)
        if k:
            while stack and stack[-1][0] > here:
                length, f, b, c = stack.pop()
                # what was open since then joins this interval
                if rank[b] < rank[best]:
                    cover[best] = cover[best] or length
                    best = b
                elif b != best:
                    cover[b] = cover[b] or length
                byte = byte if byte == c else None
                first = f
                found.append((length, first, k - 1, byte is None))
            if here:
                if stack and stack[-1][0] == here:
                    top = stack[-1]
                    if rank[best] < rank[top[2]]:
                        cover[top[2]] = cover[top[2]] or here
                        top[2] = best
                    elif best != top[2]:
                        cover[best] = cover[best] or here
                    top[3] = top[3] if top[3] == byte else None
                else:
                    stack.append([here, first, best, byte])
    return found, cover


def _suffix_array(h, ids, keys, at, before, size, data, least: int):
    """Sorted suffixes of the windows of whole anchors: arrays (document, place, rank, byte before, common prefix, edge, end)."""
    n = len(h)
    base = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    count = size - least + 1
    occ = np.repeat(np.arange(n), count)
    into = np.arange(len(occ)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    start = base[occ] + into
    window = _hashes(_prefix(data), start, least)
    order = np.argsort(window, kind="stable")
    s = window[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    cls = np.cumsum(new) - 1
    edges = np.flatnonzero(new)
    many = (np.diff(np.append(edges, len(s))) > 1)[cls]
    order, cls = order[many], cls[many]
    if not len(order):
        return None
    prev = np.where(into[order] > 0, data[np.maximum(start[order] - 1, 0)].astype(np.int16), before[occ[order]])
    edges = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    lowest, highest = np.minimum.reduceat(prev, edges), np.maximum.reduceat(prev, edges)
    diverse = (lowest != highest) | (lowest < 0)
    span = np.diff(np.append(edges, len(cls)))
    pick = np.repeat(diverse, span) | (into[order] == 0)
    order, cls, prev = order[pick], cls[pick], prev[pick]
    if not len(order):
        return None
    rest = (size[occ[order]] - into[order] - least).astype(np.int64)  # bytes past the first window
    wide = int(rest.max()) if len(rest) else 0
    text = np.zeros((len(order), 8 + wide), np.uint8)
    text[:, :8] = cls.astype(">u8").view(np.uint8).reshape(-1, 8) + 1
    for k in range(wide):
        has = rest > k
        text[has, 8 + k] = data[start[order[has]] + least + k] + 1
    by = np.argsort(text.view(f"S{8 + wide}").ravel(), kind="stable")
    order, prev, rest, text = order[by], prev[by], rest[by], text[by]
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(1), differ.argmax(1), 8 + np.minimum(rest[1:], rest[:-1]))
    lcp = np.concatenate([[0], np.where(common < 8, 0, common - 8 + least)])
    o = occ[order]
    place = at[o] + into[order]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((place, keys[o], ids[o]))] = np.arange(len(order))
    return ids[o], keys[o], place, rank, prev, lcp, into[order] == 0, rest


def _work(batches: Iterator[pa.RecordBatch], covered: list | None = None) -> Iterator[tuple]:
    """Whole anchors of one partition, in pieces of about WORK_BYTES: arrays for :func:`_suffix_array`.

    With *covered*, anchors whose windows are all earlier as well go there as (key, at, size) instead.
    """
    held = []
    for b in batches:
        if covered is not None and b.num_rows:
            whole = b.column(7).is_null()
            for r in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
                covered.append(tuple(b.column(c)[r].values.to_numpy() for c in (3, 4, 6)))
            b = b.filter(pc.invert(whole))
        if b.num_rows:
            held.append(b)
    if not held:
        return
    h, ids, keys, at, before, size = (np.concatenate([b.column(k).flatten().to_numpy() for b in held]) for k in range(1, 7))
    unpack = zstandard.ZstdDecompressor().decompress
    data = np.concatenate([np.frombuffer(unpack(x), np.uint8) for b in held for x in b.column(7).to_pylist()])
    del held
    begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    if covered is not None:
        one, more = _collapse(h, ids, keys, at, size, _ranges(data, begin[:-1], size))
        covered.append((keys[more], at[more], size[more]))
        order = one[np.lexsort((at[one], keys[one], ids[one], h[one]))]
    else:
        order = np.lexsort((at, keys, ids, h))
    # rows that repeat id and text send the same windows; one of each is enough
    same = (h[order][1:] == h[order][:-1]) & (keys[order][1:] == keys[order][:-1]) & (ids[order][1:] == ids[order][:-1]) & (at[order][1:] == at[order][:-1])
    order = order[np.concatenate([[True], ~same])]
    s = h[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s))
    weight = np.concatenate([[0], np.cumsum(size[order], dtype=np.int64)])
    k = 0
    while k < len(edges) - 1:
        stop = int(np.searchsorted(weight[edges], weight[edges[k]] + WORK_BYTES, "right")) - 1
        stop = min(max(stop, k + 1), len(edges) - 1)
        own = order[edges[k] : edges[stop]]
        n = size[own].astype(np.int64)
        ends = np.cumsum(n)
        take = np.repeat(begin[own] - (ends - n), n) + np.arange(ends[-1])
        yield h[own], ids[own], keys[own], at[own], before[own], size[own], data[take]
        k = stop


def _spans(least: int):
    """Arrow function: by document, starts and lengths of passages that begin earlier as well."""

    def rows(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        group, lists = _lists(np.argsort(keys, kind="stable"), keys, starts, lengths.astype(np.int64))
        for k in range(0, len(group), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(group[k : k + 8192]), *(x.slice(k, 8192) for x in lists)], names=["key", "starts", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered: list[tuple] = []
        for work in _work(batches, covered):
            built = _suffix_array(*work, least)
            if built is None:
                continue
            _, keys, place, rank, left, lcp, _, _ = built
            _, cover = scan_tree(lcp.tolist(), rank.tolist(), left.tolist())
            cover_ = np.array(cover, np.int64)
            hit = np.flatnonzero(cover_)
            if len(hit):
                yield from rows(keys[hit], place[hit], cover_[hit])
        covered = [c for c in covered if len(c[0])]
        if covered:
            yield from rows(*(np.concatenate(x) for x in zip(*covered)))

    return run


def _tree(least: int, parts: int):
    """Arrow function: the interval trees as rows; ``last`` is null in rows of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for work in _work(batches):
            built = _suffix_array(*work, least)
            if built is None:
                continue
            ids, _, place, rank, left, lcp, edge, rest = built
            found, _ = scan_tree(lcp.tolist(), rank.tolist(), left.tolist())
            n = len(ids)
            tree = int(work[0].min())  # the least anchor of the piece names its tree
            none = -(1 << 63)
            keep = [(length, a, b, diverse) for length, a, b, diverse in found if diverse or edge[a : b + 1].all()]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree] * (n + len(keep)), pa.int64()),
                "first": pa.array([*range(n), *(a for _, a, _, _ in keep)], pa.int64()),
                "last": pa.array([*[None] * n, *(b for _, _, b, _ in keep)], pa.int64()),
                "length": pa.array([*[None] * n, *(x for x, _, _, _ in keep)], pa.int64()),
                "open_left": pa.array([*[None] * n, *(not d for _, _, _, d in keep)], pa.bool_()),
                "open_right": pa.array([*[None] * n, *(bool((rest[a : b + 1] + least == x).all()) for x, a, b, _ in keep)], pa.bool_()),
                "doc_id": pa.array([*(None if x == none else x for x in ids.tolist()), *[None] * len(keep)], pa.int64()),
                "start": pa.array([*place.tolist(), *[None] * len(keep)], pa.int64()),
            })

    return run


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text); every join by key starts from this, so that Spark shuffles the texts once."""
    return docs.select(F.col(id_col).cast("long").alias("id"), _key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


def _windows(docs: DataFrame, least: int, id_col: str, text_col: str, collapse: bool) -> DataFrame:
    """Windows around repeated anchors, by part; with *collapse*, equal windows of a batch are sent once."""
    if least < 2 * GRAM:
        raise ValueError(f"passages must have {2 * GRAM} bytes at least")
    spark = docs.sparkSession
    small_batches(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(docs, id_col, text_col)
    sent = rows.select("key", "text").mapInArrow(_send_anchors(least, parts), "part int, h array<bigint>, key array<bigint>, place array<bigint>")
    known = sent.repartition(parts // 4, "part").mapInArrow(_repeated(parts), "part int, key array<bigint>, place array<bigint>")
    known = known.repartition(parts // 4, "part").mapInArrow(_by_document, "key long, places array<bigint>")
    return (
        rows.join(known, "key").select("id", "key", "text", "places")
        .mapInArrow(_send_windows(least, parts, collapse), "part int, h array<bigint>, id array<bigint>, key array<bigint>, at array<bigint>, before array<smallint>, size array<int>, bytes binary")
        .repartition(parts // 4, "part")
    )


def repeat_groups(docs: DataFrame, least: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(groups, suffixes): groups (tree, first, last, length, open_left, open_right), suffixes (tree, rank, doc_id, start).

    All occurrences of a group are the suffixes of its tree with ranks from ``first`` to ``last``.
    """
    both = stage(_windows(docs, least, id_col, text_col, False).mapInArrow(
        _tree(least, 0), "tree long, first long, last long, length long, open_left boolean, open_right boolean, doc_id long, start long"
    ), "repeat-trees")
    return (
        both.where("last IS NOT NULL").select("tree", "first", "last", "length", "open_left", "open_right"),
        both.where("last IS NULL").select("tree", F.col("first").alias("rank"), "doc_id", "start"),
    )


def earlier_spans(docs: DataFrame, least: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, starts, lengths): passages of at least *least* bytes that begin earlier too, by document."""
    spans = _windows(docs, least, id_col, text_col, True).mapInArrow(_spans(least), "key long, starts array<bigint>, lengths array<bigint>")
    return spans.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"))


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of the union of spans."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[k]), int(starts[k] + lengths[k])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, kept = [], [], [], []
        for text, starts, lengths in zip(batch.column(1), batch.column(2), batch.column(3)):
            raw = (text.as_py() or "").encode("utf-8")
            spans = merged(starts.values.to_numpy(), lengths.values.to_numpy()) if starts.is_valid else []
            sha, at = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(raw[at:a])
                at = b
            sha.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
            kept.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # not staged: in one plan, both joins read the same shuffle of the texts
    return _rows(docs, "doc_id", "text").join(earlier_spans(docs), "key", "left").select("id", "text", "starts", "lengths").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
win AS (SELECT doc_id, p, md5(substr(h, (2 * p + 1)::BIGINT, {2 * MIN_BYTES})) AS g FROM (SELECT doc_id, h, unnest(range(0, n - {MIN_BYTES - 1})) AS p FROM d WHERE n >= {MIN_BYTES})),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
isle AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {MIN_BYTES} THEN 0 ELSE 1 END AS new FROM dup)),
run AS (SELECT doc_id, min(p) AS a, max(p) + {MIN_BYTES} AS b FROM isle GROUP BY doc_id, i),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM run UNION ALL SELECT doc_id, max(b), NULL FROM run GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(h, (2 * x + 1)::BIGINT, (2 * (coalesce(y, n) - x))::BIGINT), '' ORDER BY x) AS k FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id),
s AS (SELECT doc_id, sum(b - a)::BIGINT AS r, count(*)::BIGINT AS c FROM run GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
