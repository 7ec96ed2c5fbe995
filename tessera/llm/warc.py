"""WARC archives of captured pages, and their capture index by external merge.

Writing: each task streams its records, each a gzip member of its own, into archives of about
``FILE_BYTES`` in the shared folder; a file counts once the task that wrote it has reported its name,
so a task that is run twice or lost leaves nothing that is read.  Of captures with equal payloads the
one with the least id is stored whole, the others as revisits that refer to it.

Reading: each archive is read back record by record and yields one run of captures sorted by (URL
key, timestamp, id).  The runs are the sorted input of an external merge: the key space is cut into
ranges, a range gets its piece of each run, and a loser tree merges the k pieces.  Ranges in order
are the global capture history.  A hot URL is cut by timestamp and id, so it has no range to itself.

Edge cases: a null payload is empty; a null URL is kept as null, with an empty key; a null id comes
last among equal payloads and is archived like any other; repeated rows of the least id are all
responses; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import small_batches
from tessera.llm.store import fresh_path, stage, table

FILE_BYTES = 16 << 20
#: Groups of equal payloads (about 60 bytes each) up to this many are broadcast, more are joined by shuffle.
BROADCAST_GROUPS = 400_000
#: Captures in a range of the merge.
RANGE_ROWS = 50_000
#: Captures without a time of their own are one second apart from here, by id.
EPOCH = dt.datetime(2024, 1, 1)

_RUN = "run string, seq long, url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, without scheme, ``www``, default port and fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    port_text = "" if port in (None, 80, 443) else f":{port}"
    query = f"?{u.query}" if u.query else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){(u.path or '/')}{query}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, ts: str, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the payload's length and digest, not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{ts}|{sha}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z", f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=~-._''')}")
    if page_id is not None:
        lines.append(f"WARC-Source-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Source-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for page_id, url, ts, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                payload = (html or "").encode("utf-8")
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = gz.compress(record(page_id, url, ts, payload, digest(payload), refers_to)) + gz.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts_col: str | None = None) -> list[str]:
    """Archive every row of *pages* below *folder*; returns the names of the archives."""
    small_batches(pages.sparkSession)
    made = F.date_format(F.timestamp_seconds(F.lit(int((EPOCH - dt.datetime(1970, 1, 1)).total_seconds())) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(10**9))), "yyyyMMddHHmmss")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), (F.col(ts_col) if ts_col else made).alias("ts"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    keyed = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    equal = stage(keyed.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "equal-payloads")
    few = equal.count() <= BROADCAST_GROUPS
    marked = keyed.join(F.broadcast(equal) if few else equal, ["sha", "size"], "left").select(
        "page_id", "url", "ts", "html", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    return [r.name for r in marked.mapInArrow(_writer(folder), "name string, n long").collect()]  # a row for each archive


def records(data) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of an open archive of gzip members."""
    held, at = b"", 0
    while True:
        gz, parts, used = zlib.decompressobj(31), [], 0
        while not gz.eof:
            if not held:
                held = data.read(1 << 20)
                if not held:
                    if used:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(gz.decompress(held))
            used += len(held) - len(gz.unused_data)
            held = gz.unused_data
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("not a whole WARC record")
        yield at, used, headers, block
        at += used


def capture(headers: dict[str, str], block: bytes) -> tuple:
    """(url key, timestamp, id, url, payload bytes, digest, type, refers to) of a record as read."""
    kind, sha = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError("a payload does not have its digest")
    url = headers.get("WARC-Target-URI")
    url = unquote(url) if url is not None else None
    refers = headers.get("WARC-Refers-To-Source-ID")
    page_id = headers.get("WARC-Source-ID")
    return url_key(url), re.sub(r"\D", "", headers["WARC-Date"]), None if page_id is None else int(page_id), url, size, sha, kind, None if refers is None else int(refers)


def _order(c: tuple) -> tuple:
    """Runs and merge agree on this: key, timestamp, id, and null ids first."""
    return c[0], c[1], c[2] is not None, c[2] or 0


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as data:
                    rows = [(*capture(h, b), at, n) for at, n, h, b in records(data)]
                rows.sort(key=_order)
                for k in range(0, len(rows), 4096):
                    cols = list(zip(*rows[k : k + 4096]))
                    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(cols[0])), pa.array(range(k, k + len(cols[0])), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))],
                        names=[x.split()[0] for x in _RUN.split(", ")],
                    )

    return run


class LoserTree:
    """Merges k sorted iterators: an inner node keeps the loser of its match, the root's winner goes out."""

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs = key, runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [0] * self.k
        winners = [0] * (2 * self.k)
        for i in range(self.k):
            winners[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        p, q = self.key(x), self.key(y)
        return p < q or p == q and a < b

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: the pieces of the runs, each in order, become one piece of the history."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    piece = pa.Table.from_batches(held).combine_chunks()
    names = piece.column("run").to_pylist()
    cols = list(zip(*(piece.column(c).to_pylist() for c in ("url_key", "ts", "page_id"))))
    cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
    tree = LoserTree([iter(range(a, b)) for a, b in zip(cuts, cuts[1:])], lambda k: _order(cols[k]))
    yield from piece.take(pa.array(list(tree), pa.int64())).combine_chunks().to_batches(max_chunksize=4096)


def capture_index(spark: SparkSession, folder: str, archives: list[str]) -> DataFrame:
    """All captures of *archives*: partitions in order, and rows in order in each, by (URL key, timestamp, id)."""
    listed = spark.createDataFrame([(a,) for a in archives], "name string")
    runs = stage(listed.repartition(max(1, len(archives)), "name").mapInArrow(_reader(folder), _RUN), "capture-runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    pieces = runs.repartitionByRange(ranges, "url_key", "ts", "page_id").sortWithinPartitions("run", "seq")
    return pieces.mapInArrow(_merge, _RUN)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    archives = write(table(spark, sf_dir, "pages"), folder)
    return capture_index(spark, folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (5 * (k // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))::INTEGER) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to
FROM f
"""
