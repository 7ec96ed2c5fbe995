"""Token-id files: one zstandard frame for each document, under one shared dictionary.

A file holds a contiguous range of documents in ascending id order::

    magic "TSRTOK01" | sha256 of the dictionary (32 bytes) | bytes in an id (1 byte: 2 or 4)
    frames, one for each document: its ids, little-endian, compressed with the dictionary
    index: doc ids int64[n], frame offsets uint64[n + 1], token counts uint64[n], null flags uint8[n]
    footer: n uint64 | offset of the index uint64 | magic

So one document is read with two short reads: its index entry and its frame.  The folder also holds
the dictionary and a table of the files, whose token totals place them on the common token axis.

The table is cut into id ranges by a sample of its ids; each range is sorted and written by one task, as
files of about ``FILE_BYTES``.  A range sees its rows one by one, and an id that would fill several
ranges is dealt over them by a checksum, so neither a file nor a hot id is held in memory.

The dictionary is trained on the ids of about ``MAX_SAMPLES`` documents, a slice of at most
``SAMPLE_CHARS`` at a random place of each; the bounds hold at every input size, and every document is
encoded whole.  Where the sample is too small to train on, the dictionary is empty.

With a byte-level BPE, no token reaches across a single blank but to begin with it, so a text of plain
Latin letters is the sequence of its pieces between blanks: the pieces of some documents are made
distinct, the new ones are encoded as one text and cut by the bytes of their tokens, and the ids are put
together by place.  All other texts, and tokenizers of another kind, go through the library whole.

Edge cases: a null or empty text is the end id alone; repeated rows are separate documents next to
each other; null ids come first; an empty table writes no file and gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.arrow import batch_rows
from tessera.llm.store import fresh_path, table

MAGIC = b"TSRTOK01"
END_ID = 2
MAX_SAMPLES, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 16_384, 65_536
#: Texts of about so many bytes make a range of ids; frames of so many bytes end a file.
FILE_BYTES = 48 << 20
#: Ranges at most, and ids sampled for each to find their bounds: the driver sees no more than the product.
MAX_RANGES, IDS_A_RANGE = 20_000, 64
#: Pieces a worker remembers (about 30 bytes each), and bytes of text whose pieces are made distinct together.
CACHE_PIECES, TOGETHER_BYTES = 400_000, 12 << 20
#: Pieces encoded as one text.
PIECES_A_TEXT = 16_384
LEVEL = 1

#: What a text must not have to be encoded by pieces: anything but Latin letters, marks, single blanks and line ends.
_OTHER = "[^\\t\\n\\r -~¡-ɏ]|<\\||  "
#: A byte-level vocabulary spells line ends, tabs and blanks so; a token that joins a blank to another of them reaches across a piece.
_JOINED = re.compile("[ĉĊč]Ġ|Ġ[ĉĊč]")

_coders: dict[str, Coder] = {}


class Coder:
    """Texts to ids, for one tokenizer file, in one process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.by_pieces = _byte_level(json.loads(self.tokenizer.to_str()))
        self.other = _OTHER + ("|[\\t\\n\\r] | [\\t\\n\\r]" if any(_JOINED.search(t) for t in vocabulary) else "")
        # in a byte-level vocabulary, a letter of a token is a byte of text
        self.lengths = np.zeros(size, np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)
        self.heads: dict[str, np.ndarray] = {"": np.zeros(0, self.dtype)}
        # the piece "" is a blank that ends a text
        self.known = pa.array([""], pa.large_string())
        self.ids = self.whole(" ")
        self.sizes = np.array([len(self.ids)], np.int64)

    def whole(self, text: str) -> np.ndarray:
        """Ids of *text* by the library."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all *pieces*, each behind a blank; how many each has)."""
        every, sizes = [], []
        for k in range(0, len(pieces), PIECES_A_TEXT):
            text = " " + " ".join(pieces[k : k + PIECES_A_TEXT])
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            stops = np.append(np.flatnonzero(raw == 0x20)[1:], len(raw))
            ids = self.whole(text)
            ends = np.cumsum(self.lengths[ids])
            cut = np.searchsorted(ends, stops)
            if not np.array_equal(ends[cut], stops):
                raise ValueError("a token reaches across a blank: this vocabulary is not cut by pieces")
            every.append(ids)
            sizes.append(np.diff(cut + 1, prepend=0))
        return (np.concatenate(every), np.concatenate(sizes)) if every else (np.zeros(0, self.dtype), np.zeros(0, np.int64))

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all *texts*, the end id behind each; where each ends)."""
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        every = split.flatten()
        heads = every.take(pa.array(offsets[:-1])).to_pylist()
        pieces = pc.dictionary_encode(every)
        distinct = pieces.dictionary.cast(pa.large_string())
        # entries: known pieces, new ones, first pieces, the end
        place = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = distinct.filter(pa.array(place < 0))
        ids, sizes = self._new(fresh.to_pylist())
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        for h in {*heads} - self.heads.keys():
            self.heads[h] = self.whole(h)
        first = list(dict.fromkeys(heads))
        flat = np.concatenate([self.ids, ids, *(self.heads[h] for h in first), np.array([END_ID], self.dtype)])
        size = np.concatenate([self.sizes, sizes, [len(self.heads[h]) for h in first], [1]]).astype(np.int64)
        begin = np.cumsum(size) - size
        base = len(self.known) + len(fresh)
        row = place[pieces.indices.to_numpy()]
        at = dict(zip(first, range(base, base + len(first))))
        row[offsets[:-1]] = [at[h] for h in heads]
        row = np.insert(row, offsets[1:], base + len(first))
        own = size[row]
        stop = np.cumsum(own)
        out = flat[np.repeat(begin[row] - (stop - own), own) + np.arange(stop[-1] if len(stop) else 0)]
        if len(self.known) < CACHE_PIECES:
            self.known = pa.concat_arrays([self.known, fresh])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        if len(self.heads) > CACHE_PIECES // 10:
            self.heads = {"": self.heads[""]}
        return out, stop[offsets[1:] + np.arange(len(texts))]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of *texts* (strings without nulls), each with the end id."""
        out: list[np.ndarray] = [None] * len(texts)
        plain = ~pc.match_substring_regex(texts, self.other).to_numpy(zero_copy_only=False) if self.by_pieces else np.zeros(len(texts), bool)
        where = np.flatnonzero(plain)
        if len(where):
            ids, ends = self._by_pieces(texts.filter(pa.array(plain)))
            for k, a, b in zip(where.tolist(), [0, *ends.tolist()], ends.tolist()):
                out[k] = ids[a:b]
        for k in np.flatnonzero(~plain).tolist():
            out[k] = np.append(self.whole(texts[k].as_py()), self.dtype.type(END_ID))
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def _byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, which :class:`Coder` may cut at blanks."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        and not spec.get("truncation") and not spec.get("padding") and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    )


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _read(uri: str) -> bytes:
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def _write(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a task that is run twice leaves one whole file."""
    fs, path = _filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def _share(docs: DataFrame, wanted: int, rows: int) -> DataFrame:
    """About *wanted* of the *rows* of *docs*."""
    return docs if rows <= wanted else docs.sample(fraction=wanted / rows, seed=17)


def train_dictionary(slices: list[str], tokenizer: str) -> bytes:
    """Dictionary for serialized id arrays, from the ids of text slices; empty where they are too few to train one."""
    import zstandard

    samples = [x.tobytes() for x in coder(tokenizer).batch(pa.array([t for t in slices if t], pa.string()))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)


def _decompressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d)


def _range_of(bounds: np.ndarray, ids: pa.Array, sums: np.ndarray) -> np.ndarray:
    """The range of each id: a bound begins a range, and a bound that is listed m times has its rows dealt over m ranges."""
    own = ids.fill_null(-(1 << 63)).to_numpy()
    low, high = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right")
    return np.where(high > low + 1, low + 1 + (sums * (high - low) >> 32), high)


def _encode(tokenizer: str, dictionary_uri: str, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = coder(tokenizer), _compressor(_read(dictionary_uri)).compress

        def coded(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([b.column(0) for b in held])
            found = encode.batch(pa.concat_arrays([b.column(1) for b in held]).fill_null(""))
            first = 0
            while first < len(found):
                frames, sums, size = [], [], 0
                while first + len(frames) < len(found) and size < 4 << 20:
                    raw = found[first + len(frames)].tobytes()
                    frames.append(compress(raw))
                    sums.append(zlib.crc32(raw))
                    size += len(frames[-1])
                own = ids.slice(first, len(frames))
                sizes = [len(x) for x in found[first : first + len(frames)]]
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(_range_of(edges, own, np.array(sums, np.int64)).astype(np.int32)), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())],
                    names=["doc_id", "part", "n_tokens", "frame"],
                )
                first += len(frames)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= TOGETHER_BYTES:
                yield from coded(held)
                held, size = [], 0
        if held:
            yield from coded(held)

    return run


def _pack(folder: str, digest: bytes, width: int, file_bytes: int):
    """Arrow function over sorted rows: writes the files of each range, and says what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, head, ids, ends, sizes = None, 0, bytearray(), [], [], []

        def close() -> pa.RecordBatch:
            at = len(head)
            body = (
                np.array([x or 0 for x in ids], "<i8").tobytes() + np.array([len(MAGIC) + 33, *ends], "<u8").tobytes() + np.array(sizes, "<u8").tobytes()
                + np.array([x is None for x in ids], np.uint8).tobytes() + struct.pack("<QQ", len(ids), at) + MAGIC
            )
            name = f"part-{part:06d}-{seq:06d}.tok"
            _write(f"{folder}/{name}", bytes(head) + body)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [name], "n_docs": [len(ids)], "n_tokens": [sum(sizes)]})

        for batch in batches:
            for doc, own, size, frame in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if ids and (own != part or len(head) >= file_bytes):
                    yield close()
                    seq, ids = seq + 1, []
                if own != part:
                    part, seq = own, 0
                if not ids:
                    head, ends, sizes = bytearray(MAGIC + digest + bytes([width])), [], []
                head += frame
                ids.append(doc)
                ends.append(len(head))
                sizes.append(size)
        if ids:
            yield close()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write *docs* as token files below *folder*, with their dictionary and the table of :func:`files`."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = docs.count()
    place = f"1 + cast(rand(5) * greatest(0, length(text) - {SAMPLE_CHARS}) AS int)"
    sample = _share(docs, MAX_SAMPLES, rows).select(F.octet_length("text").alias("b"), F.expr(f"substring(text, {place}, {SAMPLE_CHARS})").alias("t")).collect()
    # only the number of ranges depends on this estimate
    size = sum(r.b or 0 for r in sample) * rows // max(1, len(sample))
    ranges = min(MAX_RANGES, max(1, -(-size // file_bytes)))
    ids = sorted(r.doc_id for r in _share(docs.select("doc_id"), IDS_A_RANGE * ranges, rows).where("doc_id IS NOT NULL").collect()) if ranges > 1 else []
    bounds = [ids[k * len(ids) // ranges] for k in range(1, ranges)] if ids else []
    dictionary = train_dictionary([r.t for r in sample], tokenizer)
    dictionary_uri = f"{folder}/dictionary.zdict"
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    _write(dictionary_uri, dictionary)
    digest = hashlib.sha256(dictionary).digest()
    with batch_rows(spark):
        (
            docs.mapInArrow(_encode(tokenizer, dictionary_uri, bounds), "doc_id long, part int, n_tokens long, frame binary")
            .repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "frame")
            .mapInArrow(_pack(folder, digest, coder(tokenizer).dtype.itemsize, file_bytes), "part int, seq int, name string, n_docs long, n_tokens long")
            .write.parquet(f"{folder}/files")
        )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``nth, name, start, n_docs, n_tokens`` of every file below *folder*; start counts the ids of all files before it."""
    listed = spark.read.parquet(f"{folder}/files")
    # at most MAX_RANGES rows, and then the files of one range
    total = listed.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m"))
    by = W.orderBy("part")
    before = total.select("part", (F.sum("n").over(by) - F.col("n")).alias("before"), (F.sum("m").over(by) - F.col("m")).alias("ahead"))
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return listed.join(F.broadcast(before), "part").select((F.col("ahead") + F.col("seq")).alias("nth"), "name", (F.col("before") + within).alias("start"), "n_docs", "n_tokens")


class TokenFile:
    """One file, open for reading by place or by document id."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head = len(MAGIC) + 33
        front, tail = self.file.read_at(head, 0), self.file.read_at(24, size - 24)
        if front[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{uri}: not a whole token file")
        if front[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: written with another dictionary")
        self.dtype = np.dtype("<u2") if front[40] == 2 else np.dtype("<u4")
        n, at = struct.unpack("<QQ", tail[:16])
        index = self.file.read_at(size - 24 - at, at)
        self.ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.sizes = np.frombuffer(index, "<u8", n, 16 * n + 8)
        self.nulls = np.frombuffer(index, np.uint8, n, 24 * n + 8)
        self._decode = _decompressor(dictionary).decompress

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, place: int) -> np.ndarray:
        a, b = int(self.offsets[place]), int(self.offsets[place + 1])
        ids = np.frombuffer(self._decode(self.file.read_at(b - a, a)), self.dtype)
        if len(ids) != self.sizes[place]:
            raise ValueError("a frame does not have the ids that the index names")
        return ids

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document of that id."""
        first = int(self.nulls.sum())
        at = first + int(np.searchsorted(self.ids[first:], doc_id))
        return self.read(at) if at < len(self) and self.ids[at] == doc_id else None


def _scan(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                dictionary = _read(f"{folder}/dictionary.zdict") if dictionary is None else dictionary
                file = TokenFile(f"{folder}/{name}", dictionary)
                for at in range(0, len(file), 2048):
                    stop = min(at + 2048, len(file))
                    sizes = file.sizes[at:stop].astype(np.int64)
                    crc = [zlib.crc32(file.read(k).astype("<u4").tobytes()) for k in range(at, stop)]
                    starts = start + np.concatenate([[0], np.cumsum(sizes)])
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(file.ids[at:stop], mask=file.nulls[at:stop].astype(bool)), pa.array(starts[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files below *folder*."""
    tasks = max(1, min(MAX_RANGES, spark.read.parquet(f"{folder}/files").count()))
    listed = files(spark, folder).select("name", "start", F.pmod("nth", F.lit(tasks)).cast("int").alias("task"))
    return listed.repartitionById(tasks, "task").mapInArrow(_scan(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return scan(spark, folder)
