"""Language identification by rank-order profiles.

A profile is the list of the ``PROFILE`` most frequent n-grams (1 to 3 bytes of lower-cased letters and
their combining marks, words set apart by one blank), by rank.  A document's own list, counted over its whole text, is
compared with each language's by out-of-place distance: the difference of the ranks, or ``PROFILE``
where a language does not have the n-gram.  The nearest language is the prediction, and the score is
how much nearer it is than the second, ``1 - nearest / second``.

Profiles are learned from about ``PER_LANGUAGE`` whole documents of a language (fewer than twice as
many), chosen by a hash of their id; the bound holds at every input size.  Only counts of languages
and the profiles (``PROFILE`` rows for each language) reach the driver.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a null lang or a null id is
never learned from, and a null id is not held out; ties go to the language whose name sorts first;
without any learned language every prediction is ``und``; repeated rows get equal predictions; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.arrow import small_batches
from tessera.llm.store import table

PROFILE = 400
PER_LANGUAGE = 3000

#: The one test for a letter, in training and in prediction.
_LETTER = r"\p{L}"
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_KEPT = np.full(256, 0x20, np.uint8)
_KEPT[0x80:] = np.arange(0x80, 0x100)
_KEPT[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of *text*; a code holds the bytes and, above them, their number."""
    low = text.lower()
    if not low.isascii():
        low = _NO_LETTERS.sub(" ", low)
    b = _KEPT[np.frombuffer(f" {low} ".encode("utf-8", "replace"), np.uint8)]
    blank = b == 0x20
    b = b[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    one = b[b != 0x20]
    return np.unique(np.concatenate([one | 0x1000000, two | 0x2000000, three | 0x3000000]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The *most* frequent codes; ties in order of code."""
    if len(codes) > 4 * most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.argsort(-counts, kind="stable")[:most]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, code, n), added up by batch."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        by: dict[str, list] = {}
        for lang, text in zip(langs, batch.column(1)):
            by.setdefault(lang, []).append(grams(text.as_py()))
        for lang, parts in by.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([k for _, k in parts])).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes)), "code": pa.array(codes.astype(np.int64)), "n": pa.array(n)})


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language from the rows (id, text, lang) of *docs*."""
    small_batches(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND id IS NOT NULL").where(F.col("text").rlike(_LETTER))
    # one row for each language; a language of many documents keeps one of every so many, by hash
    steps = {r.lang: max(1, r.n // per_language) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not steps:
        return {}
    step = F.element_at(F.create_map(*[x for k, m in steps.items() for x in (F.lit(k), F.lit(m))]), F.col("lang"))
    texts = known.where(F.pmod(F.xxhash64("id"), step) == 0).select("lang", "text")
    counts = texts.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= most)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():
        out.setdefault(r.lang, []).append((r.r, r.code))
    return {k: [c for _, c in sorted(v)] for k, v in sorted(out.items())}


def _predict(profiles: dict[str, list[int]], most: int):
    names = list(profiles)
    codes = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)
    place = np.full((len(codes) + 1, len(names)), -1, np.int64)
    for k, p in enumerate(profiles.values()):
        place[np.searchsorted(codes, p), k] = np.arange(len(p))

    def one(text: str, lettered: bool) -> tuple[str, float]:
        if not names or not lettered:
            return "und", 0.0
        own = ranked(*grams(text), most)
        at = np.searchsorted(codes, own)
        at[at == len(codes)] = 0
        at[codes[at] != own] = len(codes)
        ranks = place[at]
        far = np.where(ranks < 0, most, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        order = np.argsort(far, kind="stable")
        second = far[order[1]] if len(names) > 1 else most * len(own)
        return names[order[0]], float(1 - far[order[0]] / second) if second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py(), x) for t, x in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, profiles: dict[str, list[int]], most: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of *docs*; only the text decides."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), F.col(text_col).rlike(_LETTER).alias("lettered")).mapInArrow(
        _predict(profiles, most), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    return predict(docs, profiles)
