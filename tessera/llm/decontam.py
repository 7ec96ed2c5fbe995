"""Benchmark decontamination by a distributed positional inverted index (native).

Training token postings (term, document, position) are stored as a table; benchmark windows are
answered from it:

1. The frequencies of the benchmark's terms are counted over all documents.
2. Each window of consecutive item words takes its ``ANCHORS`` rarest terms as its query terms.
3. The postings of those terms are stored.  Each list, moved back by the term's place in the item,
   is a list of places where the item may be aligned; the lists are intersected by alignment, and an
   alignment stays if all query terms of some window meet there.
4. Documents with an alignment send the words that lie there, and the item's windows are compared with
   them word for word, which gives exact phrase matches.

:func:`proximity_matches` answers from such postings too: items whose terms all lie within a span.

The texts are scanned four times (to count, to store postings, to confirm in the documents that have an
alignment, and for the number of words of all) and shuffled only where the alignments exceed
``BROADCAST_BYTES``.  What is shuffled otherwise are postings of rare terms.  The benchmark's side is
broadcast only while its words stay below the same bound; beyond it the joins shuffle.

Edge cases: null and empty texts have no words and match nothing; an item without words is no query;
an item shorter than the window is one window; repeated items count once for each item id, and items
of one id count together; repeated documents are told apart by their text, and repeated rows get
equal results; null ids are results like any other (a null item id counts as an item, and has no name to
list); empty tables give zero matches; extra columns are ignored or pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.store import packed, stage, table

WINDOW = 13
ANCHORS = 3
#: Tables up to so many bytes are sent to every executor; their size is measured first.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row without its strings, at most.
ROW_BYTES = 80
#: a document is contaminated if it has a hit and MIN_SHARE times its hits reach its words
MIN_SHARE = 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of ASCII letters and digits and of anything beyond ASCII.
_WORD = r"[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"


def _lowered(term: str) -> str:
    """SQL: A-Z lower-cased and nothing else; plain ASCII takes the fast way."""
    return f"if(octet_length({term}) = length({term}), lower({term}), translate({term}, '{_UPPER}', '{_UPPER.lower()}'))"


def tokens(df: DataFrame, key: list[Column], text_col: str) -> DataFrame:
    """*key* columns and ``r``, the words of the text as written."""
    return df.select(*key, F.expr(f"regexp_extract_all(coalesce(`{text_col}`, ''), '{_WORD}', 0)").alias("r"))


def _item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, w): the lower-cased words of each distinct item that has any; item numbers its text."""
    rows = tokens(items, [F.col(id_col).alias("item_id")], text_col).where("size(r) > 0")
    rows = rows.select("item_id", F.expr(f"transform(r, x -> {_lowered('x')})").alias("w")).distinct()
    return rows.select(F.xxhash64("item_id", F.array_join("w", " ")).alias("item"), "item_id", "w")


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _fits(staged: DataFrame, strings: str = "0") -> bool:
    """Whether a staged table may be broadcast; *strings* is SQL for the bytes of a row's strings."""
    row = staged.agg(F.sum(F.expr(f"cast({ROW_BYTES} + {strings} AS bigint)")).alias("b")).first()
    return (row.b or 0) <= BROADCAST_BYTES


def _counts(docs: DataFrame, vocabulary: DataFrame, few: bool) -> DataFrame:
    """(term, n): the places of each term of *vocabulary* in *docs* (r)."""
    return docs.select(F.explode("r").alias("x")).select(F.expr(_lowered("x")).alias("term")).join(_small(vocabulary, few), "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: (term, key, pos) for every place in *docs* (key, r) of a term in *terms*."""
    spread = docs.select("key", F.posexplode("r").alias("pos", "x")).select("key", "pos", F.expr(_lowered("x")).alias("term"))
    return stage(spread.join(terms, "term").select("term", "key", "pos"), "postings")


def plan(items: DataFrame, docs: DataFrame, width: int = WINDOW, anchors: int = ANCHORS) -> tuple[DataFrame, bool]:
    """((item, item_id, w, wins), few): windows (j, places) of each item with their rarest places in *docs*."""
    few = _fits(items, "aggregate(w, 0L, (a, x) -> a + 16 + octet_length(x)) + 8 * 8 * size(w)")
    vocabulary = stage(items.select(F.explode("w").alias("term")).distinct(), "vocabulary")
    counted = _counts(docs, vocabulary, few)
    known = items.select("item", F.posexplode("w").alias("at", "term")).join(counted, "term", "left").groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("f")
    )
    # a window with a term that no document has cannot occur
    rarest = f"transform(slice(array_sort(transform(slice(f, j, least({width}, size(w))), x -> struct(x.n AS n, x.at AS at))), 1, {anchors}), x -> x)"
    wins = f"""filter(transform(sequence(1, greatest(1, size(w) - {width - 1})), j -> struct(j - 1 AS j, {rarest} AS best)), x -> x.best[0].n > 0)"""
    out = items.join(known, "item").select("item", "item_id", "w", F.expr(f"transform({wins}, x -> struct(x.j AS j, transform(x.best, b -> b.at) AS places))").alias("wins"))
    return stage(out.where("size(wins) > 0"), "item-plan"), few


def alignments(docs: DataFrame, planned: DataFrame, few: bool) -> DataFrame:
    """(key, item, diag, j0, j1): where the query terms of some windows of an item all meet, and the first and last of these."""
    lists = stage(planned.select("item", "w", F.explode(F.array_distinct(F.flatten("wins.places"))).alias("at")).select("item", "at", F.expr("w[at]").alias("term")), "lists")
    index = postings(docs, _small(lists.select("term").distinct(), few))
    met = index.join(_small(lists, few), "term").select("key", "item", (F.col("pos") - F.col("at")).alias("diag"), "at")
    met = met.groupBy("key", "item", "diag").agg(F.collect_list("at").alias("have"))
    return met.join(_small(planned.select("item", "wins"), few), "item").select(
        "key", "item", "diag", F.expr("transform(filter(wins, x -> diag + x.j >= 0 AND size(array_except(x.places, have)) = 0), x -> x.j)").alias("js")
    ).where("size(js) > 0").select("key", "item", "diag", F.array_min("js").alias("j0"), F.array_max("js").alias("j1"))


def proximity_matches(docs: DataFrame, items: DataFrame, span: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item_id, start, stop): places in *docs* (key, r) where all distinct terms of an item lie within *span* words.

    The list of an item's rarest term comes first: only documents on it are looked at for the others, so a
    frequent term never meets items by itself.  Over each document's postings of the item's terms, a window
    looks *span* words ahead.  ``start`` has a posting of the item, and ``stop`` is its last term's place.
    An item with a term that no document has matches nothing.
    """
    words = _item_words(items, id_col, text_col)
    wanted = stage(words.select("item", "item_id", F.explode(F.array_distinct("w")).alias("term"), F.size(F.array_distinct("w")).alias("need")), "near-terms")
    few = _fits(wanted, "octet_length(term)")
    rarest = stage(
        wanted.join(_counts(docs, wanted.select("term").distinct(), few), "term").groupBy("item", "need")
        .agg(F.count("*").alias("m"), F.min(F.struct("n", "term")).alias("best")).where("m = need").select("item", F.col("best.term").alias("term")), "near-rarest"
    )
    on_list = stage(postings(docs, _small(rarest.select("term").distinct(), few)).select("term", "key").distinct().join(rarest, "term").select("key", "item"), "near-documents")
    asked = on_list.join(_small(wanted, few), "item").select("key", "item", "item_id", "term", "need")
    keys = on_list.select("key").distinct()
    index = postings(docs.join(_small(keys, _fits(on_list)), "key", "left_semi"), _small(wanted.select("term").distinct(), few))
    ahead = W.partitionBy("key", "item").orderBy("pos").rangeBetween(0, span - 1)
    hits = index.join(asked, ["key", "term"]).select(
        "key", "item_id", F.col("pos").alias("start"), "need",
        F.collect_set("term").over(ahead).alias("seen"), F.max("pos").over(ahead).alias("stop"),
    )
    return hits.where("size(seen) = need").select("key", "item_id", "start", "stop")


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, r): the words of every document under a key of its id and text."""
    return tokens(docs, [_key(id_col, text_col).alias("key")], text_col)


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(key, item_id, start, length): every place of a window of an item in *docs*, by the key of the document (staged)."""
    words = stage(_item_words(items, "item_id", "text"), "items")
    rows = keyed(docs, id_col, text_col)
    planned, few = plan(words, rows, width)
    met = stage(alignments(rows, planned, few), "alignments")
    maybe = met.groupBy("key").agg(F.collect_list(F.struct("item", "diag", "j0", "j1")).alias("maybe")).withColumnRenamed("key", "_k")
    # the text is not split before the join: only documents with an alignment are
    texts = docs.select(_key(id_col, text_col).alias("key"), F.col(text_col).alias("_t"))
    found = tokens(texts.join(_small(maybe, _fits(met)), F.col("key").eqNullSafe(F.col("_k"))), [F.col("key"), F.col("maybe")], "_t")
    part = f"slice(r, m.diag + m.j0 + 1, m.j1 - m.j0 + {width})"
    there = found.select("key", F.explode(F.expr(f"transform(maybe, m -> struct(m.item, m.diag, m.j0, m.j1, {part} AS part))")).alias("m")).select("key", "m.*")
    there = there.withColumn("part", F.expr(f"transform(part, x -> {_lowered('x')})"))
    n = f"least({width}, size(w))"
    same = f"filter(sequence(j0, j1), j -> slice(part, j - j0 + 1, {n}) = slice(w, j + 1, {n}))"
    matches = there.join(_small(planned.select("item", "item_id", "w"), few), "item").select("key", "item_id", F.explode(F.expr(f"transform({same}, j -> struct(diag + j AS start, {n} AS length))")).alias("x"))
    return stage(matches.select("key", "item_id", "x.start", "x.length").distinct(), "matches")


def judged(docs: DataFrame, items: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of *docs*: ``row__`` (its columns *keep*), n_words, n_hit, n_items, items (those with a name) and contaminated."""
    found = phrase_matches(docs, items, id_col, text_col)
    hits = stage(
        found.groupBy(F.col("key").alias("_k")).agg(
            F.expr("cast(size(array_distinct(flatten(collect_list(sequence(start, start + length - 1))))) AS bigint)").alias("_hit"),
            F.array_distinct(F.collect_list(F.struct(F.col("item_id").cast("string").alias("s")))).alias("_of"),
        ), "hits"
    )
    few = _fits(hits, "aggregate(_of, 0L, (a, x) -> a + 24 + coalesce(octet_length(x.s), 0))")
    rows = docs.select(packed(docs, keep), _key(id_col, text_col).alias("_key"), F.expr(f"cast(regexp_count(coalesce(`{text_col}`, ''), '{_WORD}') AS bigint)").alias("n_words"))
    return (
        rows.join(_small(hits, few), F.col("_key").eqNullSafe(F.col("_k")), "left")
        .select(
            "row__", "n_words", F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"), F.expr("cast(coalesce(size(_of), 0) AS bigint)").alias("n_items"),
            F.expr("coalesce(array_sort(array_compact(transform(_of, x -> x.s))), cast(array() AS array<string>))").alias("items"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select("row__.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    return judged(docs, table(spark, sf_dir, "benchmark"), docs.columns).where("NOT contaminated").select("row__.*")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g, least(len(w), {WINDOW}) AS l
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT l FROM q),
p AS (
  SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)
), m AS (SELECT rid, item_id, i, q.l FROM p JOIN q ON p.l = q.l AND p.g = q.g),
h AS (SELECT rid, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS x FROM m) GROUP BY rid),
k AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {MIN_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
