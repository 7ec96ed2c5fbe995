"""Result lists, their invariants, and a validator of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_lists(pairs: DataFrame, ids: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, column): one row for each id, its distinct matches sorted and joined by commas, or ''."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias(column))
    return ids.select("source1_entity_id").join(lists, "source1_entity_id", "left").fillna("", [column])


def invariants(matches: DataFrame, candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """(rule, violations) over lists *matches* and *candidates*; all must be zero."""
    m = matches.select("source1_entity_id", F.explode(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("id"))
    c = candidates.select("source1_entity_id", F.explode(F.filter(F.split("candidate_entity_ids", ","), lambda x: x != "")).alias("id"))

    def rule(name: str, df: DataFrame, count=F.count("*")) -> DataFrame:
        return df.agg(count.cast("long").alias("violations")).select(F.lit(name).alias("rule"), "violations")

    out = rule("missing_records", ids.join(matches, "source1_entity_id", "left_anti"))
    for part in (
        rule("unknown_records", matches.join(ids, "source1_entity_id", "left_anti")),
        rule("repeated_records", matches.groupBy("source1_entity_id").count().where("count > 1")),
        rule("wrong_prefix", m.where(~F.col("id").rlike("^S[23]-"))),
        rule("not_candidates", m.join(c, ["source1_entity_id", "id"], "left_anti")),
        rule("repeated_matches", m.groupBy("source1_entity_id", "id").count().where("count > 1")),
    ):
        out = out.unionByName(part)
    return out


def write_submission(matches: DataFrame, candidates: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """Write both lists below *folder* and return the invariants; matches count as candidates. Raises if any is violated."""
    from tessera.sources.io import write_tsv

    both = candidates.select("source1_entity_id", "id").union(matches.select("source1_entity_id", "id")).distinct()
    m, c = id_lists(matches, ids), id_lists(both, ids, "candidate_entity_ids")
    checked = invariants(m, c, ids)
    bad = [r.rule for r in checked.collect() if r.violations]  # one row for each rule
    if bad:
        raise ValueError(f"violated: {', '.join(bad)}")
    write_tsv(m.orderBy("source1_entity_id"), f"{folder}/matches")
    write_tsv(c.orderBy("source1_entity_id"), f"{folder}/candidates")
    return checked


def validate_file(spark: SparkSession, path: str, ids: DataFrame, known: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """(rule, violations) of a result file as text; *ids* has source1_entity_id, *known* the ids that exist."""
    header = f"source1_entity_id\t{column}"
    lines = spark.read.text(path).where(F.col("value") != "")
    rows = lines.where(F.col("value") != header).select(F.split("value", "\t").alias("f")).select(
        F.get("f", F.lit(0)).alias("source1_entity_id"), F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("list"), F.size("f").alias("n")
    )
    items = rows.select("source1_entity_id", F.explode(F.filter(F.split("list", ","), lambda x: x != "")).alias("id"))

    def rule(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")

    parts = [
        rule("header", spark.range(1).join(lines.where(F.col("value") == header).limit(1), how="left_anti")),
        rule("columns", rows.where("n <> 2")), rule("repeated_rows", rows.groupBy("source1_entity_id").count().where("count > 1")),
        rule("repeated_ids", items.groupBy("source1_entity_id", "id").count().where("count > 1")), rule("self_matches", items.where("id = source1_entity_id")),
        rule("wrong_prefix", items.where(~F.col("id").rlike("^S[23]-"))), rule("unknown_ids", items.join(known, "id", "left_anti")),
        rule("missing_records", ids.join(rows, "source1_entity_id", "left_anti")), rule("extra_records", rows.join(ids, "source1_entity_id", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assemble(base: DataFrame, other: DataFrame, countries: DataFrame, taken: str) -> DataFrame:
    """Rows of country *taken* from *other*, all others from *base*; *countries* has source1_entity_id and country."""
    own = countries.where(F.col("country") == taken).select("source1_entity_id")
    return base.join(own, "source1_entity_id", "left_anti").unionByName(other.join(own, "source1_entity_id", "left_semi"))
