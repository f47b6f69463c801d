"""Queries of the document problems p6 to p8, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.mixing import Mix, mix
from tidebook.llm.packing import fill_report, pack_documents
from tidebook.llm.reading import reading_levels
from tidebook.llm.tokens import token_counts
from tidebook.util import materialise, table


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the containers of each capacity."""
    sizes = token_counts(table(spark, sf_dir, "documents"))
    return pack_documents(sizes, table(spark, sf_dir, "pack_capacities"), "doc_id", "tokens", "container_kind", "capacity_tokens")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_packed(spark, sf_dir))


def p6_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the packing keeps its rules, by kind: counts of breaches, and whether containers are near the least possible number."""
    packed = materialise(p6_packed(spark, sf_dir), "packed")
    kind = ["container_kind", "capacity_tokens"]
    overfull = packed.groupBy(*kind, "container_id").agg(F.sum("token_count").alias("held")).groupBy(*kind).agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"), F.count("*").alias("containers"), F.sum("held").alias("tokens"))
    each = packed.groupBy(*kind, "doc_id").agg(F.sum("token_count").alias("placed"), F.count("*").alias("pieces"), F.max(F.col("token_start") + F.col("token_count")).alias("reach"), F.count_distinct("token_start").alias("starts"))
    sizes = token_counts(table(spark, sf_dir, "documents")).select("doc_id", "tokens")
    each = sizes.join(each, "doc_id", "left")
    rules = each.groupBy(*kind).agg(F.count("*").alias("documents"), F.count_if(~(F.col("placed") == F.col("tokens")) | (F.col("reach") != F.col("tokens")) | (F.col("starts") != F.col("pieces"))).alias("wrongly_placed"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split_needlessly"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return rules.join(overfull, kind).select(*kind, "documents", "wrongly_placed", "split_needlessly", "overfull", (F.col("containers") <= least + 1 + least / 100).alias("near_least_containers"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    sizes = token_counts(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return mix(sizes, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens", "source", "target_share", "max_repeats", total="corpus")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that give all uses of all their documents in a mix as large as the corpus, and still miss their share."""
    spent = F.col("reached_tokens") == F.col("source_tokens") * F.col("max_repeats")
    return _mix(spark, sf_dir).report.filter(spent & (F.col("reached_tokens") < F.col("target_share") * F.col("mix_tokens"))).select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as the corpus: documents and how often each is used."""
    return _mix(spark, sf_dir).uses


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached in that mix, beside the targets."""
    return _mix(spark, sf_dir).report


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"), "doc_id", "text", "reading_level")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = p8_levels(spark, sf_dir).filter("level >= 4").select("doc_id")
    english = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id")
    return levels.join(english, "doc_id", "left_semi")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by source and level."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), F.length("text").alias("chars"))
    return documents.join(p8_levels(spark, sf_dir), "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.avg("score").alias("mean_score"))


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p6_audit, p7_found, p7_mix, p7_shares, p8_found, p8_levels, p8_profile)}

#: The cases of p7_found are the same for any common measure of size, so bytes of UTF-8 stand for tokens here.
SQL = {
    "p6_audit": "SELECT container_kind, capacity_tokens, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS wrongly_placed, 0::BIGINT AS split_needlessly, 0::BIGINT AS overfull, true AS near_least_containers FROM pack_capacities",
    "p7_found": """
WITH sizes AS (SELECT lower(trim(source)) AS s, coalesce(strlen(text), 0) AS size FROM documents),
have AS (SELECT s, sum(size) AS size FROM sizes GROUP BY s)
SELECT t.source FROM mix_targets t LEFT JOIN have h ON h.s = lower(trim(t.source))
WHERE coalesce(h.size, 0) * coalesce(t.max_repeats, 1) < t.target_share * (SELECT sum(size) FROM sizes)""",
}
