"""From raw documents to packed training sequences, in five stages that each apply one corpus operator.

Every stage takes what the one before kept, written as Parquet in the shared folder and read again. All but
the last return the columns of ``documents``. Different texts of one id are judged apart; of equal rows the near-duplicate
stage keeps one. Rows without an id are never dropped, as no decision can be joined to them. Columns beyond those used
pass through unchanged, whatever their names. An empty table passes every stage and gives no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import decontaminate, language, near_dedup, packing, secret_scan
from asofkit.llm.common import materialised, row_key, table


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that decisions are joined on, and its name: the id, or a hash where an id has several texts."""
    name = "decided"
    while name in docs.columns:
        name += "_"
    texts = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(row_key()).alias("a"), F.max(row_key()).alias("b"))
    several = materialised(texts.filter("a <> b").select("doc_id"), "several-texts")
    if several.isEmpty():
        return docs.withColumn(name, F.col("doc_id")), name
    apart = docs.join(several, "doc_id", "left_semi").withColumn(name, F.xxhash64("doc_id", "text"))
    return docs.join(several, "doc_id", "left_anti").withColumn(name, F.col("doc_id")).unionByName(apart), name


def asked(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), "text")


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    held = docs.join(dropped.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
    return held.select(*(F.col(f"`{c}`") for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the labelled ones have go: no letters, or hardly any common substring."""
    rows, key = keyed(docs)
    judged = materialised(language.languages(asked(rows, key), docs), "languages")
    return without(rows, key, judged.filter(language.rejected())).drop(key)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest id stays; shingles are of five words."""
    rows, key = keyed(docs)
    groups = materialised(near_dedup.near_duplicates(asked(rows, key), size=5), "groups")
    once = without(rows, key, groups.filter(~F.col("kept")))
    repeated = groups.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return once.drop(key)
    single = once.join(repeated.select(F.col("doc_id").alias(key)), key, "left_semi").dropDuplicates([key])
    return without(once, key, repeated).unionByName(single).drop(key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark passages go."""
    rows, key = keyed(docs)
    found = decontaminate.contamination(asked(rows, key), table(spark, sf_dir, "benchmark"))
    return without(rows, key, materialised(found, "contaminated").filter("contaminated")).drop(key)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark and ``n_chars`` follows; all documents stay."""
    found = secret_scan.secrets(docs.select("doc_id", "text")).filter(F.size("all_spans") > 0)
    found = materialised(found.select("doc_id", "row_key", "all_spans").dropDuplicates(["doc_id", "row_key"]), "secrets")
    rows, hits = docs.alias("rows"), found.alias("hits")
    same = F.col("rows.doc_id").eqNullSafe(F.col("hits.doc_id")) & (row_key("rows.text") == F.col("hits.row_key"))
    spans = F.col("hits.all_spans")
    text = F.when(spans.isNull(), F.col("rows.text")).otherwise(secret_scan.redacted(F.col("rows.text"), spans))
    size = F.when(spans.isNull(), F.col("rows.n_chars")).otherwise(F.length(text).cast("long"))
    new = {"text": text, "n_chars": size}
    return rows.join(hits, same, "left").select(*(new.get(c, F.col(f"rows.`{c}`")).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens packed into sequences of 4096."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # SQL can express neither the language model nor the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
