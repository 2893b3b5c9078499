"""A training-data pipeline over `documents`: each stage keeps, cuts or draws rows and hands them on.

Stages take and return the columns of `documents` (others ride along); the last one returns the mix. Every row is
judged by itself, whether its doc_id is null, repeated or neither: doc_id only says which row of a group of similar
ones stays (the smallest, null last, then a hash of the row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import contamination, jaccard, mixing, quality, secrets
from lexmill.llm.tables import checkpointed, free_name, n_rows, read, shared_folder


#: Rows (two numbers each) that are broadcast at most.
MAX_SENT = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows the one with the smallest doc_id stays, once; rows without words are in no group.

    Rows are told apart by two hashes of all columns, so only rows equal in all of them count as one. How often the row
    that stays is there is counted without the texts; only rows that are there more than once are gathered. Up to MAX_SENT
    rows that go (two numbers each) are sent to the texts; of more, both are shuffled.
    """
    row, check = free_name(docs, "row"), free_name(docs, "check")
    keyed = docs.withColumns({name: F.xxhash64(F.lit(i), *docs.columns) for i, name in enumerate((row, check))})
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = keyed.where(has_words)
    texts = some.select(F.col(row).alias("doc_id"), "text")
    found = jaccard.jaccard(texts).select(F.col("doc_id").alias("row"), "component_id").distinct()
    rows = checkpointed(some.groupBy(F.col(row).alias("row"), F.col(check).alias("check"), "doc_id").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row", "check", "n")
    first = rows.join(found, "row").groupBy("component_id").agg(F.min(order).alias("first"))
    first = checkpointed(first.select("first.row", "first.check", "first.n"))
    named = lambda df: df.select(F.col("row").alias(row), F.col("check").alias(check))
    gone = checkpointed(named(rows.join(first.where("n = 1"), ["row", "check"], "left_anti")))
    again = named(first.where("n > 1"))
    sent = lambda df: F.broadcast(df) if n_rows(df) <= MAX_SENT else df
    kept = some.join(sent(gone), [row, check], "left_anti")
    if not again.isEmpty():
        kept = kept.unionByName(some.join(sent(again), [row, check], "left_semi").dropDuplicates([row, check]))
    return kept.unionByName(keyed.where(~has_words)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold benchmark passages go."""
    return contamination.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the rows with their texts, their source's numbers, the words taken and the slots that take them."""
    return mixing.mixed_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: The stages fit models, join by hashes and order by hashes, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet and read again for the next."""
    folder = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
