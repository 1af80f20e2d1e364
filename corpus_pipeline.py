"""A training corpus from documents: filter, cut repeated lines, keep one of alike texts, decontaminate, pack."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm import decontaminate as bench
from cohortlake.llm import line_dedup, packing, quality_em, trie_join
from cohortlake.llm.shared import discard, fresh_path, partitions, scratch, table


def _recounted(docs: DataFrame, changed, columns: list[str]) -> DataFrame:
    """docs with n_chars of the texts that a stage has changed."""
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_em.classify(docs, quality_em.fit(docs)).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that had nothing else."""
    cut = line_dedup.dedup_lines(docs)
    left = cut.where("n_gone_lines = 0 OR n_gone_words < n_line_words")
    return _recounted(left, F.col("n_gone_lines") > 0, docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, of the type long: doc_id where one row has it. Rows without an id, and those of an id
    that several rows have, get keys beyond all ids, equal ones of them the same row."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    nameless = docs.where("doc_id IS NULL")
    if repeated.isEmpty() and nameless.isEmpty():
        return docs.withColumn(_KEY, F.col("doc_id").cast("long"))
    odd = nameless.unionByName(docs.join(repeated, "doc_id", "left_semi").select(docs.columns)).dropDuplicates(["doc_id", "text"])
    n = partitions(docs.sparkSession)
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(F.col("doc_id").asc_nulls_last(), "text"))
    beyond = (docs.agg(F.max(F.col("doc_id").cast("long")).alias("top")).first()["top"] or 0) + 1
    plain = docs.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").select(docs.columns)
    return plain.withColumn(_KEY, F.col("doc_id").cast("long")).unionByName(odd.withColumn(_KEY, F.lit(beyond) + (place - 1) * n + bucket))


_KEY = " key"


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of alike texts stays: that with the smallest id, rows with an id of their own first."""
    keyed = _keyed(docs)
    kept = trie_join.similar_groups(keyed, doc_id=_KEY).where("doc_id = component_id").select(F.col("doc_id").alias(_KEY))
    return keyed.join(kept, _KEY, "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; documents that are mostly such go."""
    clean = bench.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _recounted(clean, bench.n_hit() > 0, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of sequences of 2048: ids are little-endian unsigned 32-bit integers."""
    return packing.pack(docs, file=public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("trie_join", similar),
    ("decontaminate", benchmark),
    ("packing", pack),
]

#: Several stages are no SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet to the shared folder and read again. A stage's working
    tables go when it is written, its own table when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
