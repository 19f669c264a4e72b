"""From documents to training sequences: language ID, near-dedup, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. Nulls in lang, source and n_chars go through as they are, columns beyond those of
documents are left behind, and an empty table stays empty at every stage. Rows that repeat a doc_id are one document: near-dedup
keeps one of them (the least text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwatch.llm import decontaminate, langid, minhash, packing, pii
from sparkwatch.llm.common import materialize, small, table
from sparkwatch.llm.queries import PII_KEY, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on with it as their lang; a null or empty text, or one without a letter, is rejected."""
    return langid.relabel(docs.select(*COLUMNS), langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id, and of rows that repeat it the least text."""
    copies = materialize(minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "copies")
    left = docs.select(*COLUMNS).join(small(copies, copies.count()), "doc_id", "left_anti").select(*COLUMNS)
    repeated = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    n = repeated.count()
    if not n:
        return left
    few = small(repeated, n)
    one = left.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return left.join(few, "doc_id", "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; an empty benchmark takes none."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the text (null for a null one)."""
    return pii.pseudonymize(docs.select(*COLUMNS), PII_KEY).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of at most 2048 tokens, very long texts in several pieces."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII surrogates", personal_data),
    ("best-fit packing", pack),
]

#: Models, keyed surrogates and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
