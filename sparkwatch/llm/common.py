"""What the operators share: reading tables, cutting lineage, folds, joins of a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import BROADCAST_ROWS, Scratch, materialize, numbered, shared_dir, small

__all__ = ["BROADCAST_ROWS", "Scratch", "fold", "materialize", "numbered", "sha256_of", "shared_dir", "small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int = 3) -> Column:
    """crc32 of the id's digits, modulo k."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k))


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
