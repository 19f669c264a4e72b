"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark functions alone.

A sketch is the k smallest distinct 64-bit hashes of a text's five-word shingles, ascending. Sketches merge by keeping the
k smallest of both; how often the smallest of the union are in both estimates resemblance, and the k-th smallest hash says
how many shingles there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def sketch(text: Column, k: int = K, size: int = 5) -> Column:
    """The bottom-k sketch of a text: an array of longs. Fewer than `size` words are one shingle; none (or null) give an empty array."""

    def shingles(w: Column) -> Column:
        n = F.size(w)
        whole = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(n >= size, runs).otherwise(whole)

    return F.slice(F.array_distinct(F.sort_array(_let(words(text), shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of all rows of each key; each task keeps only its k smallest hashes of a key before the shuffle."""
    flat = sketches.select(*keys, F.explode(column).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    return flat.withColumn("r", rank).filter(f"r <= {k}").groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of shared among all shingles, 0 to 1; 1 for two empty sketches."""

    def share(u: Column) -> Column:
        return F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_let(merge(a, b, k), share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of how many distinct shingles the text has; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * 2.0**64) / (F.element_at(a, k).cast("double") + F.lit(2.0**63)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of which share of a's shingles b has, 0 to 1; 0 for an empty a."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def hexed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sketch of each row's text (null: empty)."""
    return docs.select("doc_id", sketch(F.col("text")).alias("sketch"))


def _ranges(docs: DataFrame, buckets: int | None, bytes_each: int = 32 << 20) -> tuple[DataFrame, int]:
    """docs with the number of the range that a row's doc_id falls in (a null one: the first), and how many there are: ranges of about as many rows each.

    Spark deals the ids alone to as many ranges as their texts ask for, some `bytes_each` of text each, and tells where
    each ends. These ends are one row of arrays, eight bytes a range, that is broadcast; the plan holds none of them. They
    are searched in two steps, as there may be many.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))
    ids = docs.filter("doc_id is not null").select("doc_id").repartitionByRange(n, "doc_id")
    tops = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top")).agg(F.sort_array(F.collect_list("top")).alias("e"))  # one number a range
    ends = tops.select(F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0))).alias("e")).withColumn("step", F.floor(F.sqrt(F.size("e"))).cast("int") + 1)
    fine = F.transform(F.sequence(F.lit(0), F.floor(F.size("e") / F.col("step")).cast("int")), lambda i: F.slice("e", i * F.col("step") + 1, F.col("step")))
    cut = ends.select("step", fine.alias("fine"))
    last = F.transform(F.slice("fine", 1, F.size("fine") - 1), lambda part: F.element_at(part, -1))
    # stored, so that all that reads it sees the same ranges
    table = materialize(cut.select(F.pmod(F.size("fine"), F.lit(1)).cast("bigint").alias("__all"), F.col("step").alias("__step"), last.alias("__coarse"), F.col("fine").alias("__fine")), "ranges")
    below = lambda of: F.size(F.filter(of, lambda x: x < F.col("doc_id")))
    with_ends = docs.withColumn("__all", F.coalesce(F.pmod("doc_id", F.lit(1)), F.lit(0)).cast("bigint")).join(F.broadcast(table), "__all")
    coarse = below(F.col("__coarse"))
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(coarse * F.col("__step") + below(F.element_at("__fine", coarse + 1)))
    return with_ends.withColumn("bucket", bucket).drop("__all", "__step", "__coarse", "__fine"), n


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, own and next: (text, sketch) of each row and of the one that follows in descending doc_id (then text); the first follows the last.

    Rows are dealt to ranges of doc_id and sorted in each; where a range ends, the first row of the next one follows.
    """
    base, parts = _ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), buckets)
    both = lambda text: F.struct(text.alias("text"), sketch(text).alias("sketch"))
    tops = base.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    first = base.join(F.broadcast(tops), ["bucket", "doc_id"]).groupBy("bucket").agg(F.max("text").alias("text"))  # broadcast: a row for each bucket
    down = Window.orderBy(F.desc("bucket"))
    before = F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = tops.select("bucket", before.alias("of")).join(first, "bucket").select(F.col("of").alias("bucket"), both(F.col("text")).alias("head"))
    rows = base.select("doc_id", both(F.col("text")).alias("own"), "bucket")
    led = rows.repartition(parts, "bucket").withColumn("follows", F.lead("own").over(Window.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("own"))))
    return led.join(heads, "bucket", "left").select("doc_id", "own", F.coalesce("follows", "head").alias("next"))


def edited(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles_est, kept_share_est of each row of docs.

    A row's edited text has its last half replaced by as much of the following row's. Likeness is the estimated
    resemblance. Null texts count as empty; rows that repeat follow each other; other columns play no part; an empty table
    gives an empty result. Any doc_id goes, however far apart; a very long text is one row of one task.
    """
    rows = with_next(docs, buckets)
    half = "cast(floor(length(own.text) / 2) as int)"
    text = F.concat(F.expr(f"substring(own.text, 1, length(own.text) - {half})"), F.expr(f"substring(next.text, 1, {half})"))
    rows = rows.select("doc_id", F.length("own.text").cast("bigint").alias("n_chars"), text.alias("edited"), F.col("own.sketch").alias("sketch"), F.col("next.sketch").alias("next_sketch"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    a, b = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hexed(a).alias("fingerprint"), hexed(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, F.col("next_sketch")).alias("near_next"), distinct_shingles(a).alias("n_shingles_est"), containment(a, b).alias("kept_share_est"),
    )
