"""Rules over a stream: hits are stateless, so a stream's hits are a batch's; counts within a time frame keep state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.scan import Library, hits, keyed


def stream_hits(events: DataFrame, library: Library, keep: list[str]) -> DataFrame:
    """rule_id and kept columns of a streaming DataFrame, for any sink."""
    return hits(events, library, keep)


def counts(found: DataFrame) -> DataFrame:
    """Hits a rule so far (complete or update mode)."""
    return found.groupBy("rule_id").agg(F.count("*").alias("hits"))


def threshold(found: DataFrame, time: str, frame: str, by: list[str], more_than: int, late: str = "10 minutes") -> DataFrame:
    """Groups with more than so many hits in a window of time. An addition: rules that count aren't part of the rule format here."""
    out = found.withWatermark(time, late).groupBy(F.window(time, frame), "rule_id", *by).agg(F.count("*").alias("hits")).filter(F.col("hits") > more_than)
    return out.select("rule_id", *by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "hits")


def by_key(events: DataFrame) -> DataFrame:
    """channel, eid, n: events so far by source (complete or update mode)."""
    return keyed(events).groupBy(F.col("__channel").alias("channel"), F.col("__eid").alias("eid")).agg(F.count("*").alias("n"))


def held_fields(events: DataFrame, document: str | None = None) -> DataFrame:
    """channel, eid, field, n: how many events so far hold each field, by source; of columns, or of the map `document`. The state has a row for each source and field."""
    if document:
        names = F.map_keys(F.map_filter(document, lambda k, v: v.isNotNull()))
    else:
        names = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in events.columns if not c.startswith("__")]))
    each = keyed(events).select(F.col("__channel").alias("channel"), F.col("__eid").alias("eid"), F.explode(names).alias("field"))
    return each.groupBy("channel", "eid", "field").agg(F.count("*").alias("n"))


def inventory(held: DataFrame) -> DataFrame:
    """channel, eid, fields: what held_fields has come to, as the decay checks take it."""
    return held.groupBy("channel", "eid").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def store(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes each batch's changed counts (update mode) to a folder of its own number; a batch that is run again writes the same place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def stored(spark: SparkSession, path: str, keys: list[str], count: str = "n") -> DataFrame:
    """The counts of a `store`: of each key what its last batch says."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(count, "batch").alias(count))


def on_hits(found: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Calls `call` with the hits of each batch that has any, and the batch's number: a number may come again after a failure, always with the same hits."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            call(batch, number)

    return found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
