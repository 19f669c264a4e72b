"""Tables between steps in the folder that driver and executors share, joins of a checked size, and numbers over ordered rows."""

from __future__ import annotations

import tempfile
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.ml.util import JavaMLWritable

#: Rows of ids or pairs (under 64 MB once hashed) up to which one side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode (tests) a new one is made where that is unset."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: what follows doesn't depend on executors that computed it."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables in the shared folder that can be dropped once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._dir, self._paths = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", []

    def write(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        """The table as read back; one that is `last` stays, as the result reads it."""
        path = f"{self._dir}/{'last' if last else 'step'}-{len(self._paths)}-{name}"
        df.write.parquet(path)
        self._paths.append((path, last))
        return self._spark.read.schema(df.schema).parquet(path)

    def model(self, fitted: JavaMLWritable, name: str) -> JavaMLWritable:
        """A fitted model as read back, without the summary of its training: that holds the session, which can't be sent to tasks any more once it has observed a query."""
        path = f"{self._dir}/step-{len(self._paths)}-{name}"
        fitted.write().save(path)
        self._paths.append((path, False))
        return type(fitted).load(path)

    def drop(self) -> None:
        conf = self._spark.sparkContext._jsc.hadoopConfiguration()
        for path, last in self._paths:
            if not last:
                where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        self._paths = [x for x in self._paths if x[1]]


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a counted side for broadcast if it is small; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def before(parts: DataFrame, part: str, *sums: str) -> DataFrame:
    """part and, for each of `sums`, its total over all smaller parts. parts holds one row for each partition or file, and is added up on the driver."""
    rows = sorted(parts.select(part, *sums).collect())
    out, totals = [], [type(v)() for v in rows[0][1:]] if rows else []
    for p, *values in rows:
        out.append((p, *totals))
        totals = [t + v for t, v in zip(totals, values, strict=True)]
    return parts.sparkSession.createDataFrame(out, parts.select(part, *sums).schema)


def numbered(df: DataFrame, *order: Column | str, name: str = "position", sums: dict[str, str] | None = None, scratch: Scratch | None = None, parts: int | None = None) -> DataFrame:
    """df with each row's number from 0 in this order, and for each column in `sums` (under the name given there) its total over all rows before, without one task that sees all rows.

    Rows are dealt to ranges of the order, sorted there and stored with their place in their range; the ranges' row
    counts and totals are added up. Rows that tie in all of `order` are numbered in the table's order, and are split over
    ranges however many they are. The table is stored in `scratch` as a last one. Nulls count as 0.
    """
    own, sums = scratch or Scratch(df.sparkSession), sums or {}
    keys = [*order, "__tie"]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, *keys) if parts else tied.repartitionByRange(*keys)
    stored = own.write(dealt.sortWithinPartitions(*keys).drop("__tie").withColumn("__id", F.monotonically_increasing_id()), "ordered", last=True)
    # monotonically_increasing_id: the partition's number above 33 bits of the row's number in it
    rows = stored.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1))
    totals = rows.groupBy("__part").agg(F.count("*").alias("__first"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__all_{c}") for c in sums])
    starts = before(totals, "__part", "__first", *[f"__all_{c}" for c in sums])
    out = rows.join(F.broadcast(starts), "__part")  # broadcast: a row for each range
    if sums:
        so_far = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({new: F.col(f"__all_{c}") + F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c, new in sums.items()})
    return out.select(*df.columns, (F.col("__first") + F.col("__at")).alias(name), *sums.values())
