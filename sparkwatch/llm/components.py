"""Connected components by alternating large and small stars, each round a few shuffles of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(links: DataFrame) -> DataFrame:
    """Adds m, the least v of each u. Partial minima meet in the shuffle, and the join splits a u with very many links."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return _with_least(down).select(ends.alias("l")).select("l.*").filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(u, v) links to (id, component): component is the smallest id reachable. Ids without links are left out.

    Self links and nulls are ignored; both directions and repeats are fine. Large stars move every neighbour to the
    smallest one, small stars do so among smaller neighbours; when nothing moves each link leads to its component.
    Tables between the rounds are written to `scratch`, for the caller to drop.
    """
    scratch = scratch or Scratch(links.sparkSession)

    def written(now: DataFrame) -> tuple[DataFrame, tuple]:
        """The links as read back, and what tells them from others: their number and the sum of their hashes, taken while writing."""
        seen = Observation()
        out = scratch.write(now.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        return out, (seen.get["n"], seen.get["h"])

    now, state = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds if state[0] else 0):
        now, new = written(_small(_large(now)))
        if new == state:
            break
        state = new
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) after more links: only the components that these join are worked on."""
    side = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    moved = components(between, scratch=scratch)
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    old = comp.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return scratch.write(old.unionByName(moved.join(comp, "id", "left_anti")), "components")
