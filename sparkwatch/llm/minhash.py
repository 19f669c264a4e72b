"""MinHash near-duplicate detection with an LSH forest.

Each document's set of five-word shingles gets a signature of 128 minimum hashes, dealt to 16 trees of 8. A tree sorts
the signatures by its 8 hashes, over all partitions (range partitioning, so a dense region is spread too). Documents that
agree on the first three hashes form a region, and each is paired with its `width` predecessors in the region's order,
those with the longest common prefixes. So the depth adapts to the region: one of up to `width` + 1 documents is compared
as a whole at depth three; in a denser one the partners share four hashes, five, or all eight, as each cell at a deeper
prefix that still holds that few is compared as a whole in turn.

A dense region may hold links that its order doesn't show. First its hubs find most of them, one hub at a time: the
document with the most links is paired with those of the region that are in other components than it is. Then the
documents of all dense regions that still hold more than one component are joined exactly, on the rarest shingles of
their sets (prefixes, length and position bounds, which lose no pair), and only across components. So any two documents
that share a region in some tree end up right, however dense it is; two texts at the threshold share none with probability
(1 - 0.85^3)^16 = 2e-7. Every link is confirmed on the two full sets. Documents with equal sets are one node from the start,
however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch, small
from .components import components, joined

HASHES, TREES, DEPTH = 128, 16, 3
#: From so many copies a group is hot: there are few such groups for each million documents.
HOT_COPIES = 200
PER_TREE = HASHES // TREES
RARITY_BITS = 18
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, np.uint32)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each document."""
    for i, j, data, offsets in tx.blocks(column):
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, offsets, tx.NON_SPACE)
        hashes = tx.word_hashes(data, starts, ends)
        shingles, _, at = tx.doc_runs(hashes, first, k)
        for d in range(j - i):
            n = first[d + 1] - first[d]
            if 0 < n < k:
                yield tx.runs(hashes[first[d] : first[d + 1]], int(n))
            else:
                yield np.unique(shingles[at[d] : at[d + 1]])


def _signature(s: np.ndarray) -> bytes:
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024] * _MUL + _ADD).min(axis=0), out=out)
    return out.tobytes()


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n (size of its set), cls (digest of the set; null if empty), sig (the minimum hashes; null if empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, sig = [], [], []
            for s in _sets(b.column(1), k):
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(_signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "cls", "sig"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, cls binary, sig binary")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, set: the sorted 64-bit hashes of its shingles, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in _sets(b.column(1), k)], pa.binary())], ["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, set binary")


def _forest(nodes: DataFrame) -> DataFrame:
    """region (a tree and its first hashes), rest (the deeper ones), id, n: of each document in each tree."""
    at = lambda t: F.struct(
        F.xxhash64(F.lit(t), F.substring("sig", 4 * PER_TREE * t + 1, 4 * DEPTH)).alias("region"),
        F.substring("sig", 4 * (PER_TREE * t + DEPTH) + 1, 4 * (PER_TREE - DEPTH)).alias("rest"),
    )
    return nodes.select("id", "n", F.explode(F.array(*[at(t) for t in range(TREES)])).alias("x")).select("x.*", "id", "n")


#: What _neighbours says of a row: a pair (x with y), or a document (x) at the edge of a partition.
PAIR, EDGE = 0, 1
_NEIGHBOURS = "what int, region long, rest binary, x long, y long, n long"


def _predecessors(region: np.ndarray, ids: np.ndarray, n: np.ndarray, width: int, new: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of each row from `new` on and of its predecessors in the region, if their sizes allow a link."""
    rows, befores = [], []
    for w in range(1, min(width, len(region) - 1) + 1):
        i = np.arange(max(new, w), len(region))
        j = i - w
        fits = (region[i] == region[j]) & (ids[i] != ids[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        rows.append(i[fits])
        befores.append(j[fits])
    return (np.concatenate(rows), np.concatenate(befores)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _neighbours(ordered: DataFrame, width: int, percent: int, edges: bool) -> DataFrame:
    """Pairs of each document and its predecessors in its region's order; and the documents at partitions' edges if asked for.

    What stands before a partition's first rows is in another one. So up to `width` rows at either edge are given out,
    and put in order they show the pairs across.
    """

    def rows(what: int, region: np.ndarray, rest: pa.Array, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), what, np.int32)), pa.array(region), rest, pa.array(x), pa.array(y), pa.array(n)], [f.split()[0] for f in _NEIGHBOURS.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, ids, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = pa.array([], pa.binary())
        first, started = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(region)
            region, ids, n = (np.concatenate([x, batch.column(i).to_numpy()]) for x, i in ((region, 0), (ids, 2), (n, 3)))
            rest = pa.concat_arrays([rest, batch.column(1)])
            i, j = _predecessors(region, ids, n, width, old, percent)
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            yield rows(PAIR, region[i], pa.nulls(len(i), pa.binary()), a, b, n[i])
            if edges and not started:  # the head: rows of the first region, `width` at most
                first = region[0] if first is None else first
                head = np.flatnonzero(region[:width] == first)
                if len(region) >= width or len(head) < len(region):
                    started = True
                    yield rows(EDGE, region[head], rest.take(pa.array(head)), ids[head], ids[head], n[head])
            if started or not edges:
                region, ids, n, rest = region[-width:], ids[-width:], n[-width:], rest[-width:]
        if edges and len(region):
            tail = np.flatnonzero(region == region[-1])[-width:]
            yield rows(EDGE, region[tail], rest.take(pa.array(tail)), ids[tail], ids[tail], n[tail])

    return ordered.select("region", "rest", "id", "n").mapInArrow(work, _NEIGHBOURS)


def _pairs(forest: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """a, b (a < b): pairs of neighbours."""
    keys = ("region", "rest", "n", "id")
    ordered = forest.repartitionByRange(max(TREES, int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys)
    inside = scratch.write(_neighbours(ordered, width, percent, True), "neighbours")
    edge = inside.filter(f"what = {EDGE}").select("region", "rest", F.col("x").alias("id"), "n").distinct()  # a few rows of each partition
    across = _neighbours(edge.repartition("region").sortWithinPartitions(*keys), width, percent, False)
    return inside.filter(f"what = {PAIR}").unionByName(across).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, as u and v. b's set travels once for each pair, a's once for some 256."""
    n = pairs.count()
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("parts")).filter("parts > 1")
    pairs = pairs.join(small(hot, n // 256), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).select("a", "b", "part")
    leaf = sets.join(small(pairs, n), sets.doc_id == pairs.b).select("a", "part", F.lit(1).alias("role"), "b", "set")
    hubs = pairs.select("a", "part").distinct()
    hub = sets.join(small(hubs, n), sets.doc_id == hubs.a).select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "set")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            a, role, b, sets = (batch.column(i) for i in (0, 2, 3, 4))
            keep = []
            for i in range(batch.num_rows):
                s = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if not role[i].as_py():
                    mine = s.copy()
                    continue
                at = np.searchsorted(mine, s)
                both = int((mine[np.minimum(at, len(mine) - 1)] == s).sum()) if len(mine) else 0
                if 100 * both >= percent * (len(mine) + len(s) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["u", "v"])

    rows = leaf.unionByName(hub).repartition("a", "part").sortWithinPartitions("a", "part", "role", "b")
    return rows.mapInArrow(work, "u long, v long")


def _rarity(sets: DataFrame) -> np.ndarray:
    """About how many sets hold a shingle, by the first bits of its hash: an order for prefixes, so collisions cost time and no pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for x in batch.column(1):
                at = (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)
                np.add.at(counts, at, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    out = np.zeros(1 << RARITY_BITS, np.int64)
    found = sets.select("doc_id", "set").mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** RARITY_BITS rows
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


#: Longs in a set's parity bitmap: 64 bits each.
PARITY = 4


def _parity(s: np.ndarray) -> np.ndarray:
    """For each of 256 classes of hashes whether the set has an odd number of them. Two sets' bitmaps differ in no more bits than the sets differ in members."""
    odd = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(sets: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """shingle, id, n, at (from 0), short, b0 to b3 (its parity bitmap): the rarest shingles of each set, of which a linked pair shares the first that it shares.

    A pair needs percent / (100 + percent) of the sum of its sizes in common, thus percent % of either size, and of the
    smaller one even 2 * percent / (100 + percent): its first common shingle is in the one's prefix for the former and in
    the smaller one's for the latter (short).
    """
    order = sets.sparkSession.sparkContext.broadcast(rarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            parts = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(s)
                most, least = n + (-percent * n) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1
                first = s[np.lexsort((s, counts[(s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))[:most]]
                at = np.arange(len(first))
                parts.append((first.view(np.int64), np.full(len(first), i), np.full(len(first), n), at, at < least, *(np.full(len(first), b) for b in _parity(s))))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["shingle", "id", "n", "at", "short", *bits])

    bits = [f"b{k}" for k in range(PARITY)]
    return sets.select("doc_id", "set").mapInArrow(work, "shingle long, id long, n long, at long, short boolean, " + ", ".join(f"{b} long" for b in bits))


def _across(prefixes: DataFrame, comp: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes, if sizes, positions and parity bitmaps allow a link.

    A pair at the threshold differs in at most (100 - percent) / (100 + percent) of the sum of its sizes; where the bitmaps
    differ in more bits there is no link, and the join itself leaves the pair out. Of the documents with a shingle those outside its largest component are paired with all of other components, so a
    large group of linked near copies makes no pairs within itself.
    """
    bits = [f"b{k}" for k in range(PARITY)]
    rows = _named(prefixes, comp)
    groups = rows.groupBy("shingle", "component").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.count("*").alias("groups"), F.max_by("component", F.struct("m", "component")).alias("main"))
    rows = scratch.write(rows.join(groups.filter("groups > 1").select("shingle", "main"), "shingle"), "prefixes")
    cols = lambda c: [F.col(x).alias(c + x) for x in ("id", "n", "at", "short", "component", *bits)]
    minor = rows.filter("component <> main").select("shingle", *cols("p"))
    differ = " + ".join(f"bit_count(p{b} ^ q{b})" for b in bits)
    both = minor.join(rows.select("shingle", "main", *cols("q")), "shingle").filter(
        f"{100 + percent} * ({differ}) <= {100 - percent} * (pn + qn) and pcomponent <> qcomponent and 100 * least(pn, qn) >= {percent} * greatest(pn, qn) and (pn > qn or pshort) and (qn > pn or qshort)"
        f" and {100 + percent} * least(pn - pat, qn - qat) >= {percent} * (pn + qn) and (qcomponent = main or pid < qid)"
    )
    return both.select(F.col("pid").alias("a"), F.col("qid").alias("b")).distinct()


def _named(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with the component of their id: itself where it has no link."""
    return rows.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    least, greatest = F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")
    return pairs.select("a", "b", least, greatest).join(tried.select(least, greatest), ["x", "y"], "left_anti").dropDuplicates(["x", "y"]).select("a", "b")


def _star(dense: DataFrame, comp: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each dense region of several components the document with the most links, with those in other components than its own."""
    degree = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rows = _named(dense, comp)
    first = F.max_by(F.struct(F.col("id").alias("hub"), F.col("n").alias("size"), F.col("component").alias("its")), F.struct(F.coalesce("degree", F.lit(0)), -F.col("id"), F.col("n")))
    hubs = rows.join(degree, "id", "left").groupBy("region").agg(first.alias("h"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("region", "h.*")
    apart = rows.join(hubs, "region").filter(f"component <> its and 100 * least(n, size) >= {percent} * greatest(n, size)")
    return apart.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, width: int = 4, hubs: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are ASCII-lower-cased runs of anything but ASCII white space; a text of fewer than k words is one shingle; a
    null text or one without words has none, and is linked with nothing. Repeated rows and texts are one node, and so are
    different texts of one doc_id; each row of docs gets a row. Columns other than doc_id and text play no part, an
    empty table gives an empty result. `width` and `hubs` (rounds of one hub for each dense region) set how much work is
    left for the exact join, and change no result.
    """
    scratch = Scratch(docs.sparkSession)
    sigs = scratch.write(signatures(docs, k), "signatures", last=True)
    some = sigs.filter("cls is not null").groupBy("cls")
    nodes = scratch.write(some.agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"), F.count("*").alias("copies")).select("cls", F.col("x.doc_id").alias("id"), "x.n", "x.sig", "copies"), "nodes")
    forest = _forest(nodes)
    pairs = scratch.write(_pairs(forest, width, percent, scratch), "pairs")
    # only a region of more than width + 1 documents may hold links that its order doesn't show
    crowded = forest.groupBy("region").agg(F.count("*").alias("size")).filter(f"size > {width + 1}").select("region")
    crowded = scratch.write(crowded, "crowded")
    dense = scratch.write(forest.join(small(crowded, crowded.count()), "region").select("region", "id", "n"), "dense")
    ids = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(dense.select(F.col("id").alias("doc_id"))).distinct(), "ids")
    sets = scratch.write(shingle_sets(docs.select("doc_id", "text").join(small(ids, ids.count()), "doc_id", "left_semi"), k), "sets")

    links = scratch.write(_confirm(pairs, sets, percent), "confirmed")
    comp = scratch.write(components(links, scratch=scratch), "components")
    tried = pairs

    # then the hubs of dense regions, one at a time, for the documents there that are in other components
    for _ in range(hubs):
        star = scratch.write(_untried(_star(dense, comp, links, percent), tried), "star")
        new = scratch.write(_confirm(star, sets, percent), "confirmed")
        tried = tried.unionByName(star)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        comp = joined(comp, new, scratch)

    # and exactly what the hubs didn't show, in dense regions of more than one component
    rows = _named(dense.select("region", "id"), comp)
    mixed = rows.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("region")
    open_ids = scratch.write(rows.join(mixed, "region").select(F.col("id").alias("doc_id")).distinct(), "open")
    if not open_ids.isEmpty():
        some = scratch.write(sets.join(small(open_ids, open_ids.count()), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "open-sets")
        across = scratch.write(_untried(_across(_prefixes(some, _rarity(some), percent), comp, percent, scratch), tried), "across")
        new = scratch.write(_confirm(across, sets, percent), "confirmed")
        if not new.isEmpty():
            comp = joined(comp, new, scratch)

    # large groups of copies find their component through a broadcast (of a checked size), the others in a shuffle
    member = scratch.write(nodes.join(comp, "id", "left").select("cls", F.coalesce("component", "id").alias("component"), "copies"), "members", last=True)
    scratch.drop()
    hot = member.filter(f"copies > {HOT_COPIES}").select("cls", "component")
    hot = small(hot, hot.count())
    ids = sigs.select("doc_id", "n", "cls")
    cold = ids.join(hot, "cls", "left_anti").join(member.filter(f"copies <= {HOT_COPIES}").select("cls", "component"), "cls", "left")
    out = ids.join(hot, "cls").unionByName(cold)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
