"""Operators with exact results against brute force, on a corpus with nulls, empties, ties, repeats and long texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import common, decontaminate, fingerprint, minhash, packing, substrings
from sparkwatch.llm import text as tx
from sparkwatch.llm.components import components
from sparkwatch.llm.queries import tokenizer_path
from sparkwatch.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def labels_of(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingle_set(t))
    ids = sorted(sets)
    comp = {d: d for d in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_words_and_runs():
    import pyarrow as pa

    texts = ["a bb  ccc", None, "", " x", "y ", "a bb ccc"]
    (i, j, data, offsets), = tx.blocks(pa.array(texts))
    starts, ends, first = tx.words(data, offsets, tx.NON_SPACE)
    assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends)] == ["a", "bb", "ccc", "x", "y", "a", "bb", "ccc"] and list(first) == [0, 3, 3, 3, 4, 5, 8]
    h = tx.word_hashes(data, starts, ends)
    assert h[0] == h[5] and h[2] == h[7] and len(set(h.tolist())) == 5
    for k in (1, 2, 3, 5, 7, 20):
        r = tx.runs(np.arange(100, dtype=np.uint64) % np.uint64(50), k)
        assert len(r) == 101 - k and r[0] == r[50] if k <= 50 else True
        assert len(set(r.tolist())) == 50


def test_near_duplicates(docs, rows, empty):
    want = labels_of(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with a word changed each: most are linked through the original alone."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)]
    for i in range(150):
        w = list(words)
        w[(i * 7) % 115] = f"new{i}"
        w[(i * 7 + 60) % 115] = f"other{i}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = labels_of(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_near_duplicates_under_shared_boilerplate(spark):
    """Dense regions of texts whose boilerplate alone is below the threshold (0.75), with sparse pairs above it (0.86)."""
    boilerplate = [f"b{i}" for i in range(172)]
    tails = [[f"t{d}.{i}" for i in range(28)] for d in range(900)]
    for d in range(100, 500):
        tails[d + 400][:13] = tails[d][:13]
    rows = [(d, " ".join(boilerplate + t)) for d, t in enumerate(tails)]
    sets = [shingle_set(t) for _, t in rows]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert 0.74 < alike(sets[0], sets[1]) < 0.76 and 0.855 < alike(sets[100], sets[500]) < 0.865
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - 400 if d >= 500 else d for d in range(900)}


def test_near_duplicates_of_many_centres(spark):
    """One dense neighbourhood: 400 centres that change a block of a base text, documents that change a word or two of their centre."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    centres = []
    for c in range(400):
        w, s, k = list(base), rng.randrange(110), rng.randint(3, 10)
        w[s : s + k] = [f"c{c}.{p}" for p in range(k)]
        centres.append(w)
    rows = []
    for d in range(2400):
        w = list(centres[rng.randrange(400)])
        for p in rng.sample(range(120), rng.randint(1, 2)):
            w[p] = f"d{d}.{p}"
        rows.append((d, " ".join(w)))
    number = {}
    sets = [np.array([number.setdefault(g, len(number)) for g in shingle_set(t)]) for _, t in rows]
    held = np.bincount(np.concatenate(sets)) > 1
    at = np.cumsum(held) - 1
    there = np.zeros((len(rows), held.sum()), np.float32)
    for d, s in enumerate(sets):
        there[d, at[s[held[s]]]] = 1
    n, both = np.array([len(s) for s in sets]), there @ there.T
    comp = np.arange(len(rows))
    for a, b in zip(*np.where(np.triu(100 * both >= 85 * (n[:, None] + n - both), 1)), strict=True):
        comp[comp == max(comp[a], comp[b])] = min(comp[a], comp[b])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 1000 < len(set(comp)) < 2200
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == dict(enumerate(comp.tolist()))


def test_neighbours_across_partitions(spark):
    """A region cut by partitions' edges gives the pairs that it gives as a whole, few rows in a partition or many."""
    rows = [(r, bytes([i // 3]), i + 100 * r, 10) for r, size in enumerate((1, 2, 5, 6, 40, 3)) for i in range(size)]
    forest = spark.createDataFrame(rows, "region long, rest binary, id long, n long")
    want = {(a, b) for r in range(6) for ids in [sorted(x[2] for x in rows if x[0] == r)] for k, b in enumerate(ids) for a in ids[max(0, k - 4) : k]}
    for parts in (1, 3, 16, 50):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = minhash._pairs(forest, 4, 85, common.Scratch(spark)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert want <= {(r.a, r.b) for r in got} and all(r.a // 100 == r.b // 100 for r in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7), (101, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


ITEMS = [(1, "one two three four"), (2, None), (3, ""), (4, "..."), (5, "one"), (5, "One")]


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_contamination(spark, docs, rows, empty, limit):
    long = max((t for _, t in rows if t), key=len)
    items = ITEMS + [(6, " ".join(ITEM_WORD.findall(lower(long))[40:75])), (10, "Changed " + long[3000:3400])]
    df = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ITEM_WORD.findall(lower(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    want = {}
    for d, t in rows:
        w, hit, found = ITEM_WORD.findall(lower(t)), set(), set()
        for k, names in windows.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    found |= names
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    got = decontaminate.contamination(docs, df, most_words=limit).collect()
    assert len(got) == len(rows) and sum(r.contaminated for r in got) > 2
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]
    left = decontaminate.clean(docs, df, most_words=limit)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in rows if not want[d][4])
    assert decontaminate.contamination(empty, df, most_words=limit).count() == 0
    assert decontaminate.contamination(docs, df.limit(0), most_words=limit).filter("contaminated").count() == 0


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 9000, "chunk_windows": 500}, {"depth": 1, "load": 1, "block_bytes": 9000}])
def test_remove_repeats(docs, rows, empty, sizes):
    first, words = {}, {}
    for d, t in rows:
        w = words.setdefault((d, t), WORD.findall(t or ""))
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (d, s)), (d, s))
    want = {}
    for (d, t), w in words.items():
        gone = {x for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (d, s) for x in range(s, s + 20)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = substrings.remove_repeats(docs, **sizes).collect()
    assert len(got) == len(rows) and sum(r.n_removed > 0 for r in got) > 10
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id]
    assert substrings.remove_repeats(empty, **sizes).count() == 0
    kept = substrings.kept_texts(docs, **sizes).first()
    assert hashlib.sha256(kept.kept.encode()).hexdigest() == want[kept.doc_id][2]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizer_path()


def test_token_ids_are_the_tokenizers(tokenizer, rows):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(tokenizer), Encoder(tokenizer)
    more = ["<|endoftext|>", "a <|endoftext|> b", "\n <|endoftext|>", "it's   x\t\ty ", "  x", "é", "\x1c \x85 ²Ⅷ", "x" + " " * 5000 + "y", "\n" * 5000, "\u3000" * 3000]
    for t in [t for _, t in rows if t is not None] + more:
        assert ours.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows, empty, tokenizer):
    import zlib

    ours = Encoder(tokenizer)
    got = packing.pack_documents(docs, tokenizer).toPandas()
    ids = {d: np.append(ours.encode(t or ""), 0).astype("<u4") for d, t in rows}
    assert got.length.sum() == sum(len(ids[d]) for d, _ in rows)
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length <= 2048
    for d, g in got.drop_duplicates(["doc_id", "piece"]).groupby("doc_id"):
        g = g.sort_values("piece")
        assert list(g.piece) == list(range(len(g))) and list(g.start) == [0, *g.length.cumsum()[:-1]] and all(g.length[1:] == 2048)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_packing_of_very_long_texts(spark, tokenizer):
    """Two million blanks or line ends, or one letter two million times, are as good as any other text."""
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "ok"]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer).toPandas()
    ours = Encoder(tokenizer)
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(ours.encode(t)) + 1 for d, t in enumerate(texts)}
    assert got.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize(("low", "high"), [(3, 60), (20, 400), (100, 1900), (600, 760), (1, 2048), (683, 1024)])
def test_bin_completion_is_no_worse_than_best_fit(low, high):
    """Short, mixed and third-sized pieces: never more sequences than best fit decreasing, and close to the bound where pieces are small."""
    rng = random.Random(low)
    fewer = 0
    for _ in range(5):
        sizes = [rng.randint(low, high) for _ in range(1500)]
        bins, fit = packing.complete(sizes, 2048), packing.best_fit_decreasing(sizes, 2048)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and max(map(sum, bins)) <= 2048
        assert len(bins) <= len(fit)
        fewer += len(fit) - len(bins)
        if high <= 400:
            assert len(bins) <= -(-sum(sizes) // 2048) + 1
    print(low, high, fewer)


def test_completions_hold_as_many_pieces_as_fit():
    left = sorted(random.Random(2).randint(3, 40) for _ in range(400))
    found = packing.completions(left, 1500)
    assert found and all(sum(f) <= 1500 for f in found) and min(map(len, found)) > 30 and sum(found[0]) == 1500


def test_bin_completion_is_optimal_on_small_inputs():
    import itertools

    def least(sizes, capacity):
        """Fewest bins by trying every assignment."""
        best = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for r in {r for r in rooms if r >= sizes[i]}:
                rest = list(rooms)
                rest[rest.index(r)] -= sizes[i]
                place(i + 1, rest)
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return best[0]

    rng = random.Random(5)
    for _ in range(60):
        sizes = sorted((rng.randint(5, 60) for _ in range(rng.randint(0, 9))), reverse=True)
        bins = packing.complete(sizes, 100)
        assert sorted(itertools.chain(*bins)) == sorted(sizes) and all(sum(b) <= 100 for b in bins) and len(bins) == least(sizes, 100)


def test_fingerprints(spark, docs, rows, empty):
    got = {}
    for r in fingerprint.edited(docs, buckets=5).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    for k, (d, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        text = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        assert any(r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_chars == len(t) for r in got[d])
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got[d])
    of = {t: {r.fingerprint for r in got[d]} for d, t in rows}
    same = [d for d, t in rows if t and t == max(of, key=lambda x: sum(y == x for _, y in rows))]
    assert len({r.fingerprint for d in same for r in got[d]}) == 1
    assert fingerprint.edited(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert fingerprint.edited(one).first().near_next == 1.0


@pytest.mark.parametrize("ids", [[-(2**63) + 5, 2**63 - 5], [5, 5, 5], [-(2**63), *range(40), 10**15, 2**63 - 1], [7], list(range(0, 900, 3)) + [10**18]])
def test_fingerprints_of_uneven_ids(spark, ids):
    texts = [(d, f"text {i} of {d}") for i, d in enumerate(ids)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    order = sorted(texts, reverse=True)
    want = []
    for k, (d, t) in enumerate(order):
        want.append((d, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()))
    for buckets in (None, 1, 7):
        assert sorted((r.doc_id, r.edited_sha256) for r in fingerprint.edited(docs, buckets).collect()) == sorted(want)


def test_sketches_against_sets(spark, docs, rows):
    """Sketches, likeness and estimates against sets of shingles: exact up to 128 shingles, and by the definition of bottom-k beyond."""
    texts = sorted({t or "" for _, t in rows})
    pairs = spark.createDataFrame([(a, b) for a in texts[::3] for b in texts[::5]], "a string, b string")
    both = pairs.select("a", "b", fingerprint.sketch(F.col("a")).alias("x"), fingerprint.sketch(F.col("b")).alias("y"))
    got = both.select("a", "b", "x", "y", fingerprint.resemblance(F.col("x"), F.col("y")).alias("j"), fingerprint.distinct_shingles(F.col("x")).alias("n")).collect()
    exact = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := WORD.findall(t)) else set()
    for r in got:
        s, t = exact(r.a), exact(r.b)
        if len(s | t) <= 128:
            assert r.j == pytest.approx(len(s & t) / len(s | t) if s | t else 1.0) and r.n == len(s)
        k = sorted({*r.x, *r.y})[:128]
        assert r.j == pytest.approx(len([h for h in k if h in set(r.x) & set(r.y)]) / len(k) if k else 1.0)
        assert len(r.x) == min(128, len(s)) and r.x == sorted(r.x)


def test_sketch_estimates(spark):
    a, b = [f"a{i}" for i in range(3000)], [f"b{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(a[:2000] + b[:1000]))], "x string, y string").select(fingerprint.sketch(F.col("x")).alias("x"), fingerprint.sketch(F.col("y")).alias("y"))
    r = df.select(fingerprint.resemblance(F.col("x"), F.col("y")).alias("j"), fingerprint.containment(F.col("x"), F.col("y")).alias("c"), fingerprint.distinct_shingles(F.col("x")).alias("n")).first()
    assert abs(r.j - 0.5) < 0.15 and abs(r.c - 0.667) < 0.2 and abs(r.n / 2996 - 1) < 0.3
    rows = df.select(F.lit(1).alias("k"), F.explode(F.array("x", "y")).alias("sketch"))
    both = fingerprint.merge_all(rows, ["k"]).first().sketch
    assert both == df.select(fingerprint.merge(F.col("x"), F.col("y"))).first()[0] and len(both) == 128


def test_dense_tables_send_pairs_in_proportion_to_documents(spark, monkeypatch):
    """Documents that share boilerplate and differ in four words: few are linked, and the exact join confirms few pairs that aren't."""
    sent = []
    confirm = minhash._confirm
    monkeypatch.setattr(minhash, "_confirm", lambda pairs, sets, percent: sent.append(pairs.count()) or confirm(pairs, sets, percent))
    rng = random.Random(1)
    base = [f"w{i}" for i in range(68)]
    rows = [(d, " ".join([*base[:34], *[f"s{i}" if i % 4 else f"v{i}_{rng.randint(0, 19)}" for i in range(16)], *base[34:]])) for d in range(500)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == labels_of(rows) and len({c for _, c in got.values()}) > 300
    assert sum(sent[2:]) < 50 and sum(sent) < 60 * len(rows)


def test_parity_bitmaps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 80, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, np.uint64)]))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in minhash._parity(a) ^ minhash._parity(b))
        assert bits <= len(np.setxor1d(a, b)) and len(minhash._parity(a)) == minhash.PARITY
