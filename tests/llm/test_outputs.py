"""Fill-in-the-middle, token files and importance resampling against brute force and exact round trips."""

import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import common, crc, importance, middle, tokenfile
from sparkwatch.llm import queries as q

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fim(doc_id, text, rate=50, spm=80):
    text = text or ""
    u = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    x, y = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:x]), "".join(u[x:y]), "".join(u[y:])
    if not text or any(k in text for k in middle.MARKS) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100)])
def test_middle_by_brute_force(spark, docs, rows, rate, spm):
    hard = [(10_000 + i, t) for i, t in enumerate(["<P> a <S> b", "a <M>", "<S", "x <P", " \t lead", "trail \n\n", "\x00 a\x00b\x01", "é" * 9 + " x", "� \U0001f600", "<<S <P M> >", "w " * 200_000, " ", "\x85 \x1c x"])]
    both = docs.unionByName(spark.createDataFrame(hard, "doc_id long, text string"), allowMissingColumns=True)
    made = middle.transform(both, rate=rate, spm=spm)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = middle.restore(made.withColumn("restored", F.lit(1)).withColumn("text", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((d, *fim(d, t, rate, spm)) for d, t in rows + hard)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((d, t or "") for d, t in rows + hard)
    assert rate < 100 or len({r.form for r in got}) == 2


def test_middle_marks_nulls_and_empty_tables(spark, empty):
    assert middle.restore(middle.transform(empty)).collect() == []
    for marks in (("a", "a", "b"), ("<x", "x<", "y"), ("", "b", "c"), ("<P>", "<P>>", "z")):
        with pytest.raises(ValueError):
            middle.transform(empty, marks=marks)
    odd = spark.createDataFrame([("psm", None), ("psm", "no marks"), (None, "x"), ("plain", "<P>")], "form string, output string")
    assert [r.restored for r in middle.restore(odd).collect()] == [None, None, "x", "<P>"]
    null_id = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert middle.restore(middle.transform(null_id, rate=100)).first().restored == "a b c d e f"
    other = spark.createDataFrame([(1, "a <P> b c")], "doc_id long, text string")
    made = middle.transform(other, rate=100, marks=("[p]", "[s]", "[m]"))
    assert made.first().form != "plain" and middle.restore(made, ("[p]", "[s]", "[m]")).first().restored == "a <P> b c"


def test_middle_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in q.op11_fill_in_middle(spark, sf_dir).collect():
        *head, out = fim(r.doc_id, docs[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head and r.output_sha256 == sha(out) and r.restored_sha256 == sha(docs[r.doc_id] or "")


def token_rows(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path())
    out, start = [], 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def folder_of(spark):
    return f"{common.shared_dir(spark)}/t-{uuid.uuid4().hex}"


def test_token_files_round_trip(spark, docs, rows):
    folder = folder_of(spark)
    order = [(r.doc_id, r.text) for r in docs.withColumn("i", F.monotonically_increasing_id()).orderBy("doc_id", "i").collect()]
    made = tokenfile.write(docs, folder, q.tokenizer_path(), length=128, rows=4, shard_bytes=20_000)
    assert made.count() > 1 and made.agg(F.sum("n_docs")).first()[0] == len(rows)
    want = token_rows(order)
    assert sorted(map(tuple, tokenfile.documents(spark, folder).collect()), key=lambda r: r[1]) == want
    # any sequence on its own, as a view of the mapped file
    from tokenizers import Tokenizer

    stream = [i for _, text in order for i in [*Tokenizer.from_file(q.tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 0]]
    at = 0
    before = pa.total_allocated_bytes()
    for shard in sorted(made.collect(), key=lambda r: r.shard):
        file = tokenfile.Sequences(f"{folder}/{shard.ids}")
        assert len(file) == -(-shard.n_ids // 128) and file.length == 128
        for i in random.Random(1).sample(range(len(file)), len(file)):
            ids, mask = file[i]
            real = min(128, shard.n_ids - 128 * i)
            assert len(ids) == len(mask) == 128 and not ids.flags.owndata and mask.to_pylist() == [True] * real + [False] * (128 - real) and ids.dtype == np.uint16
            assert ids[:real].tolist() == stream[at + 128 * i : at + 128 * i + real] and not ids[real:].any()
        with pytest.raises(IndexError):
            file[len(file)]
        at += shard.n_ids
    assert at == len(stream) and pa.total_allocated_bytes() - before < 1 << 20


def test_token_files_of_few_rows(spark, empty):
    folder = folder_of(spark)
    assert tokenfile.write(empty, folder, q.tokenizer_path()).count() == 0
    assert tokenfile.documents(spark, folder).collect() == []
    folder = folder_of(spark)
    few = spark.createDataFrame([(None, None), (7, ""), (7, "a b"), (-3, "x" * 70_000)], "doc_id long, text string")
    tokenfile.write(few, folder, q.tokenizer_path(), length=16, rows=2)
    assert [tuple(r) for r in tokenfile.documents(spark, folder).orderBy("start").collect()] == token_rows([(None, None), (-3, "x" * 70_000), (7, ""), (7, "a b")])
    # a manifest that says more than its files hold is found out
    ids = tokenfile.Sequences(f"{folder}/{tokenfile.manifest(spark, folder).first().ids}")
    with pytest.raises((ValueError, pa.ArrowInvalid, IndexError)):
        list(ids.spans(0, len(ids) * ids.length + 1))


def test_token_files_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    assert sorted(map(tuple, q.op12_token_files(spark, sf_dir).collect()), key=lambda r: r[1]) == token_rows(docs)


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 400_000).astype(np.uint8)
    n = np.concatenate([rng.integers(0, 70, 2000), rng.integers(0, 5000, 300), [0, 1, 63, 64, 65, 127, 128, 129, 4096, 99_968, 100_000, 200_000]])
    starts = rng.integers(0, 200_000, len(n))
    raw = data.tobytes()
    assert crc.crc32_spans(data, starts, starts + n).tolist() == [zlib.crc32(raw[s : s + k]) for s, k in zip(starts, n)]
    assert crc.crc32_spans(data, starts[:0], n[:0]).tolist() == []


def drawn(docs, target, percent, least, runs, buckets, seed=2024):
    def features(text):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]

    rows = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in rows for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, n, f in rows:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    best = sorted((-r[4], r[0], r[3]) for r in out if r[1] >= least)
    taken = Counter(best[: percent * len(best) // 100])
    return sorted(out), taken


@pytest.mark.parametrize("percent,least,runs,buckets", [(10, 20, (1, 1), 10_000), (60, 0, (1, 3), 97), (100, 1, (2, 2), 1000)])
def test_importance_by_brute_force(spark, docs, rows, percent, least, runs, buckets):
    hard = rows + [(50_001, "w" * 300_000 + " " + " ".join(["Zz9"] * 30)), (50_002, "É,É é x" * 20), (50_003, "A B c" * 9)]
    both = docs.unionByName(spark.createDataFrame(hard[len(rows) :], "doc_id long, text string"), allowMissingColumns=True)
    target = ["one two three " * 5, None, "", rows[0][1], "É x"]
    got = importance.resample(both, spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, rank int"), percent, least, runs=runs, buckets=buckets).collect()
    want, taken = drawn(hard, target, percent, least, runs, buckets)
    assert sorted(tuple(r)[:5] for r in got) == want
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, sum(taken.values()) + 1))
    assert [(-r.score, r.doc_id, r.weight) for r in ranked] == sorted(taken.elements())


def test_importance_of_empty_tables_and_null_ids(spark, docs, empty):
    assert importance.resample(empty, docs).collect() == []
    got = importance.resample(docs, empty.select("text"))
    assert got.count() == docs.count() and got.filter("rank is not null").count() == docs.filter("size(regexp_extract_all(lower(text), '([^\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+)', 1)) >= 20").count() // 10
    few = spark.createDataFrame([(None, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(r["rank"] or 0 for r in importance.resample(few, few, 100, 0).collect()) == [1, 2, 3]
