"""The pipeline against brute force: what each stage must drop, keep and change."""

import hashlib
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from sparkwatch.llm import pii
from sparkwatch.llm import queries as q
from sparkwatch.llm.tokens import Encoder
from test_exact import ITEM_WORD, labels_of, lower


def test_stages(spark, tmp_path, rows):
    documents = [(d, t, "en" if d % 2 else "fr", None if d % 3 else "s", len(t or "") if d % 5 else None) for d, t in rows]  # some rows repeat
    documents += [(10**6, "write to a.b@c.example.com please now", "en", "s", 1)]
    item = next(t for _, t in rows if t and len(t.split()) > 100)
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item.split()[20:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len({d[0] for d in documents}) < len(documents)
    alive = {d[0]: d[1] for d in documents}
    seen = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == cp.COLUMNS
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(name)
        got = {r.doc_id: r.text for r in docs.collect()}
        assert len(seen) < 2 or docs.count() == len(got)
        if len(seen) == 1:
            alive = {d: t for d, t in alive.items() if any(c.isalpha() for c in t or "")}
        elif len(seen) == 2:
            labels = labels_of(list(alive.items()))
            alive = {d: t for d, t in alive.items() if labels[d][1] == d}
        elif len(seen) == 3:
            windows = [tuple(ITEM_WORD.findall(lower(item))[s : s + 10]) for s in range(20, 41)]
            holds = lambda w: any(tuple(w[i : i + 10]) in windows for i in range(len(w)))
            alive = {d: t for d, t in alive.items() if not holds(ITEM_WORD.findall(lower(t)))}
        else:
            alive = {d: pii.replace(pii._cipher(q.PII_KEY), t)[0] for d, t in alive.items()}
            assert "a.b@c.example.com" not in got[10**6]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        assert got == alive
    checksum = lambda x, t: zlib.crc32(np.append(x.encode(t), 0).astype("<u4")[:2048].tobytes())
    digest = lambda df: hashlib.sha256(str(sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())).encode()).hexdigest()
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    pieces = last.collect()
    assert {r.doc_id for r in pieces} == set(alive)
    encoder = Encoder(q.tokenizer_path())
    whole = {r.doc_id: r.ids_crc32 for r in pieces if r.piece == 0 and not any(x.doc_id == r.doc_id and x.piece for x in pieces)}
    assert len(whole) > 50 and whole == {d: checksum(encoder, alive[d]) for d in whole}
    room = Counter()
    for r in pieces:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 1
    assert digest(cp.run(spark, str(tmp_path))) == digest(last)


def test_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == cp.COLUMNS and out.count() == 0
    assert cp.run(spark, str(tmp_path)).count() == 0
