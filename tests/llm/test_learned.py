"""Learned operators by held-out accuracy on the driver's table and by edge cases; surrogates and licences by what they must keep."""

import hashlib
import itertools
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwatch.llm import langid, licenses, pii, quality, toxicity
from sparkwatch.llm import queries as q
from sparkwatch.llm.common import fold


@pytest.fixture(scope="module")
def real(spark):
    return "/root/testdata/sf0.01"


def test_language(spark, real, docs, rows, empty):
    got = q.op5_language_id(spark, real).join(spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    model = langid.train(docs)
    out = langid.identify(docs, model).collect()
    texts = dict(rows)
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert langid.identify(empty, model).count() == 0 and {r.lang_pred for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}
    kept = langid.relabel(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in out)


def test_code_lengths_are_those_of_the_trees():
    """Code lengths against the definition, byte by byte, for two languages; bytes that neither has seen, and a text longer than a part."""
    import pyarrow as pa

    order, said = 4, {"x": ["abracadabra banana", "barbara"], "y": ["тест banana", "", "zz"]}
    grams, counts = {}, {}
    for lang, texts in said.items():
        runs = Counter()
        counts[lang] = c = {}
        for t in texts:
            past = [10] * order + list(t.encode())
            for i in range(order, len(past)):
                runs[sum(b << 8 * k for k, b in enumerate(reversed(past[i - order : i + 1])))] += 1
                for k in range(order + 1):
                    c.setdefault(tuple(past[i - k : i]), Counter())[past[i]] += 1
        keys = np.array(sorted(runs))
        grams[lang] = keys, np.array([runs[int(k)] for k in keys], float)
    model = langid.fit(grams, order)
    assert model.langs == ["x", "y"]

    def odds(lang, context, b):
        below = odds(lang, context[1:], b) if context else 1 / 256
        seen = counts[lang].get(context, {})
        if not seen or len(context) >= 3 and sum(seen.values()) < 2:
            return below
        whole = sum(seen.values()) + len(seen)
        return seen[b] / whole if b in seen else len(seen) / whole * below

    def length(lang, text):
        past = [10] * order + list(text.encode())
        return -sum(np.log2(odds(lang, tuple(past[i - order : i]), past[i])) for i in range(order, len(past)))

    probes = ["banabra", "тест zz \x00\x7f", "", "abra" * 3]
    for t, row in zip(probes, np.concatenate(list(model.lengths(pa.array(probes)))), strict=True):
        assert np.allclose(row, [length(k, t) for k in model.langs], atol=1e-3)
    (row,), = model.lengths(pa.array(["banana abra " * 50_000]))  # over several parts
    assert np.allclose(row, [length(k, "banana abra " * 2) + 49_998 * (length(k, "banana abra " * 3) - length(k, "banana abra " * 2)) for k in model.langs], rtol=1e-5)


def test_as_many_languages_as_there_are():
    """Forty languages of an alphabet each are told apart, none of their bytes merged."""
    import pyarrow as pa

    rng = random.Random(6)
    say = lambda k: "".join(chr(0x4E00 + 30 * k + rng.randrange(30)) for _ in range(300))
    grams = {}
    for k in range(40):
        data = np.frombuffer(say(k).encode(), np.uint8)
        codes, n = np.unique(langid._grams(data, np.array([0, len(data)]), langid.ORDER)[0], return_counts=True)
        grams[f"{k:02d}"] = codes, n.astype(float)
    model = langid.fit(grams)
    found = np.concatenate(list(model.lengths(pa.array([say(k) for k in range(40)])))).argmin(axis=1)
    assert list(found) == list(range(40))


def test_toxicity(spark, real, docs, empty):
    got = q.op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert got.predicted[got.toxic == 1].mean() > 0.7 and got.predicted[got.toxic == 0].mean() < 0.01
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    assert out.count() == docs.count() and out.filter("score is null").count() == 0
    assert toxicity.score(docs, toxicity.train(empty, labels)).count() == docs.count() and toxicity.score(empty, toxicity.train(docs, labels.limit(0))).count() == 0


def test_class_prior_and_calibration_need_no_negatives():
    """Margins of two known classes: the prior and the probabilities come out right from positives and unlabelled rows alone."""
    rng = np.random.default_rng(3)
    for prior in (0.05, 0.2):
        positive = rng.normal(3, 1, 4000)
        n = int(prior * 20000)
        unlabelled = np.concatenate([rng.normal(3, 1, n), rng.normal(-2, 1, 20000 - n)])
        assert abs(toxicity.class_prior(positive, unlabelled) - prior) < 0.03
        a, b = toxicity._calibrate(positive, unlabelled, prior)
        p = 1 / (1 + np.exp(-(a * unlabelled + b)))
        assert abs(p.mean() - prior) < 0.01 and p[:n].mean() > 0.9 and p[n:].mean() < 0.02
    assert toxicity._calibrate(np.zeros(0), np.zeros(3), 0.1) == (1.0, 0.0)


def test_quality_depends_on_no_order(spark):
    """The same rows in other partitions and orders give the same scores, and the logistic fit is the minimum of its loss."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = quality.train(docs, labels)
    two = quality.train(docs.repartition(7, "source"), labels.orderBy(F.desc("doc_id")))
    assert np.array_equal(one.content.theta, two.content.theta) and np.array_equal(one.metadata.theta, two.metadata.theta) and one.share == two.share
    rng = np.random.default_rng(1)
    z, w = rng.normal(size=(300, 4)), np.ones(300)
    y = (z[:, 0] - z[:, 1] + rng.normal(size=300) > 0).astype(float)
    theta = quality._newton(z, y, w, 3.0)
    loss = lambda t: np.logaddexp(0, -(2 * y - 1) * (z @ t[:-1] + t[-1])).sum() + 1.5 * (t[:-1] ** 2).sum()
    assert all(loss(theta) <= loss(theta + 1e-3 * d) for d in np.eye(5)) and all(loss(theta) <= loss(theta - 1e-3 * d) for d in np.eye(5))


def test_content_measures_against_their_definition():
    import pyarrow as pa

    texts = ["One two two ONE!", None, "", "é" * 50 + " 1 2\n"]
    x = quality.content(pa.array(texts))
    assert x.shape == (4, quality._MEASURES + 256)
    for row, t in zip(x, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        size = max(1, len((t or "").encode()))
        assert np.isclose(row[0], np.log1p(len(words))) and np.isclose(row[2], sum(c.isupper() and c.isascii() for c in t or "") / size)
        assert np.isclose((row[quality._MEASURES :] ** 2).sum(), 1 if words else 0)
    assert np.isclose(x[0][quality._MEASURES - 3], 3 / 4)  # distinct words


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    got = q.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, None), (10, 1), (13, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels))
    assert out.count() == docs.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.train(empty, labels) is None and quality.score(docs, None).count() == docs.count() and quality.score(empty, None).count() == 0


def test_cipher_permutes_without_fixed_points():
    c = pii._cipher("key")
    for n in (2, 3, 10, 97, 500):
        out = [c.permute("x", n, i) for i in range(n)]
        assert sorted(out) == list(range(n)) and all(i != x for i, x in enumerate(out))


@pytest.mark.parametrize(("text", "pattern"), [
    ("mail a.b1@host.example.com now", r"mail [a-z]\.[a-z]\d@[a-z]{4}\.[a-z]{7}\.com now"), ("call +1 (337) 555-7349.", r"call \+1 \(\d{3}\) \d{3}-\d{4}\."),
    ("ip 10.2.3.4,", r"ip (\d{1,3}\.){3}\d{1,3},"), ("card 4952935900253052", r"card 4\d{15}"), ("ssn 123-45-6789", r"ssn \d{3}-\d{2}-\d{4}"),
    ('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', r'TOKEN = "[0-9A-F]{40}"'), ("Mr. John Smith", r"Mr\. [A-Z]\w+ [A-Z][a-z]{4}"), ("Frau Sabine Müller", r"Frau [A-Z]\w+ [A-Z]\w{5}"), ("Иван Петров", r"[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]{5}"),
])
def test_surrogates_keep_the_format(text, pattern):
    new, seen = pii.replace(pii._cipher("key"), text)
    assert re.fullmatch(pattern, new) and new != text and seen
    assert pii.replace(pii._cipher("key"), text)[0] == new and pii.replace(pii._cipher("other"), text)[0] != new


def test_surrogates_of_one_entity_agree():
    c = pii._cipher("key")
    new = pii.replace(c, "x@A.example.com X@a.EXAMPLE.com +1 (337) 555-7349 and 337-555-7349, 4952935900253052 or 4952 9359 0025 3052")[0]
    a, b, rest = new.split(" ", 2)
    digits = re.findall(r"\d", rest)
    assert a.lower() == b.lower() and digits[1:11] == digits[11:21] and digits[21:37] == digits[37:]
    assert {pii._person(c, n) for n in pii.GIVEN[("female", "latin")]} == set(pii.GIVEN[("female", "latin")])
    assert pii.entities("plain prose of 12 words, version 1.2.3 on 2024-01-05 12:30") == []


@pytest.mark.parametrize("text", ["password: correcthorsebattery", "the api_key: SecretTokenValue is set", "a hash " + "abcdef" * 6 + " here"])
def test_secrets_in_texts_without_digits(text):
    (s, e, kind), = pii.entities(text)
    new, _ = pii.replace(pii._cipher("key"), text)
    assert kind == "secret" and text[s:e] not in new and new[:s] == text[:s] and new[e:] == text[e:]


@pytest.mark.parametrize(
    "text, again",
    [
        ("Mr Schmidt called. Later Schmidt left.", ["Schmidt"] * 2),
        ("Karlsson? Sarah Karlsson wrote. Karlsson and Sarah agreed.", ["Karlsson", "Sarah", "Karlsson", "Karlsson", "Sarah"]),
        ("Frau Schmidt's car; Schmidt’s house, Schmidt-Huber, Schmidts, schmidt", ["Schmidt"] * 3),
        ("Sarah\nKarlsson and Mrs.\r\n  Weber met. Weber left.", ["Sarah", "Karlsson", "Weber", "Weber"]),
        ("Mr Schmidt\nThe day was long. The end.", ["Schmidt"]),
    ],
)
def test_bare_mentions_of_a_person(text, again):
    assert [text[s:e] for s, e, _ in pii.entities(text)] == again
    c = pii._cipher("key")
    new, seen = pii.replace(c, text)
    assert len(seen) == len(again) and not any(re.search(rf"\b{n}\b", new) for n in again)
    assert all(pii._person(c, n) in new for n in again) and len({o for _, o, _ in seen}) == len({s for _, _, s in seen}) == len(set(again))


def test_names_are_one_space_without_collisions():
    """All names of two and three letters, listed ones too: different names differ, in any case form, and none stays."""
    c = pii._cipher("k")
    for length in (2, 3):
        names = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=length)]
        new = [pii._person(c, n.capitalize()) for n in names]
        assert len(set(new)) == len(names) and all(n.capitalize() != x and x.istitle() for n, x in zip(names, new, strict=True))
    listed = {n for names in pii.GIVEN.values() for n in names}
    assert {pii._person(c, n) for n in listed} == listed and all(pii._person(c, n.upper()) == pii._person(c, n).upper() for n in listed)
    russian = ["".join(x) + e for x in itertools.product("абвои", repeat=3) for e in ("", "ов", "ова", "ский")]
    new = [pii._person(c, n.capitalize()) for n in russian]
    assert len(set(new)) == len(set(russian)) and all(x.endswith(e) for x, e in zip(new, ["", "ов", "ова", "ский"] * 125, strict=True))


@pytest.mark.parametrize("text", ["Mr John said so.\nMr JOHN left.", "Mr SCHMIDT and Mr Schmidt, Mr schmidt", "Frau Müller-Huber met O’Neil, Mrs O’Neil", "Mr İlker İ@x.com K@y.com", "ip 10.0.01.2 and 10.0.1.2, Señor Łódź", "pass: abcdefgh secret: qwertyui token: deadbeef"])
def test_spellings_of_an_entity_agree(text):
    """One entity has one surrogate however it is spelled, and none stays as it was."""
    _, seen = pii.replace(pii._cipher("k"), text)
    assert seen and all(e != x for _, e, x in seen) and len({(k, e) for k, e, _ in seen}) == len({(k, x) for k, _, x in seen}) == len(set(seen))


def test_surrogates_keep_check_digits():
    c = pii._cipher("k")
    valid = lambda iban: int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    for iban in ("DE89370400440532013000", "GB29NWBK60161331926819"):
        new = pii.surrogate(c, "iban", iban)
        assert valid(iban) and valid(new) and new[:2] == iban[:2] and new != iban
    assert not valid(pii.surrogate(c, "iban", "DE88370400440532013000"))
    secrets = ["".join(x) for x in itertools.product("afgz", repeat=4)]
    assert len({pii.surrogate(c, "secret", x) for x in secrets}) == len(secrets)


def test_planted_entities(spark):
    """Texts with planted entities against brute force: exactly those are replaced, all else stays, and one entity has one surrogate over all texts."""
    rng = random.Random(4)
    names = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize() for _ in range(40)]
    planted = [("name", f"Mrs {n}", n) for n in names] + [("name", f"Herr {n.upper()}", n.upper()) for n in names]
    planted += [("email", e, e) for e in (f"{n.lower()}@host{i % 7}.example.org" for i, n in enumerate(names))]
    planted += [("ip", x, x) for x in (f"10.{i}.{i * 5 % 256}.7" for i in range(40))] + [("ssn", x, x) for x in (f"{100 + i}-{10 + i}-{2000 + i}" for i in range(40))]
    texts, parts = [], []
    for i in range(300):
        mine = [rng.choice(planted) for _ in range(rng.randint(0, 4))]
        texts.append("start " + " and then ".join(said for _, said, _ in mine) + " end")
        parts.append(mine)
    out = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    surrogates = {}
    for i, mine in enumerate(parts):
        pattern = "start " + " and then ".join(re.escape(said[: len(said) - len(found)]) + r"(\S+)" for _, said, found in mine) + " end"
        new = re.fullmatch(pattern, out[i].text)
        assert new and out[i].n_entities == len(mine) and out[i].kinds == sorted({k for k, _, _ in mine})
        for (kind, _, found), x in zip(mine, new.groups(), strict=True):
            assert x != found and len(x) == len(found) or kind == "ip"
            assert surrogates.setdefault((kind, found.lower()), x.lower()) == x.lower()
    assert len(set(surrogates.values())) == len(surrogates) > 150


def test_pseudonymize(spark, docs, empty):
    extra = docs.withColumn("kinds", F.lit("old")).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" a@b.example.com"))).otherwise(F.col("text")))
    out = pii.pseudonymize(extra, "key")
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert out.filter("text is null").count() == extra.filter("text is null").count()
    assert out.filter(F.col("text").contains("a@b.example.com")).count() == 0 and out.filter("n_entities = 1 and kinds[0] = 'email'").count() > 10
    assert pii.pseudonymize(empty, "key").count() == 0
    bad = spark.createDataFrame([("k", b"a", b"x"), ("k", b"b", b"x"), ("k", b"c", b"y")], "kind string, entity binary, surrogate binary")
    assert pii.collisions(bad).count() == 1 and pii.collisions(pii.entity_table(extra, "key")).count() == 0


def test_licenses(spark, empty):
    files = [
        (1, "a/LICENSE", "Some words first.\nReleased under the MIT License.\n"), (2, "a/b/c/x.txt", "plain prose of a document about the version of a work"), (3, "a/b/LICENSE.md", "nothing said here"),
        (4, "a/d/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "a/d/e/y.txt", None), (6, "z.txt", "Licensed under the Apache License, Version 2.0."), (7, None, "x"), (8, "q/x.txt", ""), (8, "q/x.txt", ""),
        (9, "a/n.txt", "We licensed the software to a person under the terms of a long and very different agreement with other words."),
    ]
    df = spark.createDataFrame(files, "file long, path string, text string")
    got = {(r.file): (r.license, r.found, r.from_dir) for r in licenses.scan(df).collect()}
    assert got[1] == ("MIT", "own", None) and got[2] == ("MIT", "inherited", "a") and got[3] == ("MIT", "inherited", "a")
    assert got[4][:2] == ("GPL-3.0", "own") and got[5] == ("GPL-3.0", "inherited", "a/d") and got[6][:2] == ("Apache-2.0", "own")
    assert got[7][1] == got[8][1] == "none" and got[9] == ("MIT", "inherited", "a") and licenses.scan(df).count() == 10
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_headers_and_texts(spark):
    """Wrapped headers, headers beside a copyright line, and full texts, whole or wrapped otherwise."""
    wrap = lambda t, n, mark="": "\n".join(mark + line for part in t.split("\n\n") for line in [*textwrap.wrap(part, n), ""])
    header = "Copyright 2014 The Foo Authors. "
    files = [
        ("Apache-2.0", f"# {header}Licensed under the Apache License, Version 2.0.\nimport os\n"), ("MIT", f"// {header}Released under the MIT License. See LICENSE for details."),
        ("GPL-3.0", "/*\n" + wrap(licenses.TEMPLATES["GPL-3.0"][2], 40, " * ") + " */\nint main() {}"), ("MPL-2.0", wrap(licenses.TEMPLATES["MPL-2.0"][1], 50, "# ") + "\nx = 1"),
        ("MIT", f"The MIT License\n\n{header}\n\n" + wrap(licenses.TEMPLATES["MIT"][3], 70)), ("BSD-2-Clause", header + "\n\n" + wrap(licenses.TEMPLATES["BSD-2-Clause"][0], 70)),
        ("BSD-3-Clause", header + "\n\n" + wrap(licenses.TEMPLATES["BSD-3-Clause"][3], 60)), ("ISC", licenses.TEMPLATES["ISC"][0].lower()), (None, "The software is provided to a person under the terms of another agreement."), (None, ""), (None, "x " * 50_000),
    ]
    df = spark.createDataFrame([(i, f"{i}/x", t) for i, (_, t) in enumerate(files)], "file long, path string, text string")
    got = {r.file: r.license for r in licenses.scan(df).collect()}
    two, three = "BSD-2-Clause", "BSD-3-Clause"  # they share their first paragraph, so only the longer one is told by more than it
    assert {i: three if got[i] == three and want == two else want for i, (want, _) in enumerate(files)} == got


def test_licence_scores_against_plain_tf_idf(spark, real):
    """Scores of statements by their definition, over all files of a table and some headers."""
    docs = [(r.file, r.text) for r in licenses.document_files(spark, real).collect()][:300]
    docs += [(10**6 + i, f"Some words.\n# {t}\nmore words {i}") for i, texts in enumerate(licenses.TEMPLATES.values()) for t in texts[:1]]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    templates = {(name, i): Counter(words(t)) for name, texts in licenses.TEMPLATES.items() for i, t in enumerate(texts)}
    df = Counter(w for _, t in docs for w in set(words(t or "")))
    n = len(docs)
    weigh = lambda c: {w: k * (np.log((n + 1) / (df[w] + 1)) + 1) for w, k in c.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    vectors = {k: weigh(c) for k, c in templates.items()}
    want = {}
    for d, t in docs:
        bare = re.sub(r"(?m)^[ \t]*(?:/\*+|\*+/|//+|\*+|#+|;+|--+|%+|<!--+)?[ \t]*", "", t or "")
        paragraphs = re.split(r"\n[ \t\r]*\n", bare)
        said = {*(t or "").split("\n"), *paragraphs, *(s for p in paragraphs for s in re.split(r"(?<=[.!?;])\s+", p)), t or ""}
        for s in said:
            v = weigh(Counter(words(s)))
            score = max((sum(x * u.get(w, 0) for w, x in v.items()) / (norm(v) * norm(u)) for u in vectors.values()), default=0) if v else 0
            if score >= 0.75:
                want.setdefault(d, []).append(round(score, 6))
    got = {}
    for r in licenses.statement_licenses(spark.createDataFrame(docs, "file long, text string")).collect():
        got.setdefault(r.file, []).append(round(r.score, 6))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()} and len(want) > 20


def test_spdx_tags(spark):
    """Tags in any comment, several ids, old and new suffixes; ids that no template has are no licence, however near they are."""
    files = [
        ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint x;"), ("MIT", "/* SPDX-License-Identifier: MIT */"), ("Apache-2.0", "# SPDX-License-Identifier: (MIT OR Apache-2.0)"), ("GPL-2.0", "<!-- spdx-license-identifier: GPL-2.0-or-later-->"),
        ("GPL-2.0", "; SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0"), ("LGPL-2.1", "SPDX-License-Identifier:LGPL-2.1-only\r\nx"), (None, "# SPDX-License-Identifier: Foo"), (None, "# SPDX-License-Identifier: MIT-0"), (None, "SPDX-License-Identifier:"),
        (None, "The SPDX license identifier is a tag."), ("BSD-2-Clause", "code();" * 1000 + "// SPDX-License-Identifier: BSD-2-Clause"), (None, "# SPDX-License-Identifier: Foo\nApache-2.0 MIT"), (None, None),
    ]
    df = spark.createDataFrame([(i, f"{i}/x", t) for i, (_, t) in enumerate(files)], "file long, path string, text string")
    got = {r.file: r.license for r in licenses.scan(df).collect()}
    assert got == {i: want for i, (want, _) in enumerate(files)}


def test_long_statements_and_hot_folders(spark):
    """One line that repeats a licence hundreds of times is a statement; sides too large to be broadcast give the same rows."""
    mit = " ".join(licenses.TEMPLATES["MIT"][3].split())
    files = [(0, "LICENSE", " ".join([mit] * 200)), (1, "a/LICENSE", "Released under the MIT License."), *((i, f"a/{i % 7}/{i}.c", f"text {i}") for i in range(2, 60)), (60, "b/x.c", "y"), (61, None, "z"), (61, None, "z")]
    df = spark.createDataFrame(files, "file long, path string, text string")
    want = sorted(map(str, licenses.scan(df).collect()))
    assert sorted(map(str, licenses.scan(df, most=0).collect())) == want and len(want) == len(files)
    got = {r.file: (r.license, r.found, r.from_dir) for r in licenses.scan(df).collect()}
    assert got[0] == ("MIT", "own", None) and got[30] == ("MIT", "inherited", "a") and got[60] == ("MIT", "inherited", "") and got[61][1] == "none"


def test_native_operators_run_no_python(spark, real):
    for name in ("op6_document_fingerprints", "op7_license_scan"):
        plan = q.queries()[name](spark, real)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 12, 999, -5)], "doc_id long").select("doc_id", fold(F.col("doc_id")).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 3 for r in df.collect())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_addresses_are_found_as_by_one_pattern():
    """The search that starts where runs of an address's characters do finds what the plain pattern finds."""
    plain = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
    kind, pattern, _ = pii.PATTERNS[0]
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@-_ %+c1\n") for _ in range(rng.randint(0, 40)))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in pii._matches(kind, pattern, text)]


@pytest.mark.parametrize(
    "text,most",
    [("a" * 1_000_000 + " @ x", 1), ("a" * 1_000_000 + "@x.com", 1), ("@" * 1_000_000, 0), ("a@" + "b." * 500_000, 0), ("Mr" + " " * 1_000_000 + "x", 0), ("token = " + "Ab9" * 300_000, 1), (" ".join(f"u{i}@h{i % 97}.example.com" for i in range(100_000)), 100_000), ("John Smith " * 50_000, 100_000)],
)
def test_very_long_texts_take_time_in_proportion(text, most):
    import time

    began = time.process_time()
    found = pii.entities(text)
    assert len(found) == most and time.process_time() - began < 10


def test_long_entities_are_permuted_in_blocks():
    cipher = pii._cipher("k")
    seen = set()
    for n in (63, 64, 65, 200, 20_000):
        for kind, entity in (("secret", "0f" * n), ("secret", "Zb9" * n), ("email", "ab" * n + "@" + "c" * n + ".org"), ("name", "Q" + "abe" * n)):
            new = pii._person(cipher, entity) if kind == "name" else pii.surrogate(cipher, kind, entity)
            assert len(new) == len(entity) and new != entity and new not in seen
            assert [c.isalpha() for c in new] == [c.isalpha() for c in entity] or kind == "secret"
            seen.add(new)
    # a change in the last block alone changes no block before it, and one in the first changes all
    a, b = pii.surrogate(cipher, "secret", "0f" * 100), pii.surrogate(cipher, "secret", "0f" * 99 + "aa")
    assert a[:128] == b[:128] and a != b
    c = pii.surrogate(cipher, "secret", "aa" + "0f" * 99)
    assert all(c[i : i + 64] != a[i : i + 64] for i in range(0, 200, 64))
