import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, block int, __note string"


def corpus(seed=3, n=90):
    """Random prose with copies, near copies, shared passages, short, empty and null texts, and a very long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = say(60), say(150)
    texts = [say(rng.randint(5, 120)) for _ in range(n)]
    texts += [base] * 5 + [base.upper(), base.replace(" ", "\n", 9)]
    for i in range(8):
        w = base.split()
        w[i * 17] = "changed"
        texts.append(" ".join(w))
    texts += [f"{say(30)} {passage} {say(30)}" for _ in range(6)] + [passage + " " + passage, "x " * 300, say(9000)]
    texts += [None, "", " \t\n", "one", "one two three four", "One TWO three four", "a" * 5000, " nbsp stays inside", "漢字 かな \U0001f600"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (rows[1][0], texts[1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names the operators use themselves, and nulls in all columns but doc_id."""
    return spark.createDataFrame([(d, t, [None, "en", "fr"][d % 3], None if d % 4 else "s", None if d % 5 else 7, "w", 1, None) for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
