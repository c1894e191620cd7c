import random

import pytest


@pytest.fixture
def texts():
    """Documents with copies, near copies, shared passages, empty, null and very long texts."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(r.randint(60, 200))) for _ in range(12)]
    out = list(base)
    for b in base[:5]:
        w = b.split()
        for _ in range(4):
            v = list(w)
            for _ in range(r.randint(0, 8)):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v))
    out += [base[6]] * 3 + [None, "", " \n\t", "a b", "A  B", "one two three four five", "é" * 700, "x" * 3000]
    passage = " ".join(word() for _ in range(120))
    out += [f"{word()} {passage} {word()}" for _ in range(3)] + [f"{passage} {word()} {passage}"]
    out.append(" ".join(word() for _ in range(20000)))
    return list(enumerate(out))


@pytest.fixture
def docs(spark, texts):
    """As a table with a clashing and an extra column and no order."""
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string").repartition(3)


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
