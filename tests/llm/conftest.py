import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows(seed=1, n=90):
    """Invented documents: random words, exact and near copies, shared passages, odd and missing values."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, texts = words(40), []
    base = words(160)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = words(rng.randrange(60, 200))
        elif kind == 1:
            w = words(50) + passage + words(50)
        elif kind == 2:
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 3:
            w = texts[-1].split() if texts[-1] else []
        elif kind == 4:
            w = ["foo", "bar"] * rng.randrange(5, 80)
        else:
            w = words(rng.randrange(0, 12))
        text = " ".join(w)
        texts.append(text.replace(" ", "\n", 3) if rng.random() < 0.3 else text.upper() if rng.random() < 0.1 else text)
    texts += [None, "", " \n\t ", "x" * 30_000, "lone", "a b c", "a b c d e", "A B C D E", "é" * 50 + "  # $ | ok\nok\nok\n", "q " * 9_000]
    return [(i, t, "en", f"src{0 if i % 3 == 0 else i % 7}" if i % 11 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    """Every second document is labelled; documents of two words over and over are bad, nothing else is."""
    out = []
    for i, t, *_ in rows:
        if i % 2 == 0:
            w = (t or "").split()
            out.append((i, int(len(set(w)) > 2), int("foo" in w)))
    return spark.createDataFrame([*out, (None, 1, 1), (3, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
