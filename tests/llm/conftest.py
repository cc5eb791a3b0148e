import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key long, node long, line string"


def words(rng, n):
    return [rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt".split()) + str(rng.randrange(60)) for _ in range(n)]


def make_rows(seed=3):
    """Texts with copies, near copies, shared passages, nulls, repeated rows and one very long text."""
    rng = random.Random(seed)
    rows, base = [], words(rng, 160)
    passage = " ".join(words(rng, 70))
    for i in range(60):
        w = words(rng, rng.choice([0, 1, 2, 3, 30, 120, 300]))
        kind = i % 6
        text = " ".join(w)
        if kind == 1:
            near = list(base)
            for _ in range(rng.randrange(0, 4)):
                near[rng.randrange(len(near))] = "edit" + str(rng.randrange(1000))
            text = " ".join(near)
        elif kind == 2:
            text = text + "\n" + passage + "\n" + " ".join(words(rng, 20))
        elif kind == 3:
            text = " ".join(base).upper()
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, "ß É 😀 naïve ﬁ"), (None, " ".join(base)), (5, rows[5][1]), (5, rows[5][1]), (7, "other text of a doubled id entirely")]
    rows.append((200, "\n".join(" ".join(words(rng, 50)) for _ in range(4000))))
    rng.shuffle(rows)
    return [(i, t, "en", f"s{k % 3}", len(t or ""), "x", 1, 2, "y") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
