import random

import pytest

#: Words and texts of the small fixtures: repeated passages, near copies, empty, blank and long texts, nulls and repeated rows.
DOCS = "doc_id long, text string, kept string, score int"


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = say(30)
    base = say(120).split()
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three"), (6, say(12)), (7, say(13))]
    rows += [(10 + i, f"{say(20)} {shared}\n{say(15)}") for i in range(5)]
    for i in range(6):
        copy = list(base)
        for _ in range(i):
            copy[rng.randrange(len(copy))] = "Other"
        rows.append((30 + i, " ".join(copy)))
    rows += [(40, " ".join(base)), (41, say(3000)), (42, "the the the " * 40), (43, "the the the " * 40 + "end"), (44, "né à " * 30), (45, "ab\x0bcd\x1cef " * 20)]
    rows += [(41, dict(rows)[41]), (None, say(40)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in corpus()], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
