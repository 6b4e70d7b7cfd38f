from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, salt int, size long, value string, keep_id long, cell int"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls, empty and very long texts, copies, near copies, repeated rows and clashing columns."""
    rng = random.Random(5)
    rows = []
    base = [words(rng, rng.choice([3, 30, 120, 400])) for _ in range(25)]
    for i, t in enumerate(base):
        rows.append((i, t, f"src{i % 4}"))
    for i in range(12):
        rows.append((100 + i, base[i % 5], "src0"))
        parts = base[(i % 6) + 8].split(" ")
        parts[len(parts) // 2] = f"edit{i}"
        rows.append((200 + i, " ".join(parts), "src1"))
    rows += [(300, None, "src0"), (301, "", None), (302, " \n\t", "src2"), (303, "one", None), (304, "one", "src3"), (305, "one  two", "src0"), (306, "one\ttwo", "src0")]
    rows += [(307, words(rng, 30_000, 3000), "src1"), (308, "ab" * 3000, "src2"), (309, "é漢字 <|endoftext|> x  \n y   z ", "src2")]
    rows += [(310, base[9], "src3"), (310, base[9], "src3")]
    data = [(i, t, "en", s, None if t is None else len(t), 1, None, 2, None, "x", 5, 6) for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3, "doc_id").persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unnamed(spark, tricky):
    """The same with rows that have no id."""
    more = spark.createDataFrame([(None, t, None, None, None, None, None, None, None, None, None, None) for t in ("no id here", "no id here", None, "w1 w2 w3 w4 w5 w6")], SCHEMA)
    return tricky.union(more)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(25)] + [(3, None, None), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")


def collected(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
