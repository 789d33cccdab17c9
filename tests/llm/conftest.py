import random

import pytest

from postlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("postlake-llm-tests", master="local[8]")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


SYLLABLES = "ba do ke li mo nu pa ri so tu wa xe yo zi".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = words[k] + "q"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """Rows (doc_id, text, row, key, shard) with nulls, empty, long, tied and repeated texts; the last columns clash on purpose."""
    rng = random.Random(3)
    long = prose(rng, 20_000)
    base = prose(rng, 120)
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "One Two three"), (7, long), (8, base), (9, base), (9, base),
        (10, edited(rng, base, 1)), (11, base.upper()), (None, base + " tail"), (None, None), (12, "ünï çödé   x"), (13, "a\x00b c"),
    ]
    rows += [(100 + k, prose(rng, rng.randint(1, 300))) for k in range(40)]
    rows += [(200 + k, "same words again and again every time") for k in range(60)]
    return [(i, t, 7, "k", 0) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, `row` int, `key` string, shard int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
