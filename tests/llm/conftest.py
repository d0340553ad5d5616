import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a table may carry besides, under names the operators use themselves.
CLASHING = "digest string, key long, rid long, cid long, size long, copies long, bucket int, guest int, k long, tk long, ranges string, taken string, token string, sig string, y int, p double, h long, block long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null ids, texts, languages and sources, empty and white texts, a long text, ties, repeated rows, near copies, repeated passages."""
    rng = random.Random(7)
    base = [words(rng, 120) for _ in range(6)]
    near = base[0].split()
    near[60] = "edited"
    passage = words(rng, 130, 10_000)
    rows = [
        (1, base[0], "en", "a"), (2, " ".join(near), "en", "a"), (3, base[0].replace(" ", "\n", 3), "de", "b"), (4, base[1], None, "b"),
        (5, base[1], "en", None), (5, base[1], "en", None), (6, None, None, None), (7, "", "en", "a"), (8, " \n\t ", "en", "c"),
        (9, "one two three", "en", "a"), (10, "one two three", "en", "b"), (None, base[2], "en", "a"), (None, None, None, None),
        (11, words(rng, 20_000), "fr", "a"), (12, "x" * 5000, "en", "a"), (13, "é ü 日本 " * 200, "fr", "b"), (14, base[3] + " " + passage, "en", "a"),
        (15, passage + " " + base[4], "en", "b"), (16, base[5], "es", "a"), (16, base[4], "es", "a"), (17, "<|endoftext|> a <|startoftext|>", "en", "d"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_wide(spark):
    """The same with clashing columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in CLASHING.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(1).cast(kind))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
