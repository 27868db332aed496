import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, doc string, rank int"


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


def make_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, and columns
    whose names the operators use inside."""
    rng = random.Random(4)
    base = [prose(rng, n) for n in (3, 20, 60, 200, 200, 120)]
    near = base[3].replace(base[3].split()[50], "other", 1)
    texts = [
        None, "", "   \n\t ", "one", "two words", *base, base[3], near, base[1] + "\n" + base[2], "Ünïcödé 世界  \U0001f600 <|endoftext|> x\n" * 3,
        prose(rng, 5000), "x" * 5000, 'here token = "392c32d5b55f97ff33fc3fc853cf31109db4ef39" ends', base[2] + "\n" + base[2],
    ]
    rows = [(i * 3, t, None, "s", None if t is None else len(t), i, i, "d", 1) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, base[4], None, None, None, 0, 0, None, None), (None, None, None, None, None, 0, 0, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
