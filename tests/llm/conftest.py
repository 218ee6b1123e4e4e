import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, row long, size long, level int"


def prose(rng: random.Random, n: int) -> str:
    syllables = ["ka", "lo", "mi", "ter", "an", "sol", "vi", "dra", "pe", "un"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def texts(seed: int = 3, n: int = 60) -> list[str | None]:
    """Prose with exact copies, near copies, null, empty and blank texts, a very long one, symbols and odd white space."""
    rng = random.Random(seed)
    found: list[str | None] = [prose(rng, rng.randint(60, 160)) for _ in range(n)]
    for i in range(0, n, 6):
        words = found[i].split(" ")
        words[len(words) // 2] = "changed"
        found.append(" ".join(words))
        found.append(found[i])
    return [*found, None, "", "  \n\t ", None, "", "one", "two words", prose(rng, 6000), "% | " * 80 + prose(rng, 40), "a\x1c b  c d\n\n é <|endoftext|> don't \U0001f600", "\n".join([prose(rng, 30)] * 4)]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in every column but the key, and extra columns whose names operators use themselves."""
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "web", "books", "web"][i % 4], None if t is None else len(t), "x", i, 1, 0) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def plain(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
