import random

import pytest

pytest.importorskip("tallyline.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("th", "er", "on", "an", "Re", "é", "ti")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls, empty and blank texts, a very long one, repeated rows, copies and passages that several share."""
    rng = random.Random(7)
    shared, long = prose(rng, 40), prose(rng, 30_000)
    texts = [None, "", " \n\t ", "a", "Two words", prose(rng, 12), long, shared, f"{prose(rng, 30)} {shared} {prose(rng, 9)}", f"{shared}\n{prose(rng, 50)}", prose(rng, 200), "日本語 テキスト　全角 ՘\U000323b0 ends's", "x" * 5000]
    rows = [(i * 3 + 1, t, "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (100, rows[8][1], None, "s", 1), (None, rows[8][1], "en", "s", 2), (None, None, None, None, None), (-5, rows[10][1], "de", "s", 3)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
