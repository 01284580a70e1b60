from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, `_id` string, kept boolean, size long, digest string, `a.b` string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghiklmnoprstuvw", k=r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, very long, repeated and tied rows; a text in many copies."""
    base, long = words(1, 120), words(2, 30_000) + " " + "x" * 9000 + "," + "é" * 5000
    texts = {
        1: "", 2: None, 3: " \n\t ", 4: base, 5: base, 6: base + " " + words(3, 5), 7: words(4, 3), 8: words(4, 3), 9: long,
        10: long, 11: "a\n\na\na <|endoftext|> İ‍漢", 12: words(5, 60),
    }
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"src{i % 3}", None, "r", i, "z", None, 7, "d", None) for i, t in texts.items()]
    rows += [rows[3], rows[3], rows[1]]  # repeated rows
    rows += [
        (None, base, None, None, None, None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    rows += [(100 + i, words(6, 80), "en", "hot", 1, "r", 1, "z", True, 1, "d", "x") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def null_docs(spark):
    return spark.createDataFrame([(None,) * 12] * 5, SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path
