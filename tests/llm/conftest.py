import pytest

#: Columns beside those of documents; their names clash with what operators add or use inside.
CLASHES = ["score", "secrets", "private", "labels", "node", "part", "row", "shard", "slot", "size", "component", "kind", "n_words", "_class", "sequence_id"]


def documents(spark, rows):
    """rows: (doc_id, text)."""
    made = [(i, t, "en", "src", len(t) if t is not None else None, *[7] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))


EDGES = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a null id"), (4, "one"), (5, "same text here"), (5, "same text here"), (6, "same text here"), (7, "äöü ß 😀 " * 50), (8, "long words and more " * 5000), (9, "x" * 30000), (None, None)]


@pytest.fixture(scope="session")
def edges(spark):
    return documents(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
