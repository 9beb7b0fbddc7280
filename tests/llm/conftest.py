import pytest

LONG = " ".join(f"word{i % 977}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and a column whose name clashes."""
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "the end of it"), (None, None), (4, LONG), (5, LONG), (6, "x" * 3000), (6, "x" * 3000), (7, " \n\t "), (8, "été 中文 😀 <|endoftext|> it's\x1cso\x85"), (9, "A B C"), (10, "w " * 500)]
    return spark.createDataFrame([(i, t, None, "src", 0, -1, True, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, kept boolean, start int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture()
def work(spark):
    from vigil.llm.shared import Workspace

    return Workspace(spark)
