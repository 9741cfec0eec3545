import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing column names."""
    base = "the quick brown fox jumps over the lazy dog and then runs home again"
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, " \t\n", None, 3), (4, base, "y", None), (4, base, "y", None),
            (5, base.upper(), "y", 5), (6, base + " now", "y", 6), (None, base, "z", 7), (None, None, None, None),
            (7, "one", "y", 8), (8, "Été à la plage, déjà vu! " * 3, "y", 9), (9, "two words", "y", 10),
            (10, " ".join(f"w{i % 977}x{i % 13}" for i in range(30000)), "y", 11), (11, "\x00a\x85b c", "y", 12)]
    return spark.createDataFrame(
        [(i, t, a, n, a, n, a, n, a, n) for i, t, a, n in rows],
        "doc_id long, text string, id string, fp long, key string, size long, a string, b long, "
        "start string, shard long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
