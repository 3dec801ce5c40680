import pytest

LONG = "word " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and clashing extra columns."""
    rows = [(1, None, None), (2, "", "en"), (3, "   \n", "en"), (4, "123 456", "en"), (5, "the quick brown fox", "en"),
            (5, "the quick brown fox", "en"), (6, "der schnelle braune fuchs", "de"), (7, LONG, "en"),
            (8, "naïve café ▁ \U0001F600 x", "fr"), (9, "the quick brown fox", None)]
    return spark.createDataFrame([(i, t, g, None, None if t is None else len(t), "x", 1.5, 7) for i, t, g in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 "parts string, score double, n long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
