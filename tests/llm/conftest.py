import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, rid long, n_words long, score double"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    clean = "the quick brown fox and the lazy dog went over the old stone bridge to see what was on the other side of it"
    rows = [
        (1, clean + " once more before the night fell upon the town and all of its many quiet streets and gardens near the water", "en", "a"),
        (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "fr", None), (None, "no id here", "en", "a"), (6, clean, None, None),
        (7, "x " * 30_000, "en", "b"), (8, "tie", "en", "b"), (9, "tie", "en", "b"), (9, "tie", "en", "b"), (10, "日本語 \x00 \U0001f600 é", "ja", "c"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "k", 2, 3, 0.5) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
