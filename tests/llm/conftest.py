import pytest


@pytest.fixture(scope="session")
def edge_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    base = "The quick brown fox jumps over the lazy dog and runs away from the very old bear in the dark forest tonight"
    rows = [
        (1, base, "en", "s1", 100),
        (1, base, "en", "s1", 100),  # the same row again
        (2, None, "en", "s1", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "en", None, 4),
        (5, "word", "en", "s2", 4),
        (6, base + " indeed", "en", "s2", 107),
        (7, "été à la plage, mail me at joe@example.com or +1 (555) 123-4567 <|endoftext|>", "fr", "s2", 60),
        (8, ("lorem ipsum dolor sit amet " * 8000).strip(), "la", "s3", 200_000),
        (None, "a row without an id", "en", "s3", 19),
        (None, None, None, None, None),
        (9, base.upper(), "en", "s1", 100),
    ]
    rows = [(*r, "id", 5, "x", 0, "t", 1, "n", 2) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, piece int, _text string, row int, node string, label int, v string, n int")
