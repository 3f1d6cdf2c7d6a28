import pytest

ROWS = [
    # doc_id, text, extra columns with names the operators use themselves
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "x", 1, "a"),
    (2, None, None, 2, "b"),
    (3, "", "y", None, "c"),
    (None, "A row without an id still has its own words and counts like any other one here", "z", 3, "d"),
    (4, "The quick brown fox jumps over the lazy dog near the old river bank today", "x", 4, "e"),
    (4, "The quick brown fox jumps over the lazy dog near the old river bank today", "x", 4, "e"),
    (5, "word", "w", 5, None),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen " * 4000, "v", 6, "g"),
    (7, " \t\n\x0b ", "u", 7, "h"),
    (8, "mail bob@example.com or +1 (988) 555-2485 now, ip 10.0.0.1 and 4111 1111 1111 1111 é", "t", 8, "i"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, size bigint, key string").withColumnsRenamed(
        {"size": "n_tokens"}
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
