from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    if not SF.exists():
        pytest.skip("no test tables")
    return str(SF)


@pytest.fixture(scope="session")
def documents(spark):
    """Odd documents: null and empty texts, repeats, null ids, a long word, a long text, and a clashing extra column."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "   \n\t "), (1, "The quick brown fox jumps over the lazy dog."),
        (None, "no id here"), (5, "a" * 3000), (6, "word, " * 6000), (7, "Don't <|endoftext|> É\u0130\u03a3 \x1c ½²"), (8, "the quick brown fox jumps over the lazy dog."),
        (9, "write to joe@mail.example.com or 10.0.0.1, card 4111 1111 1111 1111, +1 (988) 555-2485"), (10, "one"), (11, "two words"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens int")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
