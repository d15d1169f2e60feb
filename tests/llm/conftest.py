from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns named like what operators add or use inside
CLASHING = "score double, component_id long, size long, target double, fp long, n_words long, findings string, _size long, cid long, u long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"word{i % 700} und der" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog again and AGAIN", "en", None, None),
        (3, None, "en", "b", 0),
        (4, "", None, "b", 0),
        (5, "   \n\t ", "de", "c", None),
        (6, long, "de", "c", len(long)),
        (7, "x" * 200_000, None, "c", 200_000),
        (None, "der die das und nicht ein eine mit auf ist von zu", "de", "a", 5),
        (8, "12345 67890 !!! ###", "en", "d", 3),
        (9, "ünïcödé 😀 \x00 ▁ </s> [INST]", "fr", "d", 9),
        (9, "another text with the same id token = \"0123456789abcdef0123456789abcdef01234567\"", "en", "d", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHING.split(", "):
        name, kind = c.split()
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
