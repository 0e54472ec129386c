import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, null and equal ids, and a clashing column."""
    words = [f"w{i}" for i in range(200)]
    base = " ".join(words[:80])
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (3, "x " + base.upper() + " y", "en"),
        (4, None, None),
        (5, "", "en"),
        (6, "   \n\t ", "en"),
        (7, " ".join(words[40:160]), "de"),
        (8, " ".join(words) * 20, "en"),
        (None, base, "en"),
        (9, "une école à côté é" * 9, "fr"),
        (9, "une école à côté é" * 9, "fr"),
        (10, "same id one", "en"),
        (10, "same id two", "en"),
        (11, " ".join(words[:50] + words[:50]), "en"),
        (12, "日本語 テキスト <|endoftext|> \u0000 a  b", "ja"),
    ]
    return spark.createDataFrame([(*r, 1, "s", 0.5, 7) for r in rows], "doc_id long, text string, lang string, fp int, tag string, score double, key int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id < 0")
