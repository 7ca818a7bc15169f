import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows, copies, and columns whose names operators use inside."""
    line = "This line stands in many documents and is long enough to count."
    rows = [
        (1, f"{line}\nown words of the first text go here and on", "en", "a", 10),
        (2, f"  {line.upper()} \nother words of the second text go here", "en", "a", 10),
        (3, f"{line}\n{line}", "en", None, None),
        (4, f"x\n{line}", None, "a", 10),
        (5, f"{line}\ny", "en", "a", 10),
        (5, f"{line}\ny", "en", "a", 10),
        (6, None, None, None, None),
        (7, "", "en", "a", 0),
        (8, " \n\t\n", "de", "b", 4),
        (None, f"{line}\nnobody's", "en", "a", 10),
        (9, "wort " * 30_000 + "ende", "de", "b", 150_004),
        (10, "é日本 ÄÖ a\x00b 🙂 <s> ▁x", "fr", "c", 20),
        (11, "same words in the same order but for the last one alpha", "en", "a", 50),
        (12, "same words in the same order but for the last one alpha", "en", "b", 50),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("n", "h", "w", "t", "sid", "key", "fp", "_k", "_p", "component_id", "cell", "v", "shard", "tok", "items", "score"):
        df = df.selectExpr("*", f"'x' AS {extra}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(hard):
    return [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
