import pytest

LONG = "palabra otra cosa distinta " * 12000


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, "The first document has some plain words in it, and then a few more.", "en", "a", 60),
        (1, "The first document has some plain words in it, and then a few more.", "en", "a", 60),
        (2, None, "en", "a", None),
        (3, "", None, "a", 0),
        (4, " \n\t ", "en", None, 4),
        (5, LONG, "es", "a", len(LONG)),
        (6, "The first document has some plain words in it, and then a few more.", None, None, 60),
        (7, "é" * 50 + " 日本語 \u0000 🙂 ﬁ İ", "fr", "b", 60),
        (None, "no id here at all but text", "en", "b", 5),
        (8, "token = 'abcdef0123456789abcdef' ghp_" + "a1B2" * 9, "en", "b", 70),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: "x" for c in ("fp", "cnt", "key", "node", "root", "y", "score", "kept", "held_out", "spans", "ids", "topic", "weight", "tokens", "n_tokens", "c", "w", "low", "n")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([(None, None, None), (1, None, 0), (2, 1, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
