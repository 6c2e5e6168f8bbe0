import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = "lorem ipsum dolor sit amet " * 4000
    data = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "One", "en", None), (5, long, "en", "b"),
        (6, "Same words here again and again", "en", "a"), (6, "Same words here again and again", "en", "a"), (7, "SAME words here again and again", "de", "b"),
        (None, "no key at all", "en", "a"), (8, "mail me at jo.doe@mail.example.com or +1 (555) 123-4567 12 34", "en", "c"), (9, "漢字 ▁ ▁▁ é  two  spaces\n\n# $ <b>", "zh", "c"),
    ]
    extra = "1L AS key, 2L AS fp, 'x' AS _size, 'y' AS place, 3 AS bucket, 'z' AS _kept_id, 4L AS rid, 'q' AS print, 5 AS n, 6 AS size, 'h' AS host, 7 AS _shard, 8 AS c0"
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "CAST(length(text) AS long) AS n_chars", *[e.strip() for e in extra.split(",")])


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
