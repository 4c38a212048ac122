import pytest

from keelstone.llm.registry import vocabulary

LONG = "word " * 20_000 + "x" * 3000


@pytest.fixture(scope="session")
def byte_json():
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def ranks():
    return vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="session")
def word_json():
    return vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, and other columns whose names operators use inside."""
    rows = [(1, "hello world, it's a <|endoftext|> test"), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "same text here for you and me"), (7, "same text here for you and me"), (7, "same text here for you and me"), (None, "no id at all"), (None, None), (8, "é́ß 文字 \x00   \U0001f600 " * 9)]
    wide = [(i, t, "a", 1.5, 7, {"k": 1}) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id bigint, text string, _fp string, score double, n_chars bigint, bucket map<string,int>").repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
