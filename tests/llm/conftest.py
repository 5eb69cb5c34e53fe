import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"


#: Nulls in every column, an empty and a long text, ties and repeated rows.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog, and the cat sat down. Released under the MIT License.\nSecond line here.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog, and the cat sat down. Released under the MIT License.\nSecond line here.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog, and the cat sat down. Released under the MIT License.\nSecond line here.", "en", "a", 10),
    (3, "", "en", None, None),
    (4, None, None, "b", 0),
    (None, "no id here but some words to count and nothing else at all", "fr", "b", 3),
    (5, " \t\n ", "de", "b", 4),
    (6, "word " * 30_000 + "Ende", "de", "c", 150_004),
    (7, "é̂ ÉCOLE, naïve!! don't && 中文\x01 x", "fr", None, 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [r + ("clash", 7) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, size int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
