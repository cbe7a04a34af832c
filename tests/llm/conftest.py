import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    got = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    got.sparkContext.setLogLevel("ERROR")
    return got


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, repeats, ties, a long text and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, size long, hash string, row int, score double, copies int, _id long, _digest string, keep_id long, times int"
    long = " ".join(f"w{i % 700} x{i}" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve. And here is a second sentence, long enough too.", "en", "a"),
        (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", "en", None),
        (5, "ONE two three four five six seven eight nine ten eleven twelve. And here is a second sentence, long enough too.", "en", "b"),
        (6, "one", "en", "b"), (7, "one", "en", "b"), (7, "one", "en", "b"), (None, "no id at all here", "en", "a"),
        (8, long, "en", "c"), (9, "é́ ü ß \U0001f600 " * 30, "de", "c"), (10, long + " tail", "en", "c"),
        (11, "Shared number one. " * 9, "en", "a"), (11, "Quite another text under the same number. " * 5, "en", "b"), (11, "Shared number one. " * 9, "en", "a"), (None, "no id and words of its own", "en", "b"),
        (9223372036854775807, "the largest number there is", "en", "a"), (12, "the largest number there is", "en", "a"),
    ]
    return spark.createDataFrame([(*r, 5, 1, 2, 3, "h", 4, 0.5, 9, 8, "d", 7, 6) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
