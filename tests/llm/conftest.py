import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, token string"


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source) of the small documents."""
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def awkward(spark, texts):
    """Real documents, and rows with nulls, empty and long texts, repeated rows and ids; ``token`` is an extra column."""
    rows = [(d, t, lang, s, len(t), "x") for d, t, lang, s in texts]
    some = rows[3][1]
    rows += [
        (9000, None, None, None, None, None),
        (9001, "", "en", "src0", 0, None),
        (9002, " \n\t", None, "", 3, "y"),
        (9003, "12 34 !!", "de", "src1", 8, "y"),
        (9004, some, "en", "src1", len(some), None),
        (9004, some, "en", "src1", len(some), None),
        (None, some, None, None, len(some), None),
        (None, "only here, without an id", "en", "rare", 24, None),
        (9005, "first line\n" + some, "en", "src2", None, "z"),
        (9006, (some + "\n") * 60, "en", "src3", None, "z"),
        (9007, "a" * 70_000 + " " + "b-" * 2_000, "en", "src3", None, "z"),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(4)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """The fixtures are small, and most of the time goes into starting tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
