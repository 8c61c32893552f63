import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Texts -> a documents table, with a column whose name clashes with those that operators make."""

    def make(texts, ids=None, sources=None, **kw):
        ids = ids if ids is not None else range(len(texts))
        sources = sources or ["s"] * len(texts)
        rows = [(i, t, "en", s, len(t or ""), 7) for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, DOCS + ", h int").repartition(kw.get("parts", 3))

    return make
