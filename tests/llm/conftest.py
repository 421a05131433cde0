import pytest
from llm_cases import EDGES
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and further columns with clashing names."""
    return spark.createDataFrame([(i, t, 1, "k", 0.5) for i, t in EDGES], "doc_id long, text string, _id int, _node string, _text double")
