import pytest

from lineseek.plans.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(
        "lineseek-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus_of(spark):
    """Raw lines -> cleaned corpus lines, numbered in the given order."""
    from lineseek.sources.lines import clean

    def make(raws, path="a"):
        rows = [(path, i, i, raw) for i, raw in enumerate(raws)]
        return clean(spark.createDataFrame(rows, "path string, line_no bigint, pos bigint, raw string"))

    return make


@pytest.fixture
def write_bytes(tmp_path):
    def write(name, payload: bytes) -> str:
        target = tmp_path / name
        target.write_bytes(payload)
        return str(target)

    return write
