import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from regidx.session import build_session

    session = build_session(
        "regidx-tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of inputs."""

    def run(expression, inputs, kind="string"):
        rows = [(place, value) for place, value in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"place int, x {kind}")
        return [row.y for row in df.select("place", expression.alias("y")).orderBy("place").collect()]

    return run
