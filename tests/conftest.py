import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import loglake as L  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = L.local_session(
        4,
        **{
            "spark.sql.shuffle.partitions": "4",
            # many small jobs: quick compilation beats peak speed
            "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def table(spark, tmp_path):
    return L.LogTable(spark, str(tmp_path / "table"))


@pytest.fixture(scope="session")
def make_logs(spark):
    """Records with ids from (id, timestamp text, overrides) rows."""
    from pyspark.sql import functions as F

    def build(rows, partitions=None):
        full = [
            (
                row_id, at, extra.get("level", "info"), extra.get("service", "api"),
                extra.get("message", f"message {row_id}"), extra.get("attributes", {}), "{}",
            )
            for row_id, at, extra in ((*row, {})[:3] for row in rows)
        ]
        df = spark.createDataFrame(
            full,
            "id long, at string, level string, service string, message string,"
            " attributes map<string,string>, attributes_json string",
        )
        if partitions:
            df = df.repartition(partitions)
        return df.withColumn("timestamp", F.to_timestamp("at")).drop("at")

    return build
