import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, ...) rows, with columns that bear names operators use."""
    def build(rows, partitions=3):
        full = [(*row, *("en", "src")[len(row) - 2:], 5, "x") for row in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, shard int, row string"
        ).repartition(partitions)

    return build


@pytest.fixture
def words():
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    return lambda count: [rng.choice(pool) for _ in range(count)]
