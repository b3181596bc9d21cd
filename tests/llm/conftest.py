import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")]
)

import pytest
from pyspark.sql.types import LongType, StringType, StructType

DATA = os.environ.get("ZONEWISE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) rows, with columns whose names operators use themselves."""

    def make(rows):
        schema = StructType().add("doc_id", LongType()).add("text", StringType())
        for name in ("row", "kept", "component_id", "score", "n_card", "shard"):
            schema = schema.add(name, StringType())
        return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], schema)

    return make


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
