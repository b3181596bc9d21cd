"""Helpers shared by the operators: written work tables and streaming over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows per Arrow batch: texts are long, so the default of 10,000 rows would be too much memory.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the Arrow operators rely on (runtime settings only)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables, below the shared folder in ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is used in local mode only; on a
    cluster that would be another folder on each machine, so it is an error there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-work-")
        context.setCheckpointDir(base)
        base = context.getCheckpointDir() or base
    return f"{base.rstrip('/')}/llm-{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends at the files."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``function`` to each Arrow batch of ``df``; batches it answers with None give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, small batches put together to ``size`` bytes or little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (batch.nbytes >= size or sum(b.nbytes for b in held) >= size):
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema."""
    return to_arrow_schema(StructType.fromDDL(schema))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]
