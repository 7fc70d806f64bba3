"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.storage import drop_stash, fresh_path, shared_dir, stash  # noqa: F401

#: Rows of text that one Arrow batch is cut into, so that a batch of long texts is worked off in pieces.
SLICE_BYTES = 8 << 20


#: Rows and bytes of an Arrow batch: whole texts of any length travel in batches, and JVM and worker hold one each, so these are kept short.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Shortens the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES bytes, unless they are shorter already."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; read by Spark alone, so sf_dir may be in any store that Spark reaches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; clashing extra columns go."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch with about SLICE_BYTES of text each; a single longer text makes a piece of its own."""
    n = batch.num_rows
    if batch.nbytes <= SLICE_BYTES or n <= 1:
        if n:
            yield batch
        return
    step = max(1, int(n * SLICE_BYTES / batch.nbytes))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow of a function from one piece of a batch to one batch of results; no state passes between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield function(piece)

    return df.mapInArrow(run, schema)


def unused(name: str, columns: list[str]) -> str:
    """name with as many underscores before it as make it none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def extended(schema: T.StructType, **added: str) -> T.StructType:
    """A new schema with further nullable columns; added: name to type."""
    fields = list(schema.fields)
    for name, kind in added.items():
        fields.append(T.StructField(name, T._parse_datatype_string(kind), True))
    return T.StructType(fields)
