"""The supplied tables, read with the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that a partition holds about, where one is dealt by key.
ROWS = 1_000_000
#: Bytes of an Arrow batch: texts of any length travel in batches, and a worker holds one with all that is made of it.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Shortens the session's Arrow batches to BATCH bytes, unless they are shorter already; batches of short rows stay as they are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; only the columns that a plan uses reach the scan."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shares(df: DataFrame) -> int:
    """Partitions for a table's rows: as many as the session's and at least one for every ROWS."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // ROWS))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, in ``shares`` partitions: what is grouped, numbered or joined by more keys than these stays where it is, and a task's share does not grow with the table."""
    return df.repartition(shares(df), *keys)
