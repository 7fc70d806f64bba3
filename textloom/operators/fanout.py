"""Work on many rows of which some fail: results and errors side by side, failures set apart, nothing done twice.

A row's work is a function of Python that may raise. Each row gives one outcome;
an error is a value of it and does not end the task. Outcomes are kept under a
digest of the content and the version of the work, so that a further run does
only what is new, what has changed and what is to be tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an error's text that are kept. Fixed value.
ERROR_CHARS = 500
OUTCOMES = "digest string, version string, result string, error string, attempts int"


def attempt(rows: DataFrame, work: Callable[[str | None], str | None], content: str = "content") -> DataFrame:
    """rows with result and error: what work makes of the content, or the name and text of what it raised (result null then). A null content is passed on as None. Columns of those names are replaced."""
    kept = rows.drop("result", "error")
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "result string, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for value in batch[content]:
                try:
                    made, failed = work(None if value is None else value), None
                except Exception as e:  # noqa: BLE001  any failure is this row's own
                    made, failed = None, f"{type(e).__name__}: {e}"[:ERROR_CHARS]
                results.append(made)
                errors.append(failed)
            yield batch.assign(result=pd.Series(results, dtype="object", index=batch.index), error=pd.Series(errors, dtype="object", index=batch.index))

    return kept.mapInPandas(run, kinds)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The last outcome of each (digest, version) under a folder; none if there is no folder."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], OUTCOMES)
    return found.groupBy("digest", "version").agg(F.max_by(F.struct("result", "error", "attempts"), "attempts").alias("x")).select("digest", "version", "x.*")


def ingest(rows: DataFrame, work: Callable[[str | None], str | None], path: str, version: str, content: str = "content", attempts: int = 3) -> DataFrame:
    """Does the work that rows still need, adds the outcomes under path, and returns rows with status, result, error and attempts.

    status: done; failed (to be tried again by the next call); quarantined
    (failed `attempts` times). Rows of equal content are worked on once. What
    version has done or quarantined is not done again, whatever else the rows
    hold, and a changed content or version is new. A null content has a digest of
    its own. Outcomes are written at the end of one job: a call that is broken
    off leaves none, and the next does its work. One writer at a time.
    """
    spark = rows.sparkSession
    keyed = rows.drop("status", "result", "error", "attempts").withColumn("digest", F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("null")))
    known = outcomes(spark, path).filter(F.col("version") == version).select("digest", F.col("error").alias("__e"), F.col("attempts").alias("__n"))
    needed = keyed.groupBy("digest").agg(F.any_value(content).alias("content")).join(known, "digest", "left").filter(F.col("__n").isNull() | (F.col("__e").isNotNull() & (F.col("__n") < attempts)))
    done = attempt(needed, work).select("digest", F.lit(version).alias("version"), "result", "error", (F.coalesce("__n", F.lit(0)) + 1).cast("int").alias("attempts"))
    done.write.mode("append").parquet(path)
    now = outcomes(spark, path).filter(F.col("version") == version).drop("version")
    status = F.when(F.col("error").isNull(), "done").when(F.col("attempts") < attempts, "failed").otherwise("quarantined")
    return keyed.join(now, "digest", "left").withColumn("status", status).drop("digest")
