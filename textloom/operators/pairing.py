"""One-to-one choice among scored pairs, in the order that the caller states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def one_to_one(pairs: DataFrame, key: str, order: list[Column], left: list[str], right: list[str], mark: str | None = None) -> DataFrame:
    """Of the pairs of each key, in order, every one whose left and right columns no kept pair of that key has.

    Pairs are sorted by key and order in Spark and read batch by batch: a task
    holds what is taken of one key and starts nothing for each key. Nulls are
    values like others; order must leave no ties that matter. mark: all pairs, with
    a column of that name that tells which are taken.
    """
    names = pairs.columns
    at = lambda cols: [names.index(c) for c in cols]
    k, one, two = names.index(key), at(left), at(right)

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, used = None, set(), set()
        for batch in batches:
            columns = {i: batch.column(i).to_pylist() for i in {k, *one, *two}}
            keep = []
            for i, (own, a, b) in enumerate(zip(columns[k], zip(*(columns[c] for c in one)), zip(*(columns[c] for c in two)))):
                if own != now:
                    now, taken, used = own, set(), set()
                if a not in taken and b not in used:
                    taken.add(a)
                    used.add(b)
                    keep.append(i)
            if mark:
                told = np.zeros(batch.num_rows, bool)
                told[keep] = True
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told)], names=[*names, mark])
            elif keep:
                yield batch.take(pa.array(keep, pa.int64()))

    return pairs.repartition(key).sortWithinPartitions(key, *order).mapInArrow(free, T.StructType([*pairs.schema.fields, T.StructField(mark, T.BooleanType())]) if mark else pairs.schema)
