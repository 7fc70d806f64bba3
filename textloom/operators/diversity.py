"""Farthest-first selection: rows that lie as far as may be from all that are selected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.storage import drop_stash, stash

#: Farthest rows that a round looks at, of which it may take several.
POOL = 256
#: Digits to which distances are rounded, so that equal ones tie whatever batch they lie in.
DIGITS = 10


def _units(vectors: list, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == size and None not in v:
            out[k] = v
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def farthest_first(rows: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", confidence: str | None = None, pool: int = POOL) -> DataFrame:
    """Rows (rank, id, distance): k rows, each the one of greatest distance (1 - cosine) from all before it; distance is null for the first.

    The first is the row of least confidence (no column: of least id); ties go to
    the least id. Rows without an id, repeated ids after any one, and rows without
    a vector of the usual length are left out; a zero vector is at distance 1 from
    all. Fewer than k rows: all of them.

    Every row keeps its distance to the nearest selected one. A round brings that
    up to date against what the last round selected, in one pass of matrix
    products, and sends the pool of farthest rows to the driver. There the rule is
    applied among them while the best still lies beyond every row outside the
    pool, so a round selects several and the result is the greedy one's. Passes
    over the rows: one a round, not one a selection.
    """
    size = (rows.filter(F.col(embedding).isNotNull()).groupBy(F.size(embedding).alias("n")).count().orderBy(F.desc("count"), "n").first() or [0])[0]
    sure = F.col(confidence).cast("double") if confidence else F.lit(0.0)
    whole = rows.filter(F.col(vec_id).isNotNull() & (F.size(embedding) == size) & ~F.exists(embedding, lambda x: x.isNull())).select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(sure, F.lit(float("inf"))).alias("sure"))
    now = stash(whole.dropDuplicates(["id"]).withColumn("far", F.lit(float("inf"))), "distances")
    kind = now.schema["id"].dataType.simpleString()
    spark = rows.sparkSession
    first = now.orderBy("sure", "id").select("id", "v").first()
    if first is None or k < 1:
        drop_stash(now)
        return spark.createDataFrame([], f"rank int, id {kind}, distance double")
    chosen: list[tuple] = [(1, first.id, None)]
    last = [first.v]
    while len(chosen) < k:
        centres = _units(last, size)

        def nearer(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = np.round(1 - (_units(batch.column(1).to_pylist(), size) @ centres.T).max(axis=1), DIGITS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.minimum(batch.column(3).to_numpy(), away))], ["id", "v", "sure", "far"])

        after = stash(now.mapInArrow(nearer, f"id {kind}, v array<double>, sure double, far double"), "distances")
        drop_stash(now)
        now = after
        taken = {i for _, i, _ in chosen}
        top = [r for r in now.orderBy(F.desc("far"), "id").select("id", "v", "far").limit(pool + len(last)).collect()]
        whole_table = len(top) < pool + len(last)
        edge = None if whole_table else (-top[-1].far, top[-1].id)  # rows outside the pool come no earlier than this
        top = [r for r in top if r.id not in taken]
        if not top:
            break
        units = _units([r.v for r in top], size)
        far = np.array([r.far for r in top])
        free = np.ones(len(top), bool)
        last = []
        while len(chosen) < k and free.any():
            best = min(np.flatnonzero(free), key=lambda j: (-far[j], top[j].id))
            if last and edge is not None and (-far[best], top[best].id) > edge:
                break
            chosen.append((len(chosen) + 1, top[best].id, float(far[best])))
            last.append(top[best].v)
            free[best] = False
            far = np.minimum(far, np.round(1 - units @ units[best], DIGITS))
    drop_stash(now)
    return spark.createDataFrame(chosen, f"rank int, id {kind}, distance double")
