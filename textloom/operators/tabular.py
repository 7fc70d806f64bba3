"""Versioned review grid: cells (row_id, col_id, version, value_json, locked, author)."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(cells: DataFrame) -> DataFrame:
    """The greatest version of each cell, by a partial maximum before the shuffle."""
    rest = [c for c in cells.columns if c not in ("row_id", "col_id")]
    return cells.groupBy("row_id", "col_id").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("row_id", "col_id", "x.*")


def versions(cells: DataFrame, row: int, col: int) -> DataFrame:
    """All versions of a cell, newest first."""
    return cells.filter((F.col("row_id") == row) & (F.col("col_id") == col)).orderBy(F.desc("version"))


def append_version(cells: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells with new values as the next versions, and the values refused: a system author over a locked cell. new: one row for each cell."""
    now = latest(cells).select("row_id", "col_id", F.col("version").alias("__v"), F.col("locked").alias("__l"))
    met = new.join(now, ["row_id", "col_id"], "left")
    refused = F.coalesce(F.col("__l"), F.lit(False)) & (F.col("author") == "system")
    accepted = met.filter(~refused).withColumn("version", F.coalesce(F.col("__v"), F.lit(0)) + 1)
    return cells.unionByName(accepted.select(*cells.columns)), met.filter(refused).drop("__v", "__l")


def condition(kind: str, parent: Column, value: str | None = None) -> Column:
    """A predicate over a parent's JSON value: equals, not_equals (true where the parent is missing), non_null, matches (strings only)."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), parent, F.lit("}")), "$.v")
    if kind == "equals":
        return F.coalesce(parent == value, F.lit(False))
    if kind == "not_equals":
        return F.coalesce(parent != value, F.lit(True))
    if kind == "non_null":
        return parent.isNotNull() & (parent != "null")
    if kind == "matches":
        return F.coalesce(parent.startswith('"') & text.rlike(value), F.lit(False))
    raise ValueError(f"unknown condition {kind!r}")


def grid(cells: DataFrame, rows: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """One row for each of rows (row_id, label), a column of latest values for each of the columns (id, name); a missing value is empty."""
    wanted = latest(cells).filter(F.col("col_id").isin([c for c, _ in columns]))
    wide = wanted.groupBy("row_id").agg(*(F.max(F.when(F.col("col_id") == c, F.col("value_json"))).alias(name) for c, name in columns))
    return rows.join(wide, "row_id", "left").fillna("", [n for _, n in columns])


def markdown(wide: DataFrame, label: str, names: list[str]) -> DataFrame:
    """A line of a Markdown table for each row."""
    return wide.select(label, F.concat(F.lit("| "), F.concat_ws(" | ", label, *names), F.lit(" |")).alias("line"))


def waves(columns: dict[str, tuple[int, str | None]]) -> list[list[str]]:
    """Columns (name -> order, parent) in waves, parents first; an unknown parent counts as none, a cycle is an error. A schema, not data."""
    depth: dict[str, int] = {}

    def of(name: str, seen: tuple[str, ...] = ()) -> int:
        if name in seen:
            raise ValueError(f"cycle at {name}")
        if name not in depth:
            parent = columns[name][1]
            depth[name] = 0 if parent not in columns else 1 + of(parent, (*seen, name))
        return depth[name]

    out: dict[int, list[str]] = defaultdict(list)
    for name in sorted(columns, key=lambda c: (columns[c][0], c)):
        out[of(name)].append(name)
    return [out[k] for k in sorted(out)]


def batches(costs: list[tuple[str, int]], budget: int) -> list[list[str]]:
    """Columns packed in order under a token budget; one that exceeds it stands alone."""
    out: list[list[str]] = []
    used = budget + 1
    for name, cost in costs:
        if used + cost > budget:
            out.append([])
            used = 0
        out[-1].append(name)
        used += cost
    return out


def verify_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations (chunk_id, start, end in bytes, quote) with an outcome: unknown_chunk, inverted, out_of_bounds, split_character, mismatch, ok."""
    met = citations.join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    data = F.encode("text", "UTF-8")
    piece = F.substring(data, F.col("start") + 1, F.col("end") - F.col("start"))
    first = lambda at: F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)
    split = F.coalesce(first(F.col("start")), F.lit(False)) | F.coalesce(first(F.col("end")), F.lit(False))
    outcome = (
        F.when(F.col("text").isNull(), "unknown_chunk").when(F.col("start") > F.col("end"), "inverted").when(F.col("end") > F.octet_length("text"), "out_of_bounds").when(split, "split_character").when(piece != F.encode("quote", "UTF-8"), "mismatch").otherwise("ok")
    )
    return met.withColumn("outcome", outcome).drop("text")


def history_of(cells: DataFrame) -> DataFrame:
    """Each version with the one before it."""
    return cells.withColumn("before", F.lag("value_json").over(Window.partitionBy("row_id", "col_id").orderBy("version")))
