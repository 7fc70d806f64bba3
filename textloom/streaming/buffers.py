"""Streams: text buffers with a safe-emit rule, server-sent events, watched folders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An open token at the end of a buffer: text that may yet become TYPE_n. Fixed value.
OPEN = re.compile(r"(?<![A-Z_0-9])[A-Z][A-Z_]*(?:_\d*)?$")
MOST_BYTES = 4096


def ready(text: str, most: int = MOST_BYTES) -> bool:
    """The buffer ends a sentence or line, or is over its size, and does not end in what may be part of a token."""
    full = len(text.encode()) > most
    return (full or text.rstrip(" ").endswith((".", "!", "?")) or text.endswith("\n")) and not OPEN.search(text)


def fold(fragments: list[str], held: str = "", most: int = MOST_BYTES) -> tuple[list[str], str]:
    """What a run of fragments emits, and what stays held."""
    out = []
    for f in fragments:
        held += f
        if held and ready(held, most):
            out.append(held)
            held = ""
    return out, held


def buffered(fragments: DataFrame, most: int = MOST_BYTES, idle: str = "10 seconds") -> DataFrame:
    """A stream of (stream_id, seq, fragment, last) as rows (stream_id, text): buffered by the rule of ``ready``, flushed at the last fragment and, unless a token is open, when idle.

    State is one string for each stream; fragments of one batch are put in
    order of seq.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        if state.hasTimedOut:
            out = [held] if held and not OPEN.search(held) else []
            if out:
                state.remove()
            else:
                state.setTimeoutDuration(wait)
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            out, held = fold(rows["fragment"].tolist(), held, most)
            if bool(rows["last"].any()):
                out += [held] if held else []
                if state.exists:
                    state.remove()
            else:
                state.update((held,))
                state.setTimeoutDuration(wait)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "text": out})

    return fragments.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, text string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def buffered_batch(fragments: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The same over a finished table: rows (stream_id, k, text)."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out, held = fold(rows.sort_values("seq", kind="stable")["fragment"].tolist(), "", most)
        out += [held] if held else []
        return pd.DataFrame({"stream_id": [key[0]] * len(out), "k": range(len(out)), "text": out})

    return fragments.groupBy("stream_id").applyInPandas(one, "stream_id string, k int, text string")


def parse_sse(frames: DataFrame, schema: str, frame: str = "frame") -> DataFrame:
    """Server-sent event frames: the event's name and its data lines, joined and parsed; [DONE] and comments have no data."""
    lines = F.split(F.col(frame), "\r?\n")
    event = F.try_element_at(F.filter(lines, lambda x: x.startswith("event:")), F.lit(1))
    data = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return frames.withColumn("event", F.trim(F.substring(event, F.lit(7), F.length(event)))).withColumn("data", F.when((data != "") & (data != "[DONE]"), F.from_json(data, schema)))


def watch_folder(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """New text files of a folder as a stream of (path, text)."""
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts of each key in windows of event time, with a watermark for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")


def drain_pending(status: DataFrame, most: int) -> DataFrame:
    """The pending documents to retry now: fewest attempts first, at most so many."""
    return status.filter(F.col("status") == "pending").orderBy("attempts", "doc_id").limit(most)
