"""Event-time windows and keyed state over capture events, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.operators.merge import merged_records, upserted


def _watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """A watermark needs a timestamp; one without a zone is taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def windows(events: DataFrame, time: str, length: str, slide: str | None = None, by: tuple[str, ...] = (), late: str | None = None, value: str | None = None) -> DataFrame:
    """Counts, and sums of ``value``, of tumbling or sliding windows; with ``late`` a watermark ends them on a stream."""
    source = _watermarked(events, time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    more = [F.round(F.sum(value), 4).alias("total")] if value else []
    made = source.where(F.col(time).isNotNull()).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), *more)
    return made.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", *(["total"] if value else []))


def sessions(events: DataFrame, time: str, gap: str, by: tuple[str, ...], late: str | None = None) -> DataFrame:
    """Sessions of each key that end after a gap."""
    source = _watermarked(events, time, late)
    made = source.where(F.col(time).isNotNull()).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return made.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each identity once within the watermark; a table needs none."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def stateful_sightings(events: DataFrame) -> DataFrame:
    """``(record_key, captured_at, decision)`` on a stream: state per key holds the last digest and the contexts seen."""
    from pyspark.sql.streaming.state import GroupState

    def decide(key, batches, state: GroupState):
        last, seen = state.get if state.exists else (None, [])
        seen = list(seen)
        rows = pd.concat(list(batches)).sort_values(["captured_at", "id"])
        first = not state.exists
        out = []
        for digest, context, at in zip(rows["payload_hash"], rows["context"], rows["captured_at"]):
            known = context in seen
            decision = "new" if first else "changed" if last is None or digest is None or digest != last else "repeat" if known else "new_context"
            out.append((key[0], at, decision))
            first, last = False, digest
            if not known:
                seen.append(context)
        state.update((last, seen))
        yield pd.DataFrame(out, columns=["record_key", "captured_at", "decision"])

    return events.groupBy("record_key").applyInPandasWithState(decide, "record_key string, captured_at timestamp, decision string", "last string, seen array<string>", "append", "NoTimeout")


def merge_into(path: str, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A batch function that merges records into versions under ``path``; a batch written before is passed over.

    Each version is the whole table after its batch.  A batch goes on from the last complete version
    before it, whatever its number, so batches may be numbered with gaps.  Older versions than the
    last ``keep`` are removed once a new one is complete.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path
        fs = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where(path))] if fs.exists(where(path)) else []
        done = sorted(int(n[6:]) for n in names if n.startswith("batch=") and n[6:].isdigit() and fs.exists(where(f"{path}/{n}/_SUCCESS")))
        if number in done:
            return
        before = [n for n in done if n < number]
        merged = upserted(spark.read.parquet(f"{path}/batch={before[-1]}"), batch) if before else merged_records(batch)
        merged.write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in before[: max(0, len(before) - keep)]:
            fs.delete(where(f"{path}/batch={old}"), True)

    return apply
