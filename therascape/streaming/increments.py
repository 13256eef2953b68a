"""Increments: files that arrive, records that are new since the last run, windows of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from therascape.sources.keyed import KeyedStore
from therascape.sources.studies import STUDY


def arriving_studies(spark: SparkSession, path: str, files_each: int = 1000) -> DataFrame:
    """STR-01: a stream of registry files as they arrive, one study a line."""
    return spark.readStream.schema(STUDY).option("maxFilesPerTrigger", files_each).json(path)


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Hands all that has arrived to ``batch`` and stops; the checkpoint remembers what was done (STR-01, STR-04).

    A batch may come again after a failure, or with a new checkpoint: ``batch`` must be repeatable, as an upsert to a ``KeyedStore`` is.
    """
    return stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_since(current: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """STR-03: rows whose key the last snapshot lacks; an empty snapshot means a first run, which has no news."""
    known = snapshot.select(key).where(F.col(key).isNotNull()).distinct()
    any_known = known.limit(1).select(F.lit(True).alias("__any"))
    return current.where(F.col(key).isNotNull()).join(known, key, "left_anti").join(F.broadcast(any_known), F.lit(True), "left_semi")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n): events by tumbling window; on a stream, events later than ``late`` are left out."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def windows_to_store(events: DataFrame, store: KeyedStore, checkpoint: str, width: str = "1 day", late: str = "2 hours") -> StreamingQuery:
    """STR-02: counts by window and type, kept up to date in a store with the columns (start, event_type, n), keyed by ``window_key``.

    Each batch hands on the windows that it changed; a window's newest count is its largest, so a batch that comes again changes nothing.
    """
    return run_available(windowed_counts(events, width, late), checkpoint, lambda new, _: store.upsert(new), "update")


def landed_in_order(events: DataFrame, folder: str, slices: int = 4) -> None:
    """Events by ``ts`` in files that arrive one slice of time after the other, as a stream of files expects them."""
    cuts = events.agg(F.percentile_approx(F.col("ts").cast("double"), [k / slices for k in range(1, slices)])).first()[0] or []
    at = F.col("ts").cast("double")
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = events.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        some.write.mode("append").parquet(folder)
