"""Structured Streaming forms of the nightly state: windows, sessions, ledgers, upserts.

Each function takes a streaming (or a batch) table and returns the transformation; the
caller chooses source, sink and trigger, e.g. ``availableNow`` for a nightly run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(rows: DataFrame, at: str) -> DataFrame:
    """Event time as a timestamp (streams need one with a zone)."""
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(rows: DataFrame, at: str, size: str, keys: Sequence[str], value: str, late: str = "1 day") -> DataFrame:
    """Count and sum per window and key; rows later than ``late`` are dropped by the watermark."""
    return (
        timed(rows, at).withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
    )


def sessions(rows: DataFrame, at: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    """Spans of presence of a key that end when it isn't seen for ``gap``."""
    return timed(rows, at).withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def ledger(rows: DataFrame, at: str, keys: Sequence[str], late: str = "30 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return timed(rows, at).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


STATE = "price double, changes int, first_seen timestamp, last_seen timestamp"
TRACKED = f"key string, {STATE}"


def track_prices(rows: DataFrame, key: str, at: str, price: str) -> DataFrame:
    """Running state of each key: last price, number of changes, first and last sight.

    One small state per key; the rows of a batch are folded in Arrow chunks.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, changes, first, seen = state.get if state.exists else (None, 0, None, None)
        for chunk in chunks:
            for t, p in chunk[[at, price]].sort_values(at).itertuples(index=False):
                first, seen = t if first is None else min(first, t), t if seen is None else max(seen, t)
                if pd.notna(p):
                    changes += last is not None and p != last
                    last = float(p)
        state.update((last, int(changes), first, seen))
        yield pd.DataFrame({"key": [k[0]], "price": [last], "changes": [int(changes)], "first_seen": [first], "last_seen": [seen]})

    keyed = timed(rows, at).select(F.col(key).cast("string").alias(key), at, F.col(price).cast("double").alias(price))
    return keyed.groupBy(key).applyInPandasWithState(fold, TRACKED, STATE, "update", GroupStateTimeout.NoTimeout)


def upserting(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps a table of numbered versions, each from the last one and a batch.

    A batch that is delivered again writes its version again, so the result is the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = spark.read.parquet(f"{path}/{number - 1}") if number > 0 else None
        merge(last, batch).write.mode("overwrite").parquet(f"{path}/{number}")

    return apply


def merged_by(*keys: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge for :func:`upserting`: the rows of the batch in place of those with the same keys."""

    def merge(last: DataFrame | None, batch: DataFrame) -> DataFrame:
        if last is None:
            return batch
        same = [last[k].eqNullSafe(batch[k]) for k in keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        return last.join(batch, on, "left_anti").unionByName(batch)

    return merge


def run_available(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Everything that is there now, in batches, then the end."""
    q = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def since(at: Column, now: Column, interval: str) -> Column:
    """Look-back of a fixed length, as in the nightly filters."""
    return at >= now - F.expr(f"INTERVAL {interval}")
