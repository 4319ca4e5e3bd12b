"""Sinks: JSON documents, snapshot appends, retention, model artefacts, partitioned tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str) -> None:
    """One compact JSON document per row, keys without a value left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_snapshot(rows: DataFrame, path: str, moment: Column, partition: str = "snapshot_date") -> None:
    """Rows appended under one shared moment, partitioned by it."""
    rows.withColumn(partition, moment).write.mode("append").partitionBy(partition).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Only the partitions that ``rows`` holds are replaced; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int) -> None:
    """Table whose later joins and groups on ``keys`` need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def retained(rows: DataFrame, day: str, keep: int) -> DataFrame:
    """Rows of the ``keep`` newest days; the days are ranked, not the rows."""
    newest = rows.select(day).distinct().orderBy(F.desc(day)).limit(keep)
    return rows.join(F.broadcast(newest), day, "left_semi")


def current_stats(known: DataFrame, published: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Current statistics after a publication: what it lacks becomes null, new keys are added."""
    p = published.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    both = known.join(p, F.col(key) == F.col("_key"), "full_outer")
    return both.select(F.coalesce(key, "_key").alias(key), *[F.col(f"_n_{f}").alias(f) for f in fields], *[c for c in known.columns if c != key and c not in fields])


def save_model(model: Mapping[str, object], metrics: Mapping[str, object], folder: str, stamp: str) -> None:
    """A fitted model's numbers and its metrics as two small JSON files."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for kind, what in (("model", model), ("metrics", metrics)):
        Path(folder, f"{stamp}.{kind}.json").write_text(json.dumps(what, ensure_ascii=False, sort_keys=True))


def latest_metrics(folder: str) -> dict | None:
    """Metrics of the newest model by file name; None without any."""
    files = sorted(Path(folder).glob("*.metrics.json"))
    return json.loads(files[-1].read_text()) if files else None
