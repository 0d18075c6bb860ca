"""Sinks (S8–S11).  All writes are Spark writers to a (shared) path; runs,
embeddings and snapshots are published whole (``published``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .published import publish, read_all_published, read_published

EMBEDDINGS = "embeddings"


def append_generated(df: DataFrame, path: str, cols=("label", "text", "reasoning")) -> None:
    """Append valid rows as JSON lines."""
    df.select(*[c for c in cols if c in df.columns]).write.mode("append").json(path)


def write_metrics(df: DataFrame, path: str, run_id: str) -> None:
    """Metric / per-row result tables of a run; a re-run of the same id
    replaces only its own rows, and readers see a whole run or none."""
    publish(df.withColumn("run_id", F.lit(run_id)), path, run_id, overwrite=True)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """All runs in ``path``, with their ``run_id``."""
    return read_all_published(spark, path)


def write_embeddings(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuse to overwrite unless asked, also when another writer is at it."""
    publish(df, path, EMBEDDINGS, overwrite=overwrite)


def snapshot_training_set(df: DataFrame, path: str, iteration: int, every: int,
                          final: bool = False) -> bool:
    """CSV snapshot every ``every`` iterations (-1 = never) and a final
    one; a repeated iteration replaces its snapshot.  Returns whether a
    snapshot was written."""
    if final or (every > 0 and iteration % every == 0):
        publish(df, path, "final" if final else f"iter_{iteration:05d}", "csv", overwrite=True, header=True, escape='"')
        return True
    return False


def read_snapshot(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame | None:
    """A snapshot (``final`` or ``iter_00000``) as rows; texts may have line ends."""
    return read_published(spark, path, name, schema, header=True, escape='"', multiLine=True)
