"""Structured Streaming ingest of generated records.

The reference appends generated rows to a growing JSONL file.  Here that
folder is a streaming file source with a fixed schema:

* ``stream_ingest``   validate every micro-batch (F7/F8, P11/P12 for
  vectors, range for scalars) and append valid rows and rejects to two
  Parquet sinks.  ``foreachBatch`` writes each batch into its own
  ``batch_id`` sub-folder with overwrite, so a retried batch replaces its
  own output (exactly-once with the checkpoint).
* ``running_progress``  valid / invalid counts so far and the label
  histogram, as a complete-mode streaming aggregate (no watermark: nothing
  is event-timed), written by ``foreachBatch`` as a small table.

Both run with ``availableNow`` by default, so a batch job and a stream
over the same files give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators.binning import bin_left_closed, linspace_edges
from ..operators.filters import non_blank, valid_vector
from ..sources.readers import BINARY_RECORD, VECTOR_RECORD

RECORD_WITH_ID = {"binary": "id BIGINT, " + BINARY_RECORD, "vector": "id BIGINT, " + VECTOR_RECORD}


def validated(df: DataFrame, kind: str = "binary", k: int | None = None) -> DataFrame:
    """Add ``status`` ('valid' or the first failed rule) and the cleaned
    label; the same function serves batch and stream."""
    lab = F.col("label")
    if kind == "binary":
        bad_label = lab.isNull() | F.isnan(lab) | (lab < 0) | (lab > 1)
        status = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("corrupt"))
                  .when(bad_label, F.lit("label_out_of_range"))
                  .when(~non_blank("text"), F.lit("blank_text")).otherwise(F.lit("valid")))
        return df.withColumn("status", status)
    fixed = L.validate_soft_label(lab)
    status = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("corrupt"))
              .when(~valid_vector(lab, k), F.lit("bad_length"))
              .when(fixed.isNull(), F.lit("invalid_vector"))
              .when(~non_blank("text"), F.lit("blank_text")).otherwise(F.lit("valid")))
    return df.withColumn("status", status).withColumn("label", F.when(status == "valid", fixed))


def read_stream(spark: SparkSession, in_dir: str, kind: str = "binary", max_files: int | None = None) -> DataFrame:
    """The growing folder as a stream; ``max_files`` limits a micro-batch (by
    default a batch takes all files that are there)."""
    reader = (spark.readStream.schema(RECORD_WITH_ID[kind]).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(in_dir)


def stream_ingest(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  kind: str = "binary", k: int | None = None, available_now: bool = True):
    """Returns the started query (already finished with availableNow)."""
    src = validated(read_stream(spark, in_dir, kind), kind, k)

    def write_batch(batch: DataFrame, batch_id: int):
        batch.persist()
        batch.filter(F.col("status") == "valid").drop("_corrupt_record", "status") \
            .write.mode("overwrite").parquet(f"{out_dir}/valid/batch_id={batch_id}")
        batch.filter(F.col("status") != "valid") \
            .write.mode("overwrite").parquet(f"{out_dir}/rejected/batch_id={batch_id}")
        batch.unpersist()

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return q


def progress_aggregate(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """T2 (shared by batch and stream): counts per status and, for valid
    binary rows, per [lo, hi) label bin (last bin closed)."""
    b = F.when(F.col("status") == "valid", bin_left_closed("label", linspace_edges(n_bins)))
    return df.groupBy("status", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def running_progress(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                     n_bins: int = 10, available_now: bool = True):
    """Complete-mode running aggregate, each trigger overwrites the
    small result table."""
    agg = progress_aggregate(validated(read_stream(spark, in_dir, "binary"), "binary"), n_bins)

    def write_batch(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(out_dir)

    w = (agg.writeStream.outputMode("complete").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return q
