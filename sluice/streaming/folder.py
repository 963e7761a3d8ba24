"""Incremental jobs over an upload folder with Structured Streaming.

Each new CSV (or Parquet) file in the folder is one job: the stream reads one file per
micro-batch (``maxFilesPerTrigger=1``), and ``foreachBatch`` runs the same
batch stages on it - filter, map, validate, aggregate - writing valid rows
and quarantined rows under the batch id.  A re-run batch overwrites its own
output, and the checkpoint records which files are done, so every file is
processed exactly once even across restarts and lost executors.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validation import ERRORS, error_text
from ..plans.stages import run_stages
from ..sources import inference


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def process_batch(batch: DataFrame, batch_id: int, spec, output_dir: str, quarantine_dir: str | None,
                  infer: bool = True) -> None:
    """Run the job's stages on one micro-batch (one new file)."""
    # the micro-batch (one file) feeds the inference pass and every write:
    # keep it for the batch's lifetime instead of parsing the file again
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        df = batch
        if infer:
            df, _ = inference.infer_and_cast(inference.null_tokens(df))
        res = run_stages(
            df,
            filters=spec.filters,
            mappings=spec.column_mappings,
            rules=spec.validation_rules,
            aggregation=spec.aggregations,
            order_by=spec.order_by,
            on_error=spec.on_error,
        )
        res.output.write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")
        if quarantine_dir and res.validation is not None:
            bad = res.validation.invalid.withColumn("_validation_errors", error_text()).drop(ERRORS)
            bad.write.mode("overwrite").option("header", True).csv(f"{quarantine_dir}/batch={batch_id}")
    finally:
        batch.unpersist()


def watch_folder(
    spark: SparkSession,
    folder: str,
    columns,
    spec,
    output_dir: str,
    checkpoint: str,
    quarantine_dir: str | None = None,
    once: bool = True,
    files_per_trigger: int = 1,
    fmt: str = "csv",
    multi_line: bool = False,
):
    """Start the folder job; with ``once`` it drains what is there and stops.

    ``files_per_trigger`` > 1 groups several small files into one job (the
    group then shares first-occurrence and aggregation scope).  ``unique``
    looks at the files of one job only.  Files are read split into many tasks;
    ``multi_line`` is for files whose quoted cells hold line breaks, each of
    which one task then parses whole."""
    if fmt == "csv":
        stream = (
            spark.readStream.schema(text_schema(columns))
            .option("header", True)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("maxFilesPerTrigger", files_per_trigger)
            .csv(folder)
        )
        infer = True
    elif fmt == "parquet":
        # typed files: the schema comes from the files already present
        schema = spark.read.parquet(folder).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
        infer = False
    else:
        raise ValueError(f"unsupported folder format {fmt}")
    writer = (
        stream.writeStream.foreachBatch(
            lambda b, i: process_batch(b, i, spec, output_dir, quarantine_dir, infer)
        )
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_outputs(spark: SparkSession, output_dir: str) -> DataFrame:
    """All batches' valid rows, with the batch id as a column."""
    return spark.read.parquet(output_dir).withColumn("batch", F.col("batch").cast("long"))
