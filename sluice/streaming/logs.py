"""Running summaries of job logs as they arrive.

Log files are read as a stream; the counts of each job are the stream's state,
held by Spark's checkpoint.  Every micro-batch writes the jobs that it changed
under its own number, so a batch that is run again after a failure replaces
what it wrote, and each line counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ledger import LOG_SCHEMA, log_summary

SUMMARY_SCHEMA = "job_id string, total_events long, errors long, warnings long"


def follow_logs(spark: SparkSession, log_dir: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Takes in every log file that came since the last call, and returns when all are counted.

    Malformed lines are skipped.  The state is one row a job.
    """
    lines = spark.readStream.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(log_dir)
    changed = log_summary(lines)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        write).start()
    query.awaitTermination()


def running_summary(spark: SparkSession, out: str) -> DataFrame:
    """(job_id, total_events, errors, warnings): the latest counts of each job."""
    rows = spark.read.schema(f"{SUMMARY_SCHEMA}, batch long").parquet(out)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("total_events", "errors", "warnings"), "batch").alias("s"))
    return last.select("job_id", "s.*")
