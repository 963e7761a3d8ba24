"""Whole jobs: extract -> filter -> map -> validate -> aggregate -> load.

The stages compose lazily.  Filter, map and validate run in one writing
action: rows land in the shared checkpoint folder, valid and invalid ones
apart, and that action alone counts the stages' rows and the mappings' checks
(``observe``), so counts are those of rows that passed once.  Probes (the
first value of a date column, the keys of ``unique``) read an equal frame
that is not observed.  Aggregation and destinations then read what landed.
A job that only filters, maps and writes one file writes it directly.
"""

from __future__ import annotations

import datetime as _dt
import logging
import uuid
from contextlib import ExitStack

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import aggregate
from ..operators.filters import apply_filters
from ..operators.mapping import MappingPlan, apply_mappings, auto_mappings, merge_mappings, plan_mappings
from ..operators.validation import BAD, error_text, validate
from ..sinks.files import write_file, write_log
from ..sinks.jdbc import load_table
from ..sinks.rest import send_batches, send_summary
from ..sinks.rest_commit import load_batches
from ..session import materialize, scratch_path, scratch_scope
from ..sources.files import scan
from ..sources.jdbc import read_db
from ..sources.rest import read_api
from ..specs import DatabaseDestination, DatabaseSource, FileDestination, JobSpec
from . import ledger

log = logging.getLogger("sluice.jobs")


class JobLog:
    """Events of one job, kept on the driver and written once at the end."""

    def __init__(self, job_id: str):
        self.job_id = job_id
        self.events: list[dict] = []
        self.info("ETL job started")

    def _add(self, level: str, message: str, **extra):
        self.events.append(
            {"timestamp": _dt.datetime.now(_dt.timezone.utc).isoformat(), "level": level,
             "job_id": self.job_id, "message": message, **extra}
        )
        log.log(getattr(logging, level, logging.INFO), "[%s] %s", self.job_id, message)

    def info(self, message, **extra):
        self._add("INFO", message, **extra)

    def warning(self, message, **extra):
        self._add("WARNING", message, **extra)

    def error(self, message, **extra):
        self._add("ERROR", message, **extra)

    def summary(self) -> dict:
        levels = [e["level"] for e in self.events]
        return {"job_id": self.job_id, "total_events": len(levels), "errors": levels.count("ERROR"),
                "warnings": levels.count("WARNING")}


def extract(spark: SparkSession, spec: JobSpec, transport: str | None = None):
    """(frame, mappings) for the job's one source; database sources merge
    automatic pass-through mappings under the user's."""
    mappings = list(spec.column_mappings)
    if spec.file_source:
        df = scan(spark, spec.file_source.path) if spec.file_source.path.endswith(".parquet") else scan(
            spark, spec.file_source.path, encoding=spec.file_source.encoding,
            multi_line=spec.file_source.multi_line,
        )
    elif spec.db_source:
        df = read_db(spark, spec.db_source)
        mappings = merge_mappings(mappings, auto_mappings(df))
    elif spec.api_source:
        df = read_api(spark, spec.api_source, transport)
    else:
        df = spark.table(spec.table_source)
    return df, mappings


INVALID = "_invalid_row"
REASONS = "_validation_errors"


def _pipeline(df: DataFrame, spec: JobSpec, plan: MappingPlan, counts: dict[str, Observation] | None) -> DataFrame:
    """Filtered and mapped rows.  With ``counts``, rows and checks are counted as they pass."""
    rows = F.count(F.lit(1)).alias("rows")
    if counts is not None:
        df = df.observe(counts.setdefault("extracted", Observation()), rows)
    if spec.filters:
        df, _ = apply_filters(df, spec.filters)
    if counts is not None and (spec.filters or plan.check_counts()):
        df = df.observe(counts.setdefault("filtered", Observation()), rows, *plan.check_counts())
    return plan.apply(df)


def _land(df: DataFrame, spec: JobSpec, plan: MappingPlan, order: str | None) -> tuple[DataFrame, DataFrame | None, dict]:
    """(valid rows, invalid rows with reasons, counts by stage) after one write to the checkpoint folder."""
    observed: dict[str, Observation] = {}
    mapped = _pipeline(df, spec, plan, observed)
    columns = [F.col(f"`{c}`") for c in mapped.columns]
    path = scratch_path(df.sparkSession)
    if spec.validation_rules:
        res = validate(mapped, spec.validation_rules, order_by=order, lookup=_pipeline(df, spec, plan, None))
        split = res.annotated.select(*columns, F.when(F.col(BAD), error_text()).alias(REASONS),
                                     F.col(BAD).cast("int").alias(INVALID))
        split = split.observe(observed.setdefault("validated", Observation()),
                              F.count_if(F.col(INVALID) == 0).alias("valid"), F.count_if(F.col(INVALID) == 1).alias("invalid"))
        split.write.partitionBy(INVALID).parquet(path)
        landed = df.sparkSession.read.schema(split.schema).parquet(path)
        valid = landed.filter(F.col(INVALID) == 0).select(*columns)
        invalid = landed.filter(F.col(INVALID) == 1).select(*columns, REASONS)
    else:
        mapped.write.parquet(path)
        valid, invalid = df.sparkSession.read.schema(mapped.schema).parquet(path), None
    return valid, invalid, {name: dict(o.get) for name, o in observed.items()}


def run_job(
    spark: SparkSession,
    spec: JobSpec,
    job_id: str | None = None,
    log_dir: str | None = None,
    ledger_path: str | None = None,
    transport=None,
    source_transport: str | None = None,
) -> dict:
    """Run one job end to end and return its result record."""
    job_id = job_id or str(uuid.uuid4())
    jl = JobLog(job_id)
    req_hash = ledger.request_hash(spec)
    if ledger_path:
        ledger.record(spark, ledger_path, job_id, req_hash, "running")
    scope = ExitStack()
    try:
        scope.enter_context(scratch_scope(spark))
        df, mappings = extract(spark, spec, source_transport)
        jl.info(f"Extracted {len(df.columns)} columns")
        plan = plan_mappings(apply_filters(df, spec.filters)[0] if spec.filters else df, mappings, spec.order_by)
        order = spec.order_by
        for m in mappings:
            if order and m.column_name == order:
                order = m.final_name

        destinations = [d for d in (spec.db_destination, spec.file_destination, spec.api_destination) if d]
        direct = (destinations == [spec.file_destination] and not spec.validation_rules and not spec.aggregations
                  and not plan.check_counts())
        invalid, counts, observed = None, {}, {}
        if direct:
            _check_mapping(plan, spec)
            df = _pipeline(df, spec, plan, observed)
        else:
            source, checks = df, bool(plan.check_counts())
            df, invalid, counts = _land(source, spec, plan, order)
            if checks:
                dropped = plan.settle(counts["filtered"])
                _check_mapping(plan, spec)
                if dropped:  # what landed has a cast that failed: once more with the column as it was
                    df, invalid, counts = _land(source, spec, plan, order)
            else:
                _check_mapping(plan, spec)
        for e in plan.errors:
            jl.warning(f"Transform error on '{e['column']}': {e['error']}")

        failed_rows = int(counts.get("validated", {}).get("invalid", 0))
        invalid_file = None
        if spec.validation_rules:
            jl.info(f"Validation: {counts['validated'].get('valid', 0)} valid, {failed_rows} invalid", invalid_count=failed_rows)
            if failed_rows and spec.quarantine_path:
                invalid_file = write_file(invalid, FileDestination("csv", spec.quarantine_path))["output_path"]
                jl.info(f"{failed_rows} invalid row(s) are in {invalid_file}")

        if spec.aggregations:
            df = aggregate(df, spec.aggregations, order_by=order)
            if len(destinations) > 1:
                df = materialize(df)

        details: dict = {}
        processed = 0
        if spec.db_destination:
            ddl_mappings = [] if spec.aggregations else mappings
            details["database"] = load_table(df, spec.db_destination, ddl_mappings, spec.batch_size,
                                             [order] if order in df.columns else [])
            processed = details["database"]["rows_inserted"]
            jl.info(f"Loaded {processed} rows into {spec.db_destination.table_name}")
        if spec.file_destination:
            details["file"] = write_file(df, spec.file_destination)
            processed = details["file"]["rows_written"]
            jl.info(f"Wrote {processed} rows to {spec.file_destination.output_path}")
        if spec.api_destination:
            if spec.api_destination.exactly_once:
                # the load is known by the job: run again under its id, it sends what was not acknowledged
                details["api"] = load_batches(df, spec.api_destination, job_id, [order] if order in df.columns else [],
                                              transport, spec.max_retries)
            else:
                report = materialize(send_batches(df, spec.api_destination, transport, spec.max_retries))
                details["api"] = send_summary(report)
            processed = processed or details["api"]["total_records"]
            jl.info(f"API load: {details['api']['sent']} sent, {details['api']['failed']} failed")

        counts |= {name: dict(o.get) for name, o in observed.items()}
        metrics = {name: int(c.get("rows", 0)) for name, c in counts.items() if name != "validated"}
        if "validated" in counts:
            metrics["valid"] = int(counts["validated"].get("valid", 0))
        result = {
            "job_id": job_id,
            "success": True,
            "message": "ETL job completed successfully.",
            "total_rows": metrics.get("extracted", 0),
            "processed_rows": int(processed),
            "failed_rows": failed_rows,
            "invalid_rows_file": invalid_file,
            "details": details,
            "stage_rows": metrics,
        }
        state = "done"
    except Exception as exc:
        jl.error(f"ETL job failed: {exc}", error_type=type(exc).__name__)
        result = {"job_id": job_id, "success": False, "message": str(exc), "total_rows": 0,
                  "processed_rows": 0, "failed_rows": 0}
        state = "failed"
    finally:
        scope.close()
    jl.info("ETL job finished")
    if log_dir:
        write_log(spark, jl.events, log_dir)
        result["log_dir"] = log_dir
    result["log_summary"] = jl.summary()
    if ledger_path:
        ledger.record(spark, ledger_path, job_id, req_hash, state, result)
    return result


def _check_mapping(plan: MappingPlan, spec: JobSpec) -> None:
    if plan.errors and spec.on_error == "fail":
        raise ValueError("mapping failed: " + "; ".join(f"{e['column']}: {e['error']}" for e in plan.errors))


def submit(spark: SparkSession, spec: JobSpec, ledger_path: str, **kwargs) -> dict:
    """Idempotent submission: an identical request seen within the ledger
    window returns the earlier job instead of running again.  Of several at
    once, the one that gets the claim runs; the others are told its job."""
    req_hash = ledger.request_hash(spec)
    hit = ledger.find_job(spark, ledger_path, req_hash)
    if hit is None:
        job_id = kwargs.pop("job_id", None) or str(uuid.uuid4())
        holder = ledger.claim(spark, ledger_path, req_hash, job_id)
        if holder == job_id:
            return run_job(spark, spec, job_id=job_id, ledger_path=ledger_path, **kwargs)
        hit = ledger.find_job(spark, ledger_path, req_hash) or (holder, "claimed", None)
    job_id, state, result = hit
    return {"job_id": job_id, "state": state, "duplicate": True, **(result or {})}


def migrate(spark: SparkSession, source: DatabaseSource, destination: DatabaseDestination, **spec_fields) -> dict:
    """Database to database; mappings are optional (columns pass through)."""
    spec = JobSpec(db_source=source, db_destination=destination, **spec_fields)
    return run_job(spark, spec)


def upload_file(spark: SparkSession, path: str, destination: DatabaseDestination, mappings,
                batch_size: int = 10_000) -> dict:
    """File -> table with mappings only (no filter / validate / aggregate)."""
    df = scan(spark, path)
    mapped = apply_mappings(df, mappings, on_error="fail")
    report = load_table(mapped.df, destination, mappings, batch_size)
    return {"success": True, "table_name": destination.table_name, **report}
