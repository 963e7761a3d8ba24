"""Lazy composition of the stages: filter -> map -> validate -> aggregate.

Filters see source names, mappings rename, validation and aggregation see
target names.  Nothing here writes; ``plans.jobs`` adds sources, sinks,
metrics and the ledger around it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.aggregate import aggregate
from ..operators.filters import apply_filters
from ..operators.mapping import apply_mappings
from ..operators.validation import ValidationResult, validate
from ..specs import ColumnMapping


@dataclass
class StageResult:
    output: DataFrame  # rows to load (validated, aggregated if asked)
    filtered_out: DataFrame | None = None
    validation: ValidationResult | None = None
    mapping_errors: list = field(default_factory=list)
    observations: dict = field(default_factory=dict)


def _observe(df: DataFrame, name: str, observations: dict) -> DataFrame:
    obs = Observation(name)
    observations[name] = obs
    return df.observe(obs, F.count(F.lit(1)).alias("rows"))


def run_stages(
    df: DataFrame,
    filters=(),
    mappings=(),
    rules=(),
    aggregation=None,
    order_by: str | None = None,
    on_error: str = "fail",
    observe: bool = False,
) -> StageResult:
    """Compose the stages lazily; returns the output frame and side outputs.

    ``order_by`` is the source name of the row-order column; it follows its
    mapping's rename into the later stages.
    """
    observations: dict = {}
    if observe:
        df = _observe(df, "extracted", observations)
    filtered_out = None
    if filters:
        df, filtered_out = apply_filters(df, filters)
        if observe:
            df = _observe(df, "filtered", observations)

    mapped = apply_mappings(df, mappings, on_error=on_error, order_by=order_by)
    df = mapped.df
    target_order = order_by
    for m in mapped_list(mappings):
        if order_by and m.column_name == order_by:
            target_order = m.final_name

    validation = None
    if rules:
        validation = validate(df, rules, order_by=target_order)
        df = validation.valid
        if observe:
            df = _observe(df, "valid", observations)

    if aggregation:
        df = aggregate(df, aggregation, order_by=target_order)
    return StageResult(df, filtered_out, validation, mapped.errors, observations)


def mapped_list(mappings):
    return [m if isinstance(m, ColumnMapping) else ColumnMapping(**m) for m in mappings or ()]
