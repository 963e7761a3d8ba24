"""sluice: declarative extract / filter / map / validate / aggregate / load on Spark."""

from .operators.aggregate import aggregate
from .operators.filters import apply_filters
from .operators.mapping import MappingError, apply_mappings
from .operators.validation import quarantine_rows, validate
from .plans.jobs import run_job, submit
from .sources.files import scan
from .specs import JobSpec, from_dict

__version__ = "0.1.0"

__all__ = [
    "aggregate",
    "apply_filters",
    "apply_mappings",
    "validate",
    "quarantine_rows",
    "MappingError",
    "run_job",
    "submit",
    "scan",
    "JobSpec",
    "from_dict",
]
