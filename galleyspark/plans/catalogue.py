"""Imports every plan module so that its jobs are registered."""

from galleyspark.plans import (  # noqa: F401
    columns,
    editorial,
    evidence,
    matching,
    rollups,
    sources,
    state,
    transcripts,
    windows,
)
from galleyspark.plans.registry import CHECKS, JOBS  # noqa: F401
