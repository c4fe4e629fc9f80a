"""Queries over the provided tables, one or more per operator."""

from tabloom.workloads import (  # noqa: F401
    aggregating,
    browsing,
    copying,
    editing,
    files,
    flavouring,
    mapping,
    monitoring,
    scalars,
    shaping,
)
from tabloom.workloads.registry import ORACLES, QUERIES, runner  # noqa: F401
