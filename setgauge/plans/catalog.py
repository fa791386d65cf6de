"""All registered queries."""

from . import (  # noqa: F401
    model_queries,
    posture_queries,
    report_queries,
    set_queries,
    signal_queries,
    source_queries,
    stateful_queries,
)
from .registry import CHECKS, QUERIES  # noqa: F401
