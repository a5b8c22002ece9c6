"""All registered queries."""

from . import (  # noqa: F401
    graph_checks,
    io_checks,
    join_checks,
    learn_checks,
    metric_checks,
    score_checks,
    text_checks,
)
from .registry import REGISTRY  # noqa: F401
