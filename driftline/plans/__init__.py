"""Queries on the driver tables."""

from driftline.plans import (  # noqa: F401
    catalog_queries,
    file_queries,
    graph_queries,
    metric_queries,
    set_queries,
    stream_queries,
    table_queries,
)
from driftline.plans.registry import ORACLES, QUERIES  # noqa: F401
