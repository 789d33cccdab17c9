"""All registered queries."""

from __future__ import annotations

from postlake.plans import (  # noqa: F401 - registering
    dedup_queries,
    page_queries,
    payload_queries,
    roundtrip_queries,
    storage_queries,
    stream_queries,
    text_queries,
    traffic_queries,
)
from postlake.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
