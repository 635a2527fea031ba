"""Registered queries: each names its inventory ids, runs on the given tables and, where SQL can say it, carries the same result as SQL."""

from __future__ import annotations

from specflow.catalog.base import CATALOG, Entry


def load() -> dict[str, Entry]:
    from specflow.catalog import (  # noqa: F401
        flows,
        logs,
        metrics,
        records,
        sinks,
        sources,
        streams,
        tables,
        windows,
    )

    return CATALOG
