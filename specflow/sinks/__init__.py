"""Writers by destination, and the hook for new ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from specflow.sinks import writers

Sink = Callable[[DataFrame, dict], None]
_sinks: dict[str, Sink] = {}


def register_sink(kind: str, sink: Sink) -> None:
    _sinks[kind] = sink


def write(df: DataFrame, kind: str, options: dict) -> None:
    if kind not in _sinks:
        raise ValueError(f"no sink for destination {kind}")
    _sinks[kind](df, options)


register_sink("KAFKA_TOPIC", writers.to_kafka)
register_sink("OUTPUT_FILE", writers.to_files)
register_sink("DATABASE", writers.to_database)
