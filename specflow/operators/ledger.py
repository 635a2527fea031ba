"""The file ledger: idempotent intake, pickup queue and status history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["integration_id", "remote_file_name"]

# Processing states and where each may go.
MOVES = {"PENDING": ("PROCESSING",), "PROCESSING": ("PROCESSED", "FAILED"), "FAILED": ("PROCESSING",)}


def unseen(listing: DataFrame, ledger: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Listed files the ledger does not have yet."""
    return listing.join(ledger.select(*key), key, "left_anti")


def seen(listing: DataFrame, ledger: DataFrame, key: list[str] = KEY) -> DataFrame:
    return listing.join(ledger.select(*key), key, "left_semi")


def append(listing: DataFrame, ledger: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """The ledger plus one PENDING row per new (integration, file); the earliest listing wins."""
    rest = [c for c in listing.columns if c not in key]
    fresh = unseen(listing, ledger, key)
    if rest:
        best = fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        fresh = best.select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    else:
        fresh = fresh.dropDuplicates(key)
    fresh = fresh.withColumn("processing_status", F.lit("PENDING"))
    return ledger.unionByName(fresh, allowMissingColumns=True)


def pending(ledger: DataFrame, limit: int, order: list[str], status: str = "PENDING") -> DataFrame:
    """The pickup queue: oldest first, bounded."""
    return ledger.filter(F.col("processing_status") == status).orderBy(*order).limit(limit)


def status_counts(ledger: DataFrame, by_integration: bool = True) -> DataFrame:
    keys = ["integration_id", "processing_status"] if by_integration else ["processing_status"]
    return ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))


def current_status(history: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Latest status per file from an append-only history, by pre-aggregated max."""
    return history.groupBy(*key).agg(F.max_by("processing_status", F.struct(*order)).alias("processing_status"))


def move_allowed(old: Column, new: Column) -> Column:
    allowed = F.lit(False)
    for source, targets in MOVES.items():
        allowed = allowed | ((old == source) & new.isin(*targets))
    return allowed


def orphans(ledger: DataFrame, integrations: DataFrame, on: str = "integration_id") -> DataFrame:
    return ledger.join(integrations.select(on), on, "left_anti")
