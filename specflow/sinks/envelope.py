"""Event envelopes: one JSON event per record, keyed by run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.functions import masking
from specflow.operators.coerce import typed
from specflow.operators.records import value_of, was_corrected
from specflow.spec import FieldSpec, FileSpec

NUMERIC = ("INTEGER", "LONG", "DECIMAL", "AMOUNT")


def new_run_id() -> str:
    return str(uuid.uuid4())


def _event_value(f: FieldSpec, text_only: bool, mask: bool) -> Column:
    """JSON number or boolean while the parsed type still stands; text once corrected or bad."""
    value = value_of(f.name)
    if mask and f.sensitive:
        return F.when(value.isNotNull(), F.lit(masking.MASK)).cast("string")
    if text_only or f.type not in (*NUMERIC, "BOOLEAN"):
        return value
    as_text = value.cast("variant")
    if f.type == "BOOLEAN":
        good = F.when(value.isin("true", "false"), (value == "true").cast("variant"))
    else:
        good = F.when(typed(f, value).isNotNull(), F.try_parse_json(value))
    return F.when(value.isNull() | was_corrected(f.name), as_text).otherwise(F.coalesce(good, as_text))


def envelopes(records: DataFrame, spec: FileSpec, run_id: str, text_only: bool = False, stamp: Column | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns key and value (JSON). ``text_only`` keeps every field as a JSON string."""
    names = spec.record_fields
    declared = {f.name: f for f in spec.fields}
    fields = [
        _event_value(declared.get(n, FieldSpec(n)), text_only, spec.mask_sensitive).alias(n) for n in names
    ]
    at = stamp if stamp is not None else F.unix_millis(F.current_timestamp())
    body = F.struct(
        F.lit(run_id).alias("correlationId"),
        F.lit(spec.id).alias("specId"),
        F.col("_seq").alias("sequenceNumber"),
        F.col("_file").alias("fileName"),
        F.struct(*fields).alias("fields"),
        F.col("_corrected").alias("corrected"),
        F.col("_metadata").alias("metadata"),
        at.cast("bigint").alias("eventTimestamp"),
    )
    value = F.to_json(body, {"ignoreNullFields": "false"})
    return records.select(F.lit(run_id).alias("key"), value.alias("value"), *keep)
