"""Name and line templates compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from specflow.functions import text

_HOLE = re.compile(r"\{(\w+)(?::(\d+))?\}")


def render(template: str, values: Mapping[str, Column | str], numeric: set[str] = frozenset()) -> Column:
    """``{name}`` is replaced by the value, ``{name:width}`` is padded to the width.

    Names in ``numeric`` pad with zeros on the left, others with spaces on the right.
    A name without a value stays as written.
    """
    parts, at = [], 0
    for hole in _HOLE.finditer(template):
        if hole.start() > at:
            parts.append(F.lit(template[at : hole.start()]))
        name, width = hole.group(1), hole.group(2)
        if name in values:
            value = values[name]
            value = (value if isinstance(value, Column) else F.lit(value)).cast("string")
            value = F.coalesce(value, F.lit(""))
            if width:
                value = text.pad_left(value, int(width)) if name in numeric else text.pad_right(value, int(width))
            parts.append(value)
        else:
            parts.append(F.lit(hole.group(0)))
        at = hole.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"),
        "date": F.date_format(ts, "yyyyMMdd"),
        "time": F.date_format(ts, "HHmmss"),
        "timestamp": F.date_format(ts, "yyyyMMddHHmmss"),
    }


def storage_key(integration: Column, ts: Column, name: Column) -> Column:
    """``{integration}/{yyyy-MM-dd}/{file}``"""
    return F.concat_ws("/", integration.cast("string"), F.date_format(ts, "yyyy-MM-dd"), name)


# File extension per output format.
EXTENSIONS = {"CSV": "csv", "DELIMITED": "txt", "FIXED_WIDTH": "txt", "XML": "xml", "JSON": "json", "NACHA": "txt", "SWIFT_MT": "txt"}
