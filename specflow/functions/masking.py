"""Masking of sensitive values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***"


def key_prefix(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 4), F.lit("****"))
