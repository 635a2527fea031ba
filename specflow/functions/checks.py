"""Domain checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the bank routing check digit, and the account-number shape.
ROUTING_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}([A-Z0-9]?){0,16}"


def routing_checksum(digits: Column) -> Column:
    """Weighted digit sum over the first nine digits."""
    total = F.lit(0)
    for place, weight in enumerate(ROUTING_WEIGHTS, start=1):
        total = total + F.substring(digits, place, 1).try_cast("int") * weight
    return total


def routing_ok(c: Column) -> Column:
    return c.rlike(r"\A[0-9]{9}\z") & (routing_checksum(c) % 10 == 0)


def routing_check_digit(first_eight: Column) -> Column:
    """The ninth digit that makes the weighted sum a multiple of ten."""
    total = F.lit(0)
    for place, weight in enumerate(ROUTING_WEIGHTS[:8], start=1):
        total = total + F.substring(first_eight, place, 1).try_cast("int") * weight
    return F.pmod(-total, F.lit(10)).cast("string")
