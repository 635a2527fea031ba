"""Date coercion over a fixed list of candidate layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Candidate layouts, tried in this order, the first that parses wins. The
# shape beside each is what the layout can match; it spares a failed parse per row.
CANDIDATES = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("MM-dd-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MMddyyyy", r"^\d{8}$"),
)


def smart_date(c: Column, layout: str) -> Column:
    """Date of a text that has the layout's shape; a day that its month lacks becomes the month's last day.

    Null for months beyond 12 and days beyond 31.
    """

    def part(name: str) -> Column:
        return F.substring(c, layout.index(name) + 1, len(name)).cast("int")

    month, day = part("MM"), part("dd")
    first = F.make_date(part("yyyy"), month, F.lit(1))
    return F.when(month.between(1, 12) & day.between(1, 31), F.least(F.date_add(first, day - 1), F.last_day(first)))


def parse_any_date(c: Column) -> Column:
    """First candidate layout that parses, as a date; null when none does."""
    by_shape: dict[str, list[Column]] = {}
    for layout, shape in CANDIDATES:
        by_shape.setdefault(shape, []).append(smart_date(c, layout))
    found = None
    for shape, tries in by_shape.items():
        day = F.coalesce(*tries)
        found = F.when(c.rlike(shape), day) if found is None else found.when(c.rlike(shape), day)
    return found


def coerce_date(c: Column, target: str | None) -> Column:
    return F.coalesce(F.date_format(parse_any_date(c), target or "yyyy-MM-dd"), c)
