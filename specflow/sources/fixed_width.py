"""Fixed-width lines to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.functions import text
from specflow.operators.coerce import coerce
from specflow.sources.delimited import finish
from specflow.spec import FileSpec, require_valid


def parse_fixed_width(lines: DataFrame, spec: FileSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Positions count from ``spec.position_base`` (0 unless the spec says 1)."""
    require_valid(spec)
    cells, made = [], []
    odd = F.col("_odd")
    for k, f in enumerate(spec.fields):
        start = f.start_position - spec.position_base
        cells.append(text.trim_known(F.substring("_raw", start + 1, f.length), odd).alias(f"_r{k}"))
        made.append(coerce(f, f"_r{k}", F.length("_raw") <= start, fixed=True))
    opened = lines.withColumn("_odd", text.has_odd_space(F.col("_raw")))
    return finish(opened.select("_file", "_seq", "_raw", *keep, *cells), spec, made, keep)
