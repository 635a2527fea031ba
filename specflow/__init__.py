"""Spec-driven record processing on Spark DataFrames."""

from specflow.spec import FileSpec, load_spec

__all__ = ["FileSpec", "load_spec"]
