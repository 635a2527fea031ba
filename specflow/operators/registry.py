"""Reports over tables of specs and integrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_DEF = "struct<name:string,column_index:int,column_name:string,start_position:int,length:int,path:string,xml_attribute:string>"


def field_problem(fmt: Column, f: Column) -> Column:
    """Problem of one field definition under a format, or null."""
    return (
        F.when(fmt.isin("CSV", "DELIMITED") & f["column_index"].isNull() & f["column_name"].isNull(), "needs columnIndex or columnName")
        .when((fmt == "FIXED_WIDTH") & f["start_position"].isNull(), "needs startPosition")
        .when((fmt == "FIXED_WIDTH") & (F.coalesce(f["length"], F.lit(0)) <= 0), "needs a positive length")
        .when(fmt.isin("XML", "ISO20022") & f["path"].isNull() & f["xml_attribute"].isNull(), "needs path or xmlAttribute")
    )


def spec_problems(specs: DataFrame) -> DataFrame:
    """One row per problem of a spec table with columns spec_id, format, fields, metadata."""
    per_field = F.transform("fields", lambda f: F.when(field_problem(F.col("format"), f).isNotNull(), F.concat(f["name"], F.lit(": "), field_problem(F.col("format"), f))))
    whole = F.array(
        F.when(F.size("fields") == 0, F.lit("spec has no fields")),
        F.when(F.col("format").isin("XML", "ISO20022") & ~F.map_contains_key("metadata", "recordXPath"), F.lit("metadata key recordXPath is missing")),
    )
    return specs.select("spec_id", F.explode(F.array_compact(F.concat(whole, per_field))).alias("problem"))


def spec_report(specs: DataFrame) -> DataFrame:
    """Per spec: valid, number of problems, fields and rules."""
    counted = spec_problems(specs).groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_issues"))
    none = F.lit(0).cast("bigint")
    return specs.join(counted, "spec_id", "left").select(
        "spec_id",
        F.coalesce("n_issues", none).alias("n_issues"),
        (F.coalesce("n_issues", none) == 0).alias("is_valid"),
        F.size("fields").alias("field_count"),
        F.col("validation_rule_count"),
        F.col("correction_rule_count"),
    )


def integration_summary(integrations: DataFrame, types: list[str]) -> DataFrame:
    """Count and enabled share per type; a type without rows appears with 0."""
    listed = F.explode(F.array(*[F.lit(t) for t in types]))
    calendar = integrations.sparkSession.range(1).select(listed.alias("type"))
    counted = integrations.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_enabled").alias("n_enabled")
    )
    zero = F.lit(0).cast("bigint")
    return calendar.join(counted, "type", "left").select(
        "type",
        F.coalesce("n", zero).alias("n"),
        F.coalesce("n_enabled", zero).alias("n_enabled"),
        F.coalesce(F.try_divide(F.col("n_enabled").cast("double"), F.col("n").cast("double")), F.lit(0.0)).alias("enabled_share"),
    )
