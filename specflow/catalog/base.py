"""Registration and the shared inputs of the catalog.

Inputs are SQL fragments in the dialect Spark and DuckDB share, so both sides start from
the same expressions over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.session import table
from specflow.spec import FileSpec, load_spec


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


CATALOG: dict[str, Entry] = {}


def register(name: str, ids: str, sql: str | None = None):
    def add(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(fn, sql, ids)
        return fn

    return add


def columns(spark: SparkSession, sf: str, name: str, exprs: dict[str, str]) -> DataFrame:
    return table(spark, sf, name).selectExpr(*[f"{e} AS {a}" for a, e in exprs.items()])


def select_sql(name: str, exprs: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {a}' for a, e in exprs.items())} FROM {name}"


def stamp(c: Column) -> Column:
    """Timestamps travel as text with microseconds, so both engines print them alike."""
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"

# Orders as shops might report them: some prices carry a currency sign, some dates are in
# US order, some buyers are missing, some stages are unknown.
ORDER = {
    "k": "o_orderkey",
    "placed": f"CASE WHEN o_orderpriority = '2-HIGH' THEN substr({DAY}, 6, 2) || '/' || substr({DAY}, 9, 2) || '/' || substr({DAY}, 1, 4) ELSE {DAY} END",
    "order_no": "'T' || CAST(o_orderkey AS STRING)",
    "price": f"CASE WHEN o_orderpriority = '1-URGENT' THEN '$' || {PRICE} ELSE {PRICE} END",
    "buyer": "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN '' ELSE 'buyer ' || CAST(o_custkey AS STRING) END",
    "stage": "CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'open' ELSE 'limbo' END",
    "urgency": "substr(o_orderpriority, 1, 1)",
    "memo": "CASE WHEN o_totalprice < 50000 THEN '' ELSE substr(o_orderpriority, 3) END",
}
ORDER_FIELDS = ["placed", "order_no", "price", "buyer", "stage", "urgency", "memo"]

ORDER_SPEC: FileSpec = load_spec(
    {
        "id": "shop-orders",
        "name": "Shop orders",
        "format": "DELIMITED",
        "delimiter": "|",
        "fields": [
            {"name": "placed", "type": "DATE", "columnIndex": 0, "format": "yyyy-MM-dd"},
            {"name": "orderNo", "columnIndex": 1},
            {"name": "price", "type": "DECIMAL", "columnIndex": 2, "scale": 2},
            {"name": "buyer", "columnIndex": 3, "sensitive": True},
            {"name": "stage", "type": "ENUM", "columnIndex": 4, "allowedValues": ["OPEN", "DONE", "HELD"]},
            {"name": "urgency", "type": "INTEGER", "columnIndex": 5},
            {"name": "memo", "columnIndex": 6, "required": False, "defaultValue": "none"},
        ],
        "correctionRules": [
            {"ruleId": "plain-price", "field": "price", "correctionType": "NUMBER_FORMAT_COERCE", "applyOrder": 1},
            {"ruleId": "iso-day", "field": "placed", "correctionType": "DATE_FORMAT_COERCE", "value": "yyyy-MM-dd", "applyOrder": 2},
            {"ruleId": "one-case", "field": "stage", "correctionType": "UPPERCASE", "applyOrder": 3},
        ],
        "validationRules": [
            {"ruleId": "who", "field": "buyer", "ruleType": "NOT_EMPTY", "message": "nobody ordered", "severity": "FATAL"},
            {"ruleId": "dear", "field": "price", "ruleType": "MAX_VALUE", "value": "300000", "message": "needs approval"},
            {"ruleId": "slow", "field": "urgency", "ruleType": "MAX_VALUE", "value": "4", "message": "urgency unknown"},
            {"ruleId": "wordy", "field": "memo", "ruleType": "MAX_LENGTH", "value": "6", "message": "memo is long", "severity": "WARNING"},
        ],
    }
)


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    raw = columns(spark, sf, "orders", ORDER)
    return raw.select(
        F.lit("orders.txt").alias("_file"), F.col("k").alias("_seq"), F.concat_ws("|", *ORDER_FIELDS).alias("_raw")
    )


# What the rules must find, from the raw columns alone.
ORDER_SQL = f"""
WITH raw AS ({select_sql("orders", ORDER)}),
judged AS (
  SELECT *, replace(price, '$', '') AS price_ok,
    CASE WHEN substr(placed, 3, 1) = '/' THEN substr(placed, 7, 4) || '-' || substr(placed, 1, 2) || '-' || substr(placed, 4, 2) ELSE placed END AS placed_ok,
    CASE WHEN memo = '' THEN 'none' ELSE memo END AS memo_ok,
    buyer = '' AS fatal,
    substr(price, 1, 1) = '$' AS bad_price,
    CAST(replace(price, '$', '') AS DECIMAL(18,2)) > 300000 AS dear,
    urgency = '5' AS slow,
    stage = 'limbo' AS bad_stage,
    length(memo) > 6 AS wordy,
    stage <> upper(stage) OR substr(price, 1, 1) = '$' OR substr(placed, 3, 1) = '/' AS corrected
  FROM raw),
run AS (
  SELECT *, fatal OR bad_price OR dear OR slow OR bad_stage AS invalid,
    -- a missing buyer is two errors: the required check and the rule
    (CASE WHEN fatal THEN 2 ELSE 0 END) + CAST(bad_price AS INT) + CAST(dear AS INT) + CAST(slow AS INT) + CAST(bad_stage AS INT) AS n_errors
  FROM judged)
"""
