"""Tables of a database: read in parallel by key ranges, merged by key without reading them back.

New rows go into a stage table in parallel and are merged by one statement of the database, in one
transaction that also drops the stage. So other rows are never read or rewritten, writers need not
pause, and a run that fails leaves the target as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.session import stored

#: rows that one task reads
ROWS_PER_PARTITION = 1_000_000
#: tasks that read at once; the database must bear so many connections
MOST_PARTITIONS = 200

# How databases spell the merge, by the beginning of their JDBC address.
DIALECTS = {"jdbc:postgresql:": "conflict", "jdbc:sqlite:": "conflict", "jdbc:duckdb:": "conflict", "jdbc:mysql:": "duplicate", "jdbc:mariadb:": "duplicate"}
QUOTES = {"duplicate": "`"}


def dialect_of(url: str) -> str:
    return next((d for start, d in DIALECTS.items() if url.startswith(start)), "merge")


def _named(names: list[str], quote: str) -> list[str]:
    return [f"{quote}{n.replace(quote, quote * 2)}{quote}" for n in names]


def merge_statement(target: str, stage: str, columns: list[str], key: list[str], dialect: str = "merge") -> str:
    """One statement that puts the stage's rows in the place of those with their key, and adds the others."""
    lacking = [k for k in key if k not in columns]
    if not key or lacking:
        raise ValueError(f"the key {lacking or key} is not among the columns")
    quote = QUOTES.get(dialect, '"')
    named, keyed = _named(columns, quote), _named(key, quote)
    rest = [n for n in named if n not in keyed]
    listed = ", ".join(named)
    insert = f"INSERT INTO {target} ({listed}) SELECT {listed} FROM {stage}"
    if dialect == "conflict":
        # without WHERE TRUE some parsers take ON for a join condition
        change = f"UPDATE SET {', '.join(f'{n} = EXCLUDED.{n}' for n in rest)}" if rest else "NOTHING"
        return f"{insert} WHERE TRUE ON CONFLICT ({', '.join(keyed)}) DO {change}"
    if dialect == "duplicate":
        return f"{insert} ON DUPLICATE KEY UPDATE {', '.join(f'{n} = VALUES({n})' for n in rest or keyed)}"
    same = " AND ".join(f"t.{n} = s.{n}" for n in keyed)
    matched = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{n} = s.{n}' for n in rest)}" if rest else ""
    return f"MERGE INTO {target} t USING {stage} s ON ({same}){matched} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{n}' for n in named)})"


def newest(source: DataFrame, key: list[str], order: list[str] | None) -> DataFrame:
    """One row per key: the last in the order; without one, keys must be unique."""
    if not order:
        return source
    rest = [c for c in source.columns if c not in key]
    best = source.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*source.columns)


def merge(df: DataFrame, connection: dict, key: list[str], order: list[str] | None = None, batch_size: int = 1000) -> None:
    """Stages the rows and merges them; ``connection`` has url, dbtable and what else the driver needs."""
    spark, url, target = df.sparkSession, connection["url"], connection["dbtable"]
    stage = f"{target}_stage_{uuid.uuid4().hex[:12]}"
    # a task that runs again must write the same rows
    rows = stored(newest(df, key, order), "merge")
    rows.write.format("jdbc").options(**{**connection, "dbtable": stage}).option("batchsize", batch_size).mode("overwrite").save()
    statement = merge_statement(target, stage, df.columns, key, dialect_of(url))
    execute(spark, connection, [statement, f"DROP TABLE {stage}"])


def execute(spark: SparkSession, connection: dict, statements: list[str]) -> None:
    """Runs statements in one transaction, on the driver's own connection."""
    jvm = spark.sparkContext._jvm
    if connection.get("driver"):
        jvm.java.lang.Class.forName(connection["driver"])
    properties = jvm.java.util.Properties()
    for name, value in connection.items():
        if name not in ("url", "dbtable", "driver"):
            properties.setProperty(name, str(value))
    link = jvm.java.sql.DriverManager.getConnection(connection["url"], properties)
    try:
        link.setAutoCommit(False)
        for statement in statements:
            link.createStatement().execute(statement)
        link.commit()
    except Exception:
        link.rollback()
        raise
    finally:
        link.close()


def bounds(low: int | None, high: int | None, rows: int, per_partition: int = ROWS_PER_PARTITION, most: int = MOST_PARTITIONS) -> dict[str, str]:
    """Options that cut a read by ranges of a number column; none for a table that one task reads."""
    count = min(most, -(-rows // per_partition))
    if low is None or high is None or count < 2:
        return {}
    # ranges are half open and the last one has no end
    return {"lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(min(count, high - low + 1))}


def read_table(spark: SparkSession, connection: dict, column: str, query: str | None = None, per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """A table, or the rows of a query, read in parallel by ranges of a number column; its ends are asked for first."""
    source = f"({query}) q" if query else connection["dbtable"]
    reader = spark.read.format("jdbc").options(**{**connection, "dbtable": source})
    name = _named([column], QUOTES.get(dialect_of(connection["url"]), '"'))[0]
    asked = f"(SELECT MIN({name}) AS low, MAX({name}) AS high, COUNT(*) AS n FROM {source}) ends"
    ends = spark.read.format("jdbc").options(**{**connection, "dbtable": asked}).load().first()
    low, high, n = (None if v is None else int(v) for v in ends)
    cut = bounds(low, high, n or 0, per_partition)
    return reader.options(partitionColumn=column, **cut).load() if cut else reader.load()


def unprocessed_query(table: str, marks: str, key: list[str], quote: str = '"') -> str:
    """The rows of a table that its table of processed marks lacks, found by the database."""
    same = " AND ".join(f"m.{n} = t.{n}" for n in _named(key, quote))
    return f"SELECT t.* FROM {table} t WHERE NOT EXISTS (SELECT 1 FROM {marks} m WHERE {same})"
