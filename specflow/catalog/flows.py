"""Whole runs, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from specflow.catalog.base import DAY, PRICE, ORDER, ORDER_FIELDS, ORDER_SPEC, ORDER_SQL, columns, register
from specflow.catalog.sinks import pay_events
from specflow.catalog.sources import FILE_KEYS, FILE_OF, write_files
from specflow.catalog.windows import events
from specflow.operators.dedup import checksum
from specflow.plans import daily_close, file_to_file, inbound, intake, outbound
from specflow.commits import Files
from specflow.session import work_path
from specflow.sinks.envelope import envelopes
from specflow.sources import read_records
from specflow.sources.delimited import parse_delimited
from specflow.sources.listing import file_facts
from specflow.spec import FieldMapping, OutputSpec, load_spec


def _order_files(spark, sf):
    rows = columns(spark, sf, "orders", {"b": FILE_OF, **ORDER})
    lines = rows.select("b", "k", F.concat_ws("|", *ORDER_FIELDS).alias("value"))
    return write_files(lines, work_path(spark, "orders"), ["b"])


@register("flow_file_to_events", "PIP-01", ORDER_SQL + f"""SELECT k, seq, corrected, CAST(n_errors AS BIGINT) AS n_errors FROM (SELECT *, row_number() OVER (PARTITION BY floor(k / {FILE_KEYS}.0) ORDER BY k) - 1 AS seq FROM run) WHERE NOT fatal""")
def flow_file_to_events(spark, sf):
    """Files read, numbered, corrected, validated, routed and turned into events."""
    run = inbound.run_files(spark, _order_files(spark, sf), ORDER_SPEC)
    made = envelopes(run.passed.withColumn("n_errors", F.size("_errors").cast("bigint")), ORDER_SPEC, run.run_id, stamp=F.lit(0), keep=("n_errors",))
    v = F.parse_json("value")
    return made.select(
        F.substring(F.variant_get(v, "$.fields.orderNo", "string"), 2, 20).cast("bigint").alias("k"),
        F.variant_get(v, "$.sequenceNumber", "bigint").alias("seq"), F.variant_get(v, "$.corrected", "boolean").alias("corrected"), "n_errors")


@register("flow_file_summary", "PIP-01, AGG-01, AGG-02, AGG-03", ORDER_SQL + f"""SELECT total_records, successful_records, failed_records, corrected_records, warning_records,
 CASE WHEN failed_records > 0 AND successful_records > 0 THEN 'COMPLETED_WITH_ERRORS' WHEN failed_records > 0 THEN 'FAILED' WHEN warning_records > 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status,
 round(successful_records / total_records, 9) AS success_rate FROM (SELECT count(*) AS total_records, count(*) FILTER (WHERE NOT invalid) AS successful_records, count(*) FILTER (WHERE invalid) AS failed_records,
 count(*) FILTER (WHERE NOT invalid AND corrected) AS corrected_records, count(*) FILTER (WHERE NOT invalid AND wordy) AS warning_records FROM run GROUP BY floor(k / {FILE_KEYS}.0))""")
def flow_file_summary(spark, sf):
    """One summary per file of one run over many files."""
    run = inbound.run_files(spark, _order_files(spark, sf), ORDER_SPEC, skip_invalid=True, store=False)
    return run.summary.withColumn("success_rate", F.round("success_rate", 9)).drop("_file")


OUT_SPEC = load_spec({
    "id": "day-sheet", "name": "Day sheet", "format": "CSV", "fields": [{"name": "account"}], "outbound": {
        "format": "DELIMITED", "delimiter": ";", "fieldOrder": ["on", "client"],
        "fieldMappings": [
            {"sourceField": "amount", "targetField": "worth", "transform": "FORMAT_DECIMAL_2DP"},
            {"sourceField": "kind", "targetField": "desk", "defaultValue": "counter"},
            {"sourceField": "day", "targetField": "on"},
            {"sourceField": "account", "targetField": "client", "transform": "UPPERCASE"}],
        "correctionRules": [{"field": "desk", "type": "UPPERCASE"}],
        "validationRules": [{"field": "worth", "type": "MIN_VALUE", "value": "1000", "severity": "FATAL", "message": "not worth a line"}],
        "aggregationKey": "on", "fileNamingPattern": "{specId}-{day}.{ext}"}})
OUT_SQL = f"""WITH o AS (SELECT o_orderkey AS k, {DAY} AS day, {PRICE} AS worth, 'AC' || o_custkey AS client, CASE WHEN o_orderstatus = 'F' THEN '27' ELSE 'COUNTER' END AS desk, o_orderstatus FROM orders)"""


@register("flow_events_to_file", "PIP-02, PRJ-18, PRJ-19", OUT_SQL + """ SELECT 'day-sheet-' || day || '.txt' AS file_name, (rn - 1) // 5 AS file_no, (rn - 1) % 5 + 1 AS line_no, line FROM (
 SELECT day, row_number() OVER (PARTITION BY day ORDER BY k) AS rn, day || ';' || client || ';' || worth || ';' || desk AS line FROM o WHERE o_orderstatus <> 'P')""")
def flow_events_to_file(spark, sf):
    """Events mapped, corrected, validated and cut into files of five lines per day."""
    run = outbound.generate(pay_events(spark, sf), OUT_SPEC, ("_seq",), batch_size=5)
    name = outbound.file_name(OUT_SPEC, F.current_timestamp(), {"day": F.col("file_key")})
    return run.lines.select(name.alias("file_name"), "file_no", "line_no", "line")


@register("outbound_summary", "SNK-14", OUT_SQL + " SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS processed_records, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed_records FROM o")
def outbound_summary(spark, sf):
    return outbound.run_summary(outbound.mapped_records(pay_events(spark, sf), OUT_SPEC), OUT_SPEC)


@register("flow_file_to_file", "PIP-03", ORDER_SQL + """SELECT k, '{"ref":"' || order_no || '","worth":"' || price_ok || '","on":"' || placed_ok || '"}' AS line FROM run WHERE NOT invalid""")
def flow_file_to_file(spark, sf):
    """Pipe-delimited in, JSON out."""
    from dataclasses import replace

    spec = replace(ORDER_SPEC, output_spec=OutputSpec("JSON", field_mappings=(
        FieldMapping("orderNo", "ref"), FieldMapping("price", "worth"), FieldMapping("placed", "on"))))
    lines = columns(spark, sf, "orders", ORDER).select(
        F.lit("orders.txt").alias("_file"), F.col("k").alias("_seq"), F.concat_ws("|", *ORDER_FIELDS).alias("_raw"))
    return file_to_file.convert(parse_delimited(lines, spec), spec, True).select(F.col("_seq").alias("k"), "line")


CLOSE_SQL = """WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type, props ORDER BY ts, event_id) AS rn FROM events
 WHERE hour(ts) >= 8 AND hour(ts) < 17),
 c AS (SELECT day, count(*) FILTER (WHERE rn = 1) AS n, count(*) AS total FROM e GROUP BY 1)"""


def _close(spark, sf):
    ev = events(spark, sf).withColumn("sum", checksum("user_id", "event_type", "props"))
    day = F.date_trunc("day", "ts")
    days = ev.groupBy(day.alias("d")).agg(F.lit(1).alias("one"))
    frame = days.select(
        F.unix_date(F.to_date("d")).cast("bigint").alias("instance_id"),
        (F.col("d") + F.expr("INTERVAL 8 HOURS")).alias("opened_at"), (F.col("d") + F.expr("INTERVAL 17 HOURS")).alias("closed_at"))
    collected = daily_close.collect(ev, frame, "ts", ["sum"], "event_id")
    # the control record counts every event sent, copies included
    expected = collected.groupBy("instance_id").agg(F.count(F.lit(1)).alias("expected_count"))
    return daily_close.close(collected, expected, percent=0.5)


@register("flow_daily_close", "PIP-04", CLOSE_SQL + " SELECT epoch_day(day)::BIGINT AS instance_id, total AS expected_count, n AS actual_count, CASE WHEN (total - n) * 100.0 <= total * 0.5 THEN 'PASS' ELSE 'BLOCK' END AS verdict FROM c".replace("epoch_day(day)", "date_diff('day', DATE '1970-01-01', day)"))
def flow_daily_close(spark, sf):
    return _close(spark, sf).verdicts


@register("flow_daily_release", "PIP-04", CLOSE_SQL + " SELECT e.event_id FROM e JOIN c USING (day) WHERE e.rn = 1 AND (total - n) * 100.0 <= total * 0.5")
def flow_daily_release(spark, sf):
    return _close(spark, sf).accepted.select("event_id")


@register("flow_ledger_intake", "PIP-05", f"""SELECT total_records, successful_records, failed_records, 'PROCESSED' AS processing_status FROM (SELECT {FILE_OF} AS b, count(*) AS total_records,
 count(*) FILTER (WHERE o_totalprice >= 100000) AS successful_records, count(*) FILTER (WHERE o_totalprice < 100000) AS failed_records FROM orders GROUP BY 1) WHERE b <> 0
 UNION ALL SELECT 0, 0, 0, 'PROCESSED'""")
def flow_ledger_intake(spark, sf):
    """Files listed, those already in the ledger left out, the rest parsed and marked; one of them holds blank lines only."""
    rows = columns(spark, sf, "orders", {"b": FILE_OF, "k": "o_orderkey", "value": f"CAST(o_orderkey AS STRING) || ',' || {PRICE}"})
    blank = rows.select(F.max("b").alias("top")).select((F.col("top") + 1).alias("b"), F.lit(0).cast("bigint").alias("k"), F.lit("  ").alias("value"))
    path = write_files(rows.unionByName(blank), work_path(spark, "intake"), ["b"])
    listing = file_facts(spark, f"{path}/*", content=False).withColumn("integration_id", F.lit(1).cast("bigint"))
    # part names repeat across folders, so the folder belongs to the name
    listing = listing.withColumn("remote_file_name", F.substring_index("remote_file_path", "/", -2))
    book = listing.filter(F.contains("remote_file_path", F.lit("/b=0/"))).withColumn("processing_status", F.lit("PROCESSED"))
    pending = intake.take_in(listing, book, ["remote_file_path"]).filter("processing_status = 'PENDING'")
    spec = load_spec({"id": "in", "format": "CSV", "fields": [{"name": "id", "type": "LONG", "columnIndex": 0}, {"name": "price", "type": "DECIMAL", "columnIndex": 1}],
                      "validationRules": [{"ruleId": "r", "field": "price", "ruleType": "MIN_VALUE", "value": "100000", "message": "small"}]})
    done = intake.file_outcomes(read_records(spark, path, spec), spec, pending, skip_invalid=True)
    return done.select("total_records", "successful_records", "failed_records", "processing_status")



def name_of(path):
    return F.regexp_extract(path, r"/(b=[0-9]+|broken[.]gz)(?:/|$)", 1)


@register("intake_bad_file", "STR-22, SRC-29, PIP-05", f"""SELECT 'b=' || b AS file, 1 AS attempt, 'PROCESSED' AS processing_status, n AS total_records, n AS events, 'moved' AS found
 FROM (SELECT {FILE_OF} AS b, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'broken.gz', 3, 'FAILED', NULL, 0, 'aside'""")
def intake_bad_file(spark, sf):
    """Compressed files, one of them unreadable: the others are taken in and moved, it is tried three times and set aside."""
    home, inbox = work_path(spark, "intake-home"), work_path(spark, "inbox")
    rows = columns(spark, sf, "orders", {"b": FILE_OF, "k": "o_orderkey", "value": f"CAST(o_orderkey AS STRING) || ',' || {PRICE}"})
    rows.repartition("b").sortWithinPartitions("b", "k").select("b", "value").write.partitionBy("b").option("compression", "gzip").text(f"{inbox}/in")
    draft = f"{home}/draft"
    spark.range(1).select(F.lit("not compressed at all").alias("value")).coalesce(1).write.text(draft)
    files = Files(spark, inbox)
    files.move(f"{draft}/{next(n for n in files.names(draft) if n.startswith('part-'))}", f"{inbox}/in/broken.gz")
    spec = load_spec({"id": "in", "format": "CSV", "fields": [{"name": "id", "type": "LONG", "columnIndex": 0}, {"name": "price", "type": "DECIMAL", "columnIndex": 1}]})
    taker = intake.FolderIntake(spark, f"{inbox}/in", spec, home, aside=f"{inbox}/aside", after="MOVE", archive=f"{inbox}/moved")
    taker.run()
    kept = file_facts(spark, [f"{inbox}/moved", f"{inbox}/aside"], content=False).select(
        name_of(F.col("remote_file_path")).alias("file"), F.regexp_extract("remote_file_path", "/(moved|aside)/", 1).alias("found"))
    made = spark.read.option("basePath", f"{home}/events").parquet(f"{home}/events/poll=*")
    file = F.get_json_object("value", "$.fileName")
    events_of = made.groupBy(name_of(file).alias("file")).agg(F.count(F.lit(1)).alias("events"))
    told = taker.current().select(name_of(F.col("remote_file_path")).alias("file"), "attempt", "processing_status", "total_records")
    return told.join(events_of, "file", "left").fillna(0, ["events"]).join(kept, "file")
