"""Joins, ledger, registry, revisions, sets, paging and reconciliation.

Customers stand for integrations, orders for the files they delivered, parts for specs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from specflow.catalog.base import DAY, columns, register, select_sql, sql_stamp, stamp
from specflow.operators import ledger, reconcile, registry, revisions
from specflow.operators.dedup import first_seen
from specflow.operators.ordered import row_numbers
from specflow.session import table
from specflow.sinks.writers import upserted

FILES = {
    "integration_id": "o_custkey",
    "remote_file_name": "'F' || CAST(o_orderkey AS STRING) || '.csv'",
    "processing_status": "CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END",
    "downloaded_at": "o_orderdate",
    "file_size_bytes": "CAST(o_totalprice AS BIGINT)",
    "id": "o_orderkey",
}
FILES_SQL = f"WITH files AS ({select_sql('orders', FILES)}), known AS (SELECT * FROM files WHERE processing_status = 'PROCESSED') "
INTEGRATIONS = {
    "integration_id": "c_custkey",
    "type": "CASE c_mktsegment WHEN 'BUILDING' THEN 'SFTP' WHEN 'MACHINERY' THEN 'FTP' WHEN 'HOUSEHOLD' THEN 'S3' ELSE 'REST' END",
    "is_enabled": "c_acctbal > 0",
    "direction": "CASE WHEN c_nationkey < 12 THEN 'INBOUND' ELSE 'OUTBOUND' END",
    "name": "c_name",
}


def files(spark, sf):
    return columns(spark, sf, "orders", FILES)


def known(spark, sf):
    return files(spark, sf).filter("processing_status = 'PROCESSED'")


def integrations(spark, sf):
    return columns(spark, sf, "customer", INTEGRATIONS)


@register("join_ledger_anti", "JOI-01", FILES_SQL + "SELECT id FROM files f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.integration_id = f.integration_id AND k.remote_file_name = f.remote_file_name)")
def join_ledger_anti(spark, sf):
    return ledger.unseen(files(spark, sf), known(spark, sf)).select("id")


@register("join_ledger_semi", "JOI-02", FILES_SQL + "SELECT id FROM files WHERE (integration_id, remote_file_name) IN (SELECT integration_id, remote_file_name FROM known)")
def join_ledger_semi(spark, sf):
    return ledger.seen(files(spark, sf), known(spark, sf)).select("id")


@register("join_file_integration", "JOI-03", f"SELECT f.id, i.type, i.name FROM ({select_sql('orders', FILES)}) f JOIN ({select_sql('customer', INTEGRATIONS)}) i USING (integration_id) WHERE i.is_enabled")
def join_file_integration(spark, sf):
    """The join side is chosen at run time from its size: no hint."""
    side = integrations(spark, sf).filter("is_enabled").select("integration_id", "type", "name")
    return files(spark, sf).select("id", "integration_id").join(side, "integration_id").select("id", "type", "name")


SPECS = {
    "spec_id": "p_partkey", "name": "p_name",
    "format": "CASE p_type WHEN 'STANDARD' THEN 'CSV' WHEN 'LARGE' THEN 'FIXED_WIDTH' WHEN 'SMALL' THEN 'XML' WHEN 'MEDIUM' THEN 'DELIMITED' ELSE 'JSON' END",
    "n_fields": "p_size", "has_path": "p_retailprice > 1000", "rules": "CAST(length(p_name) AS INT)", "has_outbound": "p_size > 25",
}
SPECS_SQL = f"WITH specs AS ({select_sql('part', SPECS)}) "


def specs(spark, sf):
    """One spec per part; its size is the number of fields, odd fields lack an address when cheap."""
    base = columns(spark, sf, "part", SPECS)
    none = F.lit(None).cast("string")
    field = lambda i: F.struct(
        F.concat(F.lit("f"), i.cast("string")).alias("name"),
        F.when(F.col("format").isin("CSV", "DELIMITED") & (F.col("has_path") | (i > 3)), i.cast("int")).alias("column_index"),
        none.alias("column_name"),
        F.when(F.col("has_path"), i.cast("int")).alias("start_position"),
        F.lit(5).alias("length"),
        F.when(F.col("has_path"), F.lit("a/b")).alias("path"),
        none.alias("xml_attribute"),
    )
    listed = F.transform(F.sequence(F.lit(1), F.col("n_fields")), field)
    return base.select(
        "*", listed.cast(f"array<{registry.FIELD_DEF}>").alias("fields"),
        F.when(F.col("rules") > 9, F.create_map(F.lit("recordXPath"), F.lit("/r/x"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
        F.col("rules").alias("validation_rule_count"), F.lit(1).alias("correction_rule_count"))


BAD_FIELDS = """CASE WHEN has_path THEN 0 WHEN format IN ('CSV', 'DELIMITED') THEN least(n_fields, 3)
 WHEN format IN ('FIXED_WIDTH', 'XML') THEN n_fields ELSE 0 END + CASE WHEN format = 'XML' AND rules <= 9 THEN 1 ELSE 0 END"""


@register("spec_check", "VAL-23", SPECS_SQL + """
SELECT spec_id, 'f' || CAST(i AS VARCHAR) || ': ' || CASE WHEN format = 'FIXED_WIDTH' THEN 'needs startPosition' WHEN format = 'XML' THEN 'needs path or xmlAttribute' ELSE 'needs columnIndex or columnName' END AS problem
FROM (SELECT *, unnest(range(1, n_fields + 1)) AS i FROM specs) WHERE NOT has_path AND (format IN ('FIXED_WIDTH', 'XML') OR (format IN ('CSV', 'DELIMITED') AND i <= 3))
UNION ALL SELECT spec_id, 'metadata key recordXPath is missing' FROM specs WHERE format = 'XML' AND rules <= 9""")
def spec_check(spark, sf):
    return registry.spec_problems(specs(spark, sf))


@register("spec_report", "VAL-24", SPECS_SQL + f"SELECT spec_id, CAST({BAD_FIELDS} AS BIGINT) AS n_issues, ({BAD_FIELDS}) = 0 AS is_valid, n_fields AS field_count, rules AS validation_rule_count, 1 AS correction_rule_count FROM specs")
def spec_report(spark, sf):
    return registry.spec_report(specs(spark, sf))


@register("spec_counts", "AGG-09", SPECS_SQL + "SELECT format, count(*) AS n_specs, sum(n_fields)::BIGINT AS n_fields, sum(rules)::BIGINT AS n_rules FROM specs GROUP BY 1")
def spec_counts(spark, sf):
    return specs(spark, sf).groupBy("format").agg(
        F.count(F.lit(1)).alias("n_specs"), F.sum(F.size("fields")).alias("n_fields"), F.sum("validation_rule_count").alias("n_rules"))


@register("spec_directions", "SET-04", SPECS_SQL + """SELECT 'INBOUND' AS direction, count(*) AS n FROM specs WHERE n_fields > 0
 UNION ALL SELECT 'OUTBOUND', count(*) FROM specs WHERE has_outbound UNION ALL SELECT 'BIDIRECTIONAL', count(*) FROM specs WHERE n_fields > 0 AND has_outbound""")
def spec_directions(spark, sf):
    all_specs = specs(spark, sf).select("spec_id", "has_outbound", F.size("fields").alias("n"))
    inbound, outbound = F.col("n") > 0, F.col("has_outbound")
    kinds = F.array_compact(F.array(F.when(inbound, F.lit("INBOUND")), F.when(outbound, F.lit("OUTBOUND")), F.when(inbound & outbound, F.lit("BIDIRECTIONAL"))))
    return all_specs.select(F.explode(kinds).alias("direction")).groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@register("join_spec", "JOI-04", SPECS_SQL + "SELECT format, count(*) AS n_records FROM lineitem JOIN specs ON l_partkey = spec_id GROUP BY 1")
def join_spec(spark, sf):
    side = columns(spark, sf, "part", {"spec_id": SPECS["spec_id"], "format": SPECS["format"]})
    joined = table(spark, sf, "lineitem").select("l_partkey").join(side, F.col("l_partkey") == F.col("spec_id"))
    return joined.groupBy("format").agg(F.count(F.lit(1)).alias("n_records"))


EXPECT = """WITH expected AS (SELECT l_orderkey AS id, max(l_linenumber)::BIGINT AS expected_count FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
 actual AS (SELECT l_orderkey AS id, count(*) AS actual_count FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
 both_ AS (SELECT coalesce(e.id, a.id) AS id, coalesce(expected_count, 0) AS expected_count, coalesce(actual_count, 0) AS actual_count FROM expected e FULL JOIN actual a ON e.id = a.id)"""


def _counts(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_returnflag", "l_linestatus")
    expected = items.filter("l_returnflag <> 'A'").groupBy("id").agg(F.max("l_linenumber").cast("bigint").alias("expected_count"))
    actual = items.filter("l_linestatus = 'F'").groupBy("id").agg(F.count(F.lit(1)).alias("actual_count"))
    return reconcile.counts(expected, actual, ["id"])


@register("join_reconcile", "JOI-05", EXPECT + " SELECT * FROM both_")
def join_reconcile(spark, sf):
    return _counts(spark, sf)


@register("reconcile_counts", "AGG-10", EXPECT + """ SELECT *, CASE WHEN abs(actual_count - expected_count) <= 1 OR abs(actual_count - expected_count) * 100 <= expected_count * 40.0 THEN 'PASS' ELSE 'WARN' END AS verdict FROM both_""")
def reconcile_counts(spark, sf):
    return reconcile.verdict(_counts(spark, sf), "WARN_AND_CONTINUE", absolute=1, percent=40.0)


@register("control_totals", "AGG-11", """SELECT o_custkey AS id, count(*) + CASE WHEN min(o_totalprice) < 5000 THEN 1 ELSE 0 END AS declared_count,
 sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS declared_sum, count(*) AS actual_count, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS actual_sum, min(o_totalprice) >= 5000 AS balanced
 FROM orders GROUP BY o_custkey""")
def control_totals(spark, sf):
    orders = columns(spark, sf, "orders", {"id": "o_custkey", "cents": "CAST(round(o_totalprice * 100) AS BIGINT)"})
    declared = orders.groupBy("id").agg(
        (F.count(F.lit(1)) + F.when(F.min("cents") < 500_000, 1).otherwise(0)).alias("declared_count"), F.sum("cents").alias("declared_sum"))
    return reconcile.control_totals(orders, declared, "id", F.col("cents"))


@register("join_profile", "JOI-09", """WITH a AS (SELECT c_custkey, c_nationkey, (c_custkey * 7) % (SELECT count(*) FROM supplier) + 1 AS target FROM customer)
 SELECT n_name AS profile, count(DISTINCT c_custkey) AS n_actions, count(s_suppkey) AS n_allowed, count(DISTINCT s_suppkey) AS n_integrations_used
 FROM nation JOIN a ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey = target GROUP BY 1""")
def join_profile(spark, sf):
    """Actions of a profile name the integration they work on; allowed are those on the profile's own list.

    Lists are cut into chunks by id, so no row holds an unbounded one; exploded, they join by profile and id.
    """
    suppliers = table(spark, sf, "supplier")
    chunk = F.floor(F.col("s_suppkey") / 1000)
    lists = suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey"), chunk.alias("chunk")).agg(F.collect_list("s_suppkey").alias("ids"))
    target = F.col("c_custkey") * 7 % suppliers.count() + 1
    actions = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), target.alias("target"))
    members = lists.select("n_nationkey", F.explode("ids").alias("target")).withColumn("member", F.col("target"))
    joined = actions.join(members, ["n_nationkey", "target"], "left").join(table(spark, sf, "nation"), "n_nationkey")
    return joined.groupBy(F.col("n_name").alias("profile")).agg(
        F.count(F.lit(1)).alias("n_actions"), F.count("member").alias("n_allowed"), F.count_distinct("member").alias("n_integrations_used"))


@register("join_orphans", "JOI-13", "SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def join_orphans(spark, sf):
    return ledger.orphans(files(spark, sf), integrations(spark, sf).filter("is_enabled")).select("id")


@register("reg_direction", "RTE-07", f"SELECT integration_id, type FROM ({select_sql('customer', INTEGRATIONS)}) WHERE direction = 'INBOUND'")
def reg_direction(spark, sf):
    return integrations(spark, sf).filter("direction = 'INBOUND'").select("integration_id", "type")


@register("integration_summary", "AGG-08", f"""SELECT t.type, count(i.type) AS n, count(*) FILTER (WHERE is_enabled) AS n_enabled,
 CASE WHEN count(i.type) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE is_enabled) / count(i.type), 9) END AS enabled_share
 FROM (VALUES ('SFTP'), ('FTP'), ('FTPS'), ('S3'), ('REST')) t(type) LEFT JOIN ({select_sql('customer', INTEGRATIONS)}) i ON i.type = t.type GROUP BY t.type""")
def integration_summary(spark, sf):
    done = registry.integration_summary(integrations(spark, sf), ["SFTP", "FTP", "FTPS", "S3", "REST"])
    return done.withColumn("enabled_share", F.round("enabled_share", 9))


@register("profile_counts", "AGG-27", """SELECT n_name AS profile, coalesce(c.n, 0) AS spec_count, coalesce(s.n, 0) AS integration_count FROM nation
 LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def profile_counts(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"))
    joined = table(spark, sf, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(F.col("n_name").alias("profile"), F.coalesce("c", zero).alias("spec_count"), F.coalesce("s", zero).alias("integration_count"))


# --- ledger ---------------------------------------------------------------------------

@register("ledger_status", "AGG-07", FILES_SQL + "SELECT integration_id, processing_status, count(*) AS n_files FROM files GROUP BY ALL")
def ledger_status(spark, sf):
    return ledger.status_counts(files(spark, sf))


@register("queue_pending", "SRT-02", FILES_SQL + f"SELECT id, {sql_stamp('downloaded_at')} AS downloaded_at FROM files WHERE processing_status = 'PENDING' ORDER BY files.downloaded_at, id LIMIT 50")
def queue_pending(spark, sf):
    return ledger.pending(files(spark, sf), 50, ["downloaded_at", "id"]).select("id", stamp(F.col("downloaded_at")).alias("downloaded_at"))


@register("ledger_append", "SET-06", FILES_SQL + "SELECT processing_status, count(*) AS n, sum(integration_id)::BIGINT AS ids FROM (SELECT integration_id, processing_status FROM known UNION ALL SELECT integration_id, 'PENDING' FROM files WHERE processing_status <> 'PROCESSED') GROUP BY 1")
def ledger_append(spark, sf):
    """The listing repeats every file; the ledger gains each new one once."""
    listing = files(spark, sf).select("integration_id", "remote_file_name", "downloaded_at", "id")
    twice = listing.unionByName(listing)
    base = known(spark, sf).select("integration_id", "remote_file_name", "downloaded_at", "id", "processing_status")
    done = ledger.append(twice, base, ["downloaded_at", "id"])
    return done.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"), F.sum("integration_id").alias("ids"))


MOVES_SQL = """WITH history AS (SELECT l_orderkey AS id, l_shipdate AS happened, l_linenumber AS no, l_partkey AS p,
 CASE l_returnflag WHEN 'N' THEN 'PROCESSING' WHEN 'A' THEN 'PROCESSED' ELSE 'FAILED' END AS status FROM lineitem)"""


def _history(spark, sf):
    status = "CASE l_returnflag WHEN 'N' THEN 'PROCESSING' WHEN 'A' THEN 'PROCESSED' ELSE 'FAILED' END"
    return columns(spark, sf, "lineitem", {"id": "l_orderkey", "at": "l_shipdate", "no": "l_linenumber", "p": "l_partkey", "processing_status": status})


@register("ledger_transition", "STR-21", MOVES_SQL + """ SELECT id, status AS processing_status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY happened DESC, no DESC, p DESC, status DESC) AS rn FROM history) WHERE rn = 1""")
def ledger_transition(spark, sf):
    return ledger.current_status(_history(spark, sf), ["id"], ["at", "no", "p", "processing_status"])


# --- revisions, sets, paging --------------------------------------------------------------

REVISIONS = "SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderpriority AS body FROM orders"


def _revisions(spark, sf):
    rows = columns(spark, sf, "orders", {"id": "o_custkey", "at": "o_orderdate", "k": "o_orderkey", "body": "o_orderpriority"})
    return row_numbers(rows, ("id",), ("at", "k"), "version").select("id", "version", "body")


@register("rev_latest", "WIN-02", f"SELECT id, version, body FROM ({REVISIONS}) QUALIFY version = max(version) OVER (PARTITION BY id)")
def rev_latest(spark, sf):
    return revisions.latest(_revisions(spark, sf), ["id"], "version")


@register("rev_rollback", "WIN-02", f"""WITH r AS ({REVISIONS}) SELECT r.id, m.top + 1 AS version, r.body, CAST(2 AS BIGINT) AS restored_from FROM r
 JOIN (SELECT id, max(version) AS top FROM r GROUP BY 1) m ON m.id = r.id WHERE r.version = 2""")
def rev_rollback(spark, sf):
    return revisions.rollback(_revisions(spark, sf), ["id"], "version", 2, ["body"])


DIFF_SQL = f"""WITH r AS ({REVISIONS}), a AS (SELECT id, version, body FROM r WHERE body <> '5-LOW'), b AS (SELECT id, version - 1 AS version, body FROM r WHERE version > 1 AND body <> '1-URGENT')
 SELECT coalesce(a.id, b.id) AS id, coalesce(a.version, b.version) AS version, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change,
 a.body AS old_value, b.body AS new_value FROM a FULL JOIN b ON a.id = b.id AND a.version = b.version WHERE a.body IS DISTINCT FROM b.body"""


@register("rev_diff", "SET-08, JOI-11", DIFF_SQL)
def rev_diff(spark, sf):
    """Every revision against the next one of the same id."""
    r = _revisions(spark, sf)
    old = r.filter("body <> '5-LOW'")
    new = r.filter("version > 1 and body <> '1-URGENT'").withColumn("version", F.col("version") - 1)
    return revisions.diff(old, new, ["id", "version"], "body")


@register("join_revision_diff", "JOI-11", f"""WITH r AS ({REVISIONS}) SELECT n.id, n.version, o.body AS old_value, n.body AS new_value FROM r n JOIN r o ON o.id = n.id AND o.version = n.version - 1 WHERE o.body <> n.body""")
def join_revision_diff(spark, sf):
    r = _revisions(spark, sf)
    old = r.select("id", (F.col("version") + 1).alias("version"), F.col("body").alias("old_value"))
    return r.withColumnRenamed("body", "new_value").join(old, ["id", "version"]).filter("old_value <> new_value")


@register("page_list", "SRT-01", "SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 75")
def page_list(spark, sf):
    return revisions.page(columns(spark, sf, "part", {"id": "p_partkey", "name": "p_name"}), ["name", "id"], 3, 25)


@register("page_after", "SRT-01", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey > 74 ORDER BY p_partkey LIMIT 25")
def page_after(spark, sf):
    return revisions.page_after(columns(spark, sf, "part", {"id": "p_partkey", "name": "p_name"}), "id", 74, 25)


@register("set_union", "SET-01", "SELECT source, count(*) AS n FROM (SELECT 'customer' AS source, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part) GROUP BY 1")
def set_union(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(t).alias("source"), F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("sink_upsert", "SNK-03", """SELECT id, status, price FROM (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice * 100 AS BIGINT) AS price FROM orders) t
 WHERE id NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT l_orderkey, max_by(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_linestatus, CAST(l_extendedprice * 100 AS BIGINT))), max_by(CAST(l_extendedprice * 100 AS BIGINT), (l_shipdate, l_linenumber, l_partkey, l_linestatus, CAST(l_extendedprice * 100 AS BIGINT))) FROM lineitem GROUP BY 1""")
def sink_upsert(spark, sf):
    """Orders updated from the latest line item of each order."""
    target = columns(spark, sf, "orders", {"id": "o_orderkey", "status": "o_orderstatus", "price": "CAST(round(o_totalprice * 100) AS BIGINT)"})
    source = columns(spark, sf, "lineitem", {"id": "l_orderkey", "at": "l_shipdate", "no": "l_linenumber", "p": "l_partkey", "status": "l_linestatus", "price": "CAST(round(l_extendedprice * 100) AS BIGINT)"})
    return upserted(target, source, ["id"], ["at", "no", "p", "status", "price"])


@register("set_exists_formats", "SET-05", SPECS_SQL + "SELECT format, count(*) AS n FROM specs WHERE format IN ('CSV', 'DELIMITED', 'FIXED_WIDTH', 'JSON', 'XML') GROUP BY 1")
def set_exists_formats(spark, sf):
    """Specs whose format has a registered reader."""
    from specflow.sources import supported_formats

    return specs(spark, sf).filter(F.col("format").isin(*supported_formats())).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@register("first_delivery", "SET-02, JOI-01", f"SELECT o_custkey AS integration_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS id, min({DAY}) AS day FROM orders GROUP BY 1")
def first_delivery(spark, sf):
    rows = columns(spark, sf, "orders", {"integration_id": "o_custkey", "id": "o_orderkey", "day": DAY})
    return first_seen(rows, ["integration_id"], ["day", "id"])
