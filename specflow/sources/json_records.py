"""JSON lines and JSON documents to records, addressed by JSONPath.

A document is an array of records, or records one behind the other, over any number of lines. It
is read as text cut behind every ``}``, so a large one splits across tasks. Running sums tell each
piece where it stands: quotes counted by parity say whether it begins within a string, braces and
brackets outside strings give the depth. A record ends where the depth is back at the document's
own; the pieces up to there are put together. Elements that are no objects come back as records
with errors, each by itself; a document whose braces do not match ends in one such record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.functions import text
from specflow.operators.coerce import coerce
from specflow.operators.ordered import running_sum, running_sums
from specflow.session import stored
from specflow.sources.delimited import finish
from specflow.sources.lines import attach, file_heads, files_by, number_lines, place, read_lines, split_table
from specflow.spec import FileSpec

_SIMPLE = re.compile(r"^\$((?:\.[A-Za-z_]\w*)+)$")


def _tree(paths: list[list[str]]) -> dict:
    tree: dict = {}
    for path in paths:
        node = tree
        for step in path:
            node = node.setdefault(step, {})
    return tree


def _ddl(tree: dict) -> str:
    inner = ",".join(f"`{k}`:{_ddl(v) if v else 'string'}" for k, v in tree.items())
    return f"struct<{inner}>"


def json_values(spec: FileSpec, body: Column) -> tuple[Column, list[Column]]:
    """(parsed struct, value per field): one parse serves all plain dotted paths."""
    paths = [f.path or f"$.{f.name}" for f in spec.fields]
    plain = {p: m.group(1).strip(".").split(".") for p in paths if (m := _SIMPLE.match(p))}
    # a path that is also a prefix of another must stay text, so it is read on its own
    steps = list(plain.values())
    nested = [s for s in steps if not any(o != s and o[: len(s)] == s for o in steps)]
    tree = _tree(nested)
    parsed = F.from_json(body, _ddl(tree)) if tree else F.lit(None)
    values = []
    for p in paths:
        if p in plain and plain[p] in nested:
            column = F.col("_json")
            for step in plain[p]:
                column = column.getField(step)
            values.append(column)
        else:
            values.append(F.get_json_object(body, p))
    return parsed, values


def parse_json_lines(lines: DataFrame, spec: FileSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    parsed, values = json_values(spec, F.col("_raw"))
    cells = lines.select("_file", "_seq", "_raw", *keep, parsed.alias("_json")).select(
        "_file", "_seq", "_raw", *keep, *[text.trim(v.cast("string")).alias(f"_r{k}") for k, v in enumerate(values)]
    )
    made = [coerce(f, f"_r{k}", False) for k, f in enumerate(spec.fields)]
    return finish(cells, spec, made, keep)


# JSON's strings without escapes, a string's end, what opens and closes a level.
ESCAPE, STRING, OPEN_STRING, STRING_END = r"(?s)\\.", r'"[^"]*+"', r'"[^"]*+$', r'^[^"]*+(?:"|$)'
CLOSE = "}"


def _levels(body: Column) -> Column:
    """How many levels a text without escapes opens more than it closes, strings aside."""
    bare = F.regexp_replace(F.regexp_replace(body, STRING, ""), OPEN_STRING, "")
    return F.regexp_count(bare, F.lit(r"[{\[]")).cast("bigint") - F.regexp_count(bare, F.lit(r"[}\]]")).cast("bigint")


def document_pieces(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """_file, _nth and _text: documents cut behind each closing brace."""
    lines = read_lines(spark, paths, encoding, CLOSE, glob, sizes=True)
    facts = split_table(lines, more={"_read": F.sum(F.col("_bytes") + 1), "_file_bytes": F.max("_file_bytes")})
    files = facts.groupBy("_file").agg(F.sum("_lines").alias("_all"), (F.max("_file_bytes") - F.sum("_read")).alias("_more"))
    # the last piece has a brace unless the bytes say that the file ends without one; three of them may be a mark at its start
    whole = files.select("_file", (F.col("_all") - 1).alias("_last"), F.col("_more").isin(0, 3).alias("_closed"))
    facts = stored(facts.join(whole, "_file"), "json-splits")
    pieces = attach(lines, facts, "_first", "_lines", "_offset", "_last", "_closed")
    pieces = pieces.select("_file", place("_offset", "_id", "_first", "_lines").alias("_nth"), "_raw", "_last", "_closed")
    body = F.when((F.col("_nth") < F.col("_last")) | F.col("_closed"), F.concat("_raw", F.lit(CLOSE))).otherwise(F.col("_raw"))
    return pieces.select("_file", "_nth", body.alias("_text"), (F.col("_nth") == F.col("_last")).alias("_ends"))


def read_documents(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """_file, _seq and _raw: one element of a document per row, numbered per file from 0."""
    pieces = document_pieces(spark, paths, encoding, glob)
    plain = F.regexp_replace("_text", ESCAPE, "")
    marks = stored(pieces.select(
        "_file", "_nth", F.regexp_count(plain, F.lit('"')).cast("bigint").alias("quotes"), _levels(plain).alias("outside"),
        _levels(F.regexp_replace(plain, STRING_END, "")).alias("inside"),
        F.when(F.col("_nth") == 0, F.startswith(F.regexp_replace("_text", r"^\s+", ""), F.lit("["))).alias("array"),
    ), "json-marks")
    base = marks.filter("_nth = 0").select("_file", F.col("array").cast("bigint").alias("_base"))
    quotes = running_sums(marks, ("_file",), ("_nth",), {"_quotes": F.col("quotes")})
    within = (F.col("_quotes") - F.col("quotes")) % 2 == 1
    levels = running_sum(quotes.withColumn("change", F.when(within, F.col("inside")).otherwise(F.col("outside"))), ("_file",), ("_nth",), F.col("change"), "_depth")
    ends = ((F.col("_depth") == F.col("_base")) & (F.col("_quotes") % 2 == 0)).cast("bigint")
    placed = stored(levels.join(base, "_file").select("_file", "_nth", "_base", ends.alias("_end")), "json-ends")
    numbered = running_sum(placed, ("_file",), ("_nth",), F.col("_end"), "_upto")
    numbered = stored(numbered.select("_file", "_nth", "_base", (F.col("_upto") - F.col("_end")).alias("_no")), "json-numbers")
    sizes = numbered.groupBy("_file", "_no").agg((F.count(F.lit(1)) > 1).alias("_many"))
    numbered = stored(numbered.join(sizes.hint("merge"), ["_file", "_no"]), "json-sizes")

    # the texts are shuffled by their number, whose key is one piece
    told = pieces.join(numbered.hint("merge"), ["_file", "_nth"])
    single = told.filter(~F.col("_many")).select("_file", "_no", "_base", "_ends", "_text")
    part = F.struct("_nth", "_text")
    joined = told.filter("_many").groupBy("_file", "_no", "_base").agg(
        F.max("_ends").alias("_ends"), F.array_sort(F.collect_list(part)).alias("_parts"))
    body = F.array_join(F.transform("_parts", lambda p: p["_text"]), "")
    records = single.unionByName(joined.select("_file", "_no", "_base", "_ends", body.alias("_text")))

    array = F.col("_base") == 1
    kept = F.when(array & (F.col("_no") == 0), F.regexp_replace("_text", r"^\s*\[", "")).otherwise(F.col("_text"))
    kept = F.when(array & F.col("_ends"), F.regexp_replace(kept, r"\]\s*$", "")).otherwise(kept)
    kept = F.regexp_replace(F.regexp_replace(kept, r"^[\s,]+", ""), r"[\s,]+$", "")
    # an object ends its record, so what begins with one is one; before it, or behind the last, other elements may stand
    others = F.coalesce(F.from_json(F.concat(F.lit("["), "_kept", F.lit("]")), "array<string>"), F.array("_kept"))
    elements = F.when(F.col("_kept") == "", F.array().cast("array<string>")).when(F.startswith("_kept", F.lit("{")), F.array("_kept")).otherwise(others)
    cut = stored(records.select("_file", "_no", kept.alias("_kept")).select("_file", "_no", elements.alias("_elements")), "json-records")
    if cut.filter(F.size("_elements") != 1).isEmpty():
        return cut.select("_file", F.col("_no").alias("_seq"), F.get("_elements", F.lit(0)).alias("_raw"))
    sizes = running_sum(cut.select("_file", "_no", F.size("_elements").cast("bigint").alias("_size")), ("_file",), ("_no",), F.col("_size"), "_upto")
    first = sizes.select("_file", "_no", (F.col("_upto") - F.col("_size")).alias("_first"))
    every = cut.join(first, ["_file", "_no"]).select("_file", "_first", F.posexplode("_elements").alias("_at", "_raw"))
    return every.select("_file", (F.col("_first") + F.col("_at")).alias("_seq"), "_raw")


def is_document(head: Column) -> Column:
    """Whether a file is no sequence of lines with a record each, by its text up to the first closing brace."""
    start = F.regexp_replace(head, r"^[\s\ufeff]+", "")
    return F.startswith(start, F.lit("[")) | (F.startswith(start, F.lit("{")) & F.contains(start, F.lit("\n")))


def read_json(spark: SparkSession, paths: str | list[str], spec: FileSpec, glob: str | None = None) -> DataFrame:
    """Records of files of both kinds; ``"jsonLayout"`` in the spec's metadata, LINES or DOCUMENT, forgoes the look at each file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    layout = spec.metadata.get("jsonLayout", "").upper()

    def of_lines(own: list[str], names: str | None) -> DataFrame:
        lines = read_lines(spark, own, spec.encoding, spec.record_separator, names)
        return number_lines(lines, spec.skip_lines_count, spec.has_header)[0].select("_file", "_seq", "_raw")

    if layout == "DOCUMENT":
        return parse_json_lines(read_documents(spark, paths, spec.encoding, glob), spec)
    if layout == "LINES" or spec.skip_lines_count or spec.has_header:
        return parse_json_lines(of_lines(paths, glob), spec)
    kinds = files_by(file_heads(spark, paths, CLOSE, glob).withColumn("_whole", is_document(F.col("_head"))), "_whole")
    if (True,) not in kinds:
        return parse_json_lines(of_lines(paths, glob), spec)
    rows = read_documents(spark, kinds[True,] or paths, spec.encoding, None if kinds[True,] else glob)
    return parse_json_lines(rows.unionByName(of_lines(kinds[False,], None)) if (False,) in kinds else rows, spec)
