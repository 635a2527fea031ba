"""Bank formats read as typed lines, tagged messages and segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.functions import text
from specflow.operators.coerce import Extra, coerce
from specflow.operators.ordered import running_sum, running_sums
from specflow.operators.records import issue, literal
from specflow.session import stored
from specflow.sources.delimited import finish
from specflow.sources.fixed_width import parse_fixed_width
from specflow.sources.lines import file_heads, files_by, number_lines, read_lines
from specflow.spec import FieldSpec, FileSpec

# Record type codes in the first character of a line.
NACHA_TYPES = {"1": "FILE_HEADER", "5": "BATCH_HEADER", "6": "ENTRY", "7": "ADDENDA", "8": "BATCH_CONTROL", "9": "FILE_CONTROL"}

# Cells of an entry detail record in the public 94-column layout (1-based start, length).
NACHA_ENTRY = (
    ("recordType", 1, 1, "STRING"),
    ("code", 2, 2, "STRING"),
    ("routing", 4, 9, "ROUTING_NUMBER"),
    ("account", 13, 17, "ACCOUNT_NUMBER"),
    ("amount", 30, 10, "AMOUNT"),
    ("individualId", 40, 15, "STRING"),
    ("individualName", 55, 22, "STRING"),
    ("discretionary", 77, 2, "STRING"),
    ("addenda", 79, 1, "STRING"),
    ("trace", 80, 15, "STRING"),
)


OPTIONAL = ("individualId", "discretionary")


def nacha_entry_spec(spec_id: str = "nacha-entry") -> FileSpec:
    made = tuple(
        FieldSpec(name=n, type=t, start_position=s, length=k, scale=2 if t == "AMOUNT" else None,
                  required=n not in OPTIONAL, nullable=n in OPTIONAL)
        for n, s, k, t in NACHA_ENTRY
    )
    return FileSpec(id=spec_id, name=spec_id, format="FIXED_WIDTH", fields=made, position_base=1)


def nacha_lines(lines: DataFrame, order: tuple[str, ...] = ("_seq",)) -> DataFrame:
    """Adds the record type and the running batch number (type-5 lines so far in the file)."""
    kind = F.substring("_raw", 1, 1)
    names = F.create_map(*[F.lit(x) for pair in NACHA_TYPES.items() for x in pair])
    typed = lines.select("*", kind.alias("_kind"), F.element_at(names, kind).alias("record_type"))
    return running_sum(typed, ("_file",), order, (F.col("_kind") == "5").cast("bigint"), "_batch")


def nacha_entries(lines: DataFrame, spec: FileSpec | None = None) -> DataFrame:
    """Entry detail records; ``_batch`` rides along."""
    entries = nacha_lines(lines).filter(F.col("_kind") == "6")
    return parse_fixed_width(entries, spec or nacha_entry_spec(), keep=("_batch",))


def swift_tags(message: Column) -> Column:
    """``:tag:value`` blocks of a message as an array of (tag, value), in message order."""
    blocks = F.regexp_extract_all(message, F.lit(r"(?s)(:\d{2}[A-Z]?:.*?)(?=\r?\n:\d{2}[A-Z]?:|\r?\n-\}|\r?\n-\s*$|\z)"), F.lit(1))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, r"^:(\d{2}[A-Z]?):", 1).alias("tag"),
            F.btrim(F.regexp_extract(b, r"(?s)^:\d{2}[A-Z]?:(.*)$", 1), F.lit(" \r\n")).alias("value"),
        ),
    )


def _tagged(tag: str):
    return lambda block: block["tag"] == tag


def swift_records(messages: DataFrame, spec: FileSpec) -> DataFrame:
    """One record per message; a field's path is the tag it takes (first occurrence)."""
    tagged = messages.select("_file", "_seq", "_raw", swift_tags(F.col("_raw")).alias("_tags"))
    cells = tagged.select(
        "_file", "_seq", "_raw",
        *[
            text.trim(F.get(F.filter("_tags", _tagged(f.path)), F.lit(0)).getField("value")).alias(f"_r{k}")
            for k, f in enumerate(spec.fields)
        ],
    )
    return finish(cells, spec, [coerce(f, f"_r{k}", False) for k, f in enumerate(spec.fields)])


#: stands in every X12 file at short intervals, so text cut at it comes in short rows
TRANSACTION = "ST"
NO_HEADER = "No interchange header of full length at the start of the file"


def x12_dialects(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    """_file, _element and _segment: the separators as each file's interchange header spells them, null without one.

    The header has fixed columns: its fourth character parts elements, its 106th ends segments.
    """
    heads = file_heads(spark, paths, TRANSACTION, glob, least=106)
    isa = F.regexp_replace("_head", "^\ufeff", "")
    whole = F.startswith(isa, F.lit("ISA")) & (F.length(isa) >= 105)
    end = F.when(F.length(isa) > 105, F.substring(isa, 106, 1)).otherwise("\n")
    return heads.select("_file", F.when(whole, F.substring(isa, 4, 1)).alias("_element"), F.when(whole, end).alias("_segment"))


def read_x12(spark: SparkSession, paths: list[str], spec: FileSpec, glob: str | None = None) -> DataFrame:
    """Records of files that may each have separators of their own; a file without a header gives one record with an error."""
    heads = stored(x12_dialects(spark, paths, glob), "dialects")
    dialects = files_by(heads, "_element", "_segment")
    found = []
    for (element, segment), own in dialects.items():
        if element is None:
            found.append(_headless(heads if own is None else heads.filter("_element IS NULL"), spec))
            continue
        lines = read_lines(spark, own or paths, spec.encoding, segment, None if own else glob)
        found.append(x12_records(number_lines(lines)[0], spec, element))
    if not found:
        return _headless(heads, spec)
    return reduce(DataFrame.unionByName, found)


def _headless(files: DataFrame, spec: FileSpec) -> DataFrame:
    """A record without values for each file."""
    none = F.lit(None).cast("string")
    rows = files.select("_file")
    cells = rows.select("_file", F.lit(0).cast("bigint").alias("_seq"), none.alias("_raw"), *[none.alias(f"_r{k}") for k in range(len(spec.fields))])
    made = [coerce(f, f"_r{k}", False) for k, f in enumerate(spec.fields)]
    return finish(cells, spec, made, more=(Extra(F.lit(True), issue("interchange", literal(NO_HEADER), "FATAL"), fatal=True),))


def x12_records(lines: DataFrame, spec: FileSpec, element_sep: str) -> DataFrame:
    """One record per segment that the spec's ``recordSegment`` names; a field's path is the element's number, from 1.

    Paths ``interchange``, ``group`` and ``transaction`` give the running envelope numbers.
    """
    envelopes = {"interchange": "interchange_no", "group": "group_no", "transaction": "transaction_no"}
    cut = x12_segments(lines, element_sep=element_sep).filter(F.col("segment_id") == spec.metadata["recordSegment"])

    def raw(f: FieldSpec) -> Column:
        if f.path in envelopes:
            return F.col(envelopes[f.path]).cast("string")
        return text.trim(F.nullif(F.get("elements", F.lit(int(f.path) - 1)), F.lit("")))

    cells = cut.select("_file", "_seq", "_raw", *[raw(f).alias(f"_r{k}") for k, f in enumerate(spec.fields)])
    return finish(cells, spec, [coerce(f, f"_r{k}", False) for k, f in enumerate(spec.fields)])


def x12_segments(lines: DataFrame, order: tuple[str, ...] = ("_seq",), element_sep: str = "*") -> DataFrame:
    """Segments with their envelope numbers. ``lines`` holds one segment per row.

    Read files with the segment terminator as line separator; interchange, group and
    transaction numbers are running counts of ISA, GS and ST over the file.
    """
    body = F.btrim("_raw", F.lit(" \r\n"))
    parts = F.split(body, rf"\Q{element_sep}\E", -1)
    cut = lines.filter(body != "").select("*", parts.alias("_parts"), F.get(parts, F.lit(0)).alias("segment_id"))
    counted = {"interchange_no": "ISA", "group_no": "GS", "transaction_no": "ST"}
    steps = {out: (F.col("segment_id") == opener).cast("bigint") for out, opener in counted.items()}
    cut = running_sums(cut, ("_file",), order, steps)
    return cut.withColumn("elements", F.slice("_parts", F.lit(2), F.size("_parts"))).drop("_parts")
