"""XML records: record-sized chunks, one parse per record, fields by path.

Files are read as text with the record's closing tag as line separator, so large
documents split across tasks and no task holds a whole document. Records that are all empty
elements have no closing tag; ``"emptyRecords": "true"`` in the spec's metadata cuts at ``/>``.

That tag may also stand in a comment, in character data or in an attribute. A chunk is therefore a
transition between the states that markup can be in; composed in parallel over a file they tell
the state each chunk begins in, and chunks that begin amid markup are glued to those before them.
Where no chunk ends amid markup, which the first scan counts, nothing has to be composed.

The chunks are cut again where a record or a header's block opens. Running sums of what each
piece opens and closes tell the path that every record stands on and the block it belongs to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.operators.coerce import Extra, coerce_xml
from specflow.operators.records import issue, literal, quoted
from specflow.operators.ordered import carried_states, row_numbers, running_sum, running_sums
from specflow.session import joinable, stored
from specflow.sources.delimited import finish
from specflow.sources.lines import attach, place, read_lines, split_table
from specflow.spec import FieldSpec, FileSpec, require_valid

_CALL = re.compile(r"^(?!text\(|node\(|comment\()[\w\-]+\(")
_STEP = re.compile(r"^[A-Za-z_][\w.\-]*$")


def record_path(spec: FileSpec) -> list[str]:
    return spec.metadata["recordXPath"].strip("/").split("/")


def record_tag(spec: FileSpec) -> str:
    return record_path(spec)[-1]


def header_tag(spec: FileSpec, f: FieldSpec) -> str | None:
    """Element that holds a document-level field: the first step below the records' own branch."""
    if f.path is None or not f.path.startswith("/"):
        return None
    record = spec.metadata["recordXPath"].strip("/").split("/")
    steps = f.path.strip("/").split("/")
    if steps[: len(record)] == record:
        return None
    shared = 0
    while shared < min(len(record), len(steps) - 1) and record[shared] == steps[shared]:
        shared += 1
    return steps[shared]


def block_tag(spec: FileSpec, f: FieldSpec) -> str | None:
    """Element around a document-level field that is nearest to the records: the last step both paths share."""
    if header_tag(spec, f) is None:
        return None
    record, steps = record_path(spec), f.path.strip("/").split("/")
    shared = steps.index(header_tag(spec, f))
    return record[shared - 1] if shared else record[0]


def relative_path(spec: FileSpec, f: FieldSpec) -> str | None:
    """Field path below the record (or below its header element)."""
    if f.path is None:
        return None
    if not f.path.startswith("/"):
        return f.path.removeprefix("./")
    steps = f.path.strip("/").split("/")
    tag = header_tag(spec, f)
    if tag is not None:
        return "/".join(steps[steps.index(tag) + 1 :])
    return "/".join(steps[len(spec.metadata["recordXPath"].strip("/").split("/")) :])


def _plain(path: str) -> list[str] | None:
    """Steps of a path made of names and a final attribute; None for any other XPath."""
    steps = [s for s in path.split("/") if s not in ("", ".")]
    if steps and steps[-1] == "text()":
        steps = steps[:-1]
    names = [s for s in steps if not s.startswith("@")]
    attributes_inside = any(s.startswith("@") for s in steps[:-1])
    if attributes_inside or not steps or not all(_STEP.match(n.removeprefix("@")) for n in steps):
        return None
    return names + [s for s in steps if s.startswith("@")]


def _schema(paths: list[list[str]]) -> tuple[str, dict]:
    """Every element is an array, so repeats keep document order; leaves carry text and attributes."""
    tree: dict = {}
    for path in paths:
        node = tree
        for step in path:
            node = node.setdefault(step, {})

    def ddl(node: dict) -> str:
        inner = []
        for name, child in node.items():
            if name.startswith("@"):
                inner.append(f"`_{name[1:]}`:string")
            elif not child:
                inner.append(f"`{name}`:array<string>")
            elif all(k.startswith("@") for k in child):
                inner.append(f"`{name}`:array<struct<`_VALUE`:string,{','.join(f'`_{k[1:]}`:string' for k in child)}>>")
            else:
                inner.append(f"`{name}`:array<{ddl(child)}>")
        return f"struct<{','.join(inner)}>"

    return ddl(tree), tree


def _getter(name: str):
    return lambda node: node.getField(name)


def _pick(root: Column, path: list[str], tree: dict) -> Column:
    """First node in document order along the path, as text."""
    if path[0].startswith("@"):
        return root.getField(f"_{path[0][1:]}")
    nodes, node = root.getField(path[0]), tree[path[0]]
    for step in path[1:]:
        if step.startswith("@"):
            return F.get(F.array_compact(F.transform(nodes, _getter(f"_{step[1:]}"))), F.lit(0))
        nodes = F.flatten(F.array_compact(F.transform(nodes, _getter(step))))
        node = node[step]
    if node and all(k.startswith("@") for k in node):
        nodes = F.transform(nodes, _getter("_VALUE"))
    return F.get(nodes, F.lit(0))


def xml_values(fields: list[tuple[FieldSpec, str | None]], body: Column, parsed: Column, tag: str):
    """(schema of one parse, value per field); odd XPaths fall back to ``xpath_string``."""
    plain = []
    for f, path in fields:
        if f.xml_attribute is not None:
            plain.append([f"@{f.xml_attribute}"])
        else:
            plain.append(_plain(path))
    usable = [p for p in plain if p is not None]
    ddl, tree = _schema(usable) if usable else ("struct<_none:string>", {})
    values = []
    for (f, path), p in zip(fields, plain):
        if p is not None:
            values.append(_pick(parsed, p, tree))
        else:
            # a function call has no place for the record as context, so it names the record itself
            whole = path if _CALL.match(path) else f"/{tag}/{path}"
            values.append(F.xpath_string(body, F.lit(whole)))
    return ddl, values


def _options(tag: str) -> dict[str, str]:
    """Text keeps its own spaces."""
    return {"rowTag": tag, "ignoreSurroundingSpaces": "false"}


def _head_values(spec: FileSpec, heads: list[str]) -> tuple[list[Column], dict[str, Column]]:
    """(parses of the ``_head_<tag>`` columns, value per field that stands in one)."""
    parsed, found = [], {}
    for head in heads:
        fields = [(f, relative_path(spec, f)) for f in spec.fields if header_tag(spec, f) == head and not f.xml_attribute]
        # an empty path names the header element itself
        own_text = [f for f, path in fields if not path]
        found.update({f.name: F.xpath_string(quoted(f"_head_{head}"), F.lit(f"/{head}")) for f in own_text})
        fields = [(f, path) for f, path in fields if path]
        if not fields:
            continue
        ddl, values = xml_values(fields, quoted(f"_head_{head}"), quoted(f"_parsed_{head}"), head)
        parsed.append(F.from_xml(quoted(f"_head_{head}"), ddl, _options(head)).alias(f"_parsed_{head}"))
        found.update({f.name: v for (f, _), v in zip(fields, values)})
    return parsed, found


def parse_xml_text(records: DataFrame, spec: FileSpec) -> DataFrame:
    """``records`` has _file, _seq and _xml, one record element per row, plus ``_head_<tag>`` columns.

    In place of a header's text it may have the values of the header's fields, as ``_of_<field>``.
    """
    require_valid(spec)
    tag = record_tag(spec)
    own = [(f, relative_path(spec, f)) for f in spec.fields if header_tag(spec, f) is None or f.xml_attribute]
    heads = sorted({header_tag(spec, f) for f in spec.fields if not f.xml_attribute} - {None})
    parsed_columns, values_by_field = [], {}
    ddl, values = xml_values(own, F.col("_xml"), F.col("_parsed"), tag)
    schema_file = spec.metadata.get("xsdLocation")
    options = _options(tag)
    if schema_file:
        # a record that breaks the schema comes back whole in the corrupt-record column
        ddl = f"{ddl[:-1]},`_bad`:string>"
        options.update({"rowValidationXSDPath": schema_file, "columnNameOfCorruptRecord": "_bad"})
    parsed_columns.append(F.from_xml("_xml", ddl, options).alias("_parsed"))
    values_by_field.update({f.name: v for (f, _), v in zip(own, values)})
    parsed_heads, head_values = _head_values(spec, [h for h in heads if f"_head_{h}" in records.columns])
    parsed_columns += parsed_heads
    values_by_field.update(head_values)
    values_by_field.update({f.name: quoted(f"_of_{f.name}") for f in spec.fields if f"_of_{f.name}" in records.columns})
    parsed = records.select("*", *parsed_columns)
    cells = parsed.select(
        "_file",
        "_seq",
        F.lit(None).cast("string").alias("_raw"),
        (F.col("_parsed._bad").isNotNull() if schema_file else F.lit(False)).alias("_broken"),
        *[values_by_field[f.name].alias(f"_r{k}") for k, f in enumerate(spec.fields)],
    )
    made = [coerce_xml(f, f"_r{k}") for k, f in enumerate(spec.fields)]
    broken = (Extra(F.col("_broken"), issue(tag, literal("Record does not match the schema"), "ERROR")),) if schema_file else ()
    return finish(cells, spec, made, more=broken)


# The rest of a tag behind its first character or behind an attribute; a quoted value may hold '>'.
_INSIDE = r"""[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+"""
OPEN, EMPTY = rf"<[A-Za-z_]{_INSIDE}>", rf"<[A-Za-z_]{_INSIDE}(?<=/)>"
# What holds no elements of the document, by its beginning and its end.
COMMENT, DATA, INSTRUCTION = r"<!--.*?-->", r"<!\[CDATA\[.*?\]\]>", r"<\?.*?\?>"
DOCTYPE = r"<!DOCTYPE[^\[>]*+(?:\[.*?\]\s*)?>"
#: states of a document's text: between tags, in a comment, character data, an instruction, a document type, a quoted value
TEXT, IN_COMMENT, IN_DATA, IN_INSTRUCTION, IN_DOCTYPE, IN_DOUBLE, IN_SINGLE = range(7)
STATES = IN_SINGLE + 1
#: stands for '<' in character data; XML does not allow it in a document
MASK = "\u0001"


# How the markup that a text may begin amid ends.
CLOSING = {IN_COMMENT: "-->", IN_DATA: "]]>", IN_INSTRUCTION: "?>"}
DOCTYPE_END = r"(?s)^.*?\]\s*>(.*)$"


def _ends(text: Column, state: int) -> Column:
    """Whether the markup that the text begins amid ends in it."""
    return text.rlike(DOCTYPE_END) if state == IN_DOCTYPE else F.contains(text, F.lit(CLOSING[state]))


def _rest(text: Column, state: int) -> Column:
    """What follows it, as a text that begins between tags."""
    if state == IN_DOCTYPE:
        return F.regexp_extract(text, DOCTYPE_END, 1)
    return F.substr(text, F.instr(text, CLOSING[state]) + len(CLOSING[state]))


def _ends_in(text: Column) -> Column:
    """State after a text that begins between tags: that of the markup which is left open."""
    # possessive, so the engine neither goes back nor goes deeper
    left = F.regexp_replace(text, rf"(?s)^(?:[^<]++|{COMMENT}|{DATA}|{INSTRUCTION}|{DOCTYPE}|</?[A-Za-z_:]{_INSIDE}>)*+", "")
    value = rf"""^</?[A-Za-z_:]{_INSIDE}"""
    return (
        F.when(F.startswith(left, F.lit("<!--")), IN_COMMENT).when(F.startswith(left, F.lit("<![CDATA[")), IN_DATA)
        .when(F.startswith(left, F.lit("<?")), IN_INSTRUCTION).when(F.startswith(left, F.lit("<!DOCTYPE")), IN_DOCTYPE)
        .when(left.rlike(value + '"'), IN_DOUBLE).when(left.rlike(value + "'"), IN_SINGLE).otherwise(TEXT)
    ).cast("tinyint")


def transitions(text: Column) -> Column:
    """For each state before a text the state after it."""
    amid = [
        F.when(_ends(text, s), _ends_in(_rest(text, s))).otherwise(F.lit(s).cast("tinyint"))
        for s in (IN_COMMENT, IN_DATA, IN_INSTRUCTION, IN_DOCTYPE)
    ]
    quoted_value = [_ends_in(F.concat(F.lit(opening), text)) for opening in ('<a b="', "<a b='")]
    return F.array(_ends_in(text), *amid, *quoted_value)


def opens_at(tag: str) -> str:
    return rf"^<{re.escape(tag)}[\s/>]"


def _empty(tag: str) -> str:
    return rf"<{re.escape(tag)}(?:\s{_INSIDE}|/)(?<=/)>"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _change(text: Column, tag: str | None = None) -> Column:
    """How many elements (of one tag) a piece of text opens more than it closes."""
    none = F.lit(0).cast("bigint")
    if tag is None:
        return _count(text, OPEN) - F.when(F.contains(text, F.lit("/>")), _count(text, EMPTY)).otherwise(none) - _count(text, "</")
    name = re.escape(tag)
    counted = _count(text, rf"<{name}(?:\s{_INSIDE})?>") - _count(text, rf"<{name}(?:\s{_INSIDE})?(?<=/)>") - _count(text, rf"</{name}\s*>")
    # most pieces do not name the tag
    return F.when(F.contains(text, F.lit(f"<{tag}")) | F.contains(text, F.lit(f"</{tag}")), counted).otherwise(none)


def _masked(text: Column) -> Column:
    """Without comments and the like, and with no '<' in character data."""
    kept = F.regexp_replace(text, rf"(?s)({DATA})|{COMMENT}|{INSTRUCTION}|{DOCTYPE}", "$1")
    parts = F.split(kept, r"(?=<!\[CDATA\[)|(?<=\]\]>)", -1)
    hidden = F.transform(parts, lambda p: F.when(
        F.startswith(p, F.lit("<![CDATA[")), F.replace(p, F.lit("<"), F.lit(MASK))).otherwise(p))
    return F.when(F.contains(text, F.lit("<!")) | F.contains(text, F.lit("<?")), F.array_join(hidden, "")).otherwise(text)


def _unmasked(text: Column) -> Column:
    return F.replace(text, F.lit(MASK), F.lit("<"))


def chunks_of(spark: SparkSession, paths: str | list[str], spec: FileSpec, glob: str | None) -> DataFrame:
    """_file, _nth and _text: documents cut behind closing tags of records, and nowhere amid other markup."""
    close = "/>" if spec.metadata.get("emptyRecords") == "true" else f"</{record_tag(spec)}>"
    lines = read_lines(spark, paths, spec.encoding, line_sep=close, glob=glob)
    # every chunk lost the separator at its end; a file's tail gets one too many, which closes nothing
    lines = lines.withColumn("_raw", F.concat("_raw", F.lit(close)))
    facts = split_table(lines, more={"_amid": F.max(_ends_in(F.col("_raw")) != TEXT)})
    chunks = attach(lines, facts, "_first", "_lines", "_offset")
    chunks = chunks.select("_file", place("_offset", "_id", "_first", "_lines").alias("_nth"), F.col("_raw").alias("_text"))
    if facts.filter("_amid").isEmpty():
        return chunks
    tables = stored(chunks.select("_file", "_nth", transitions(F.col("_text")).alias("_table")), "xml-tables")
    begins = carried_states(tables, ("_file",), "_nth", "_table", STATES, "_state")
    whole = running_sum(begins, ("_file",), ("_nth",), (F.col("_state") == TEXT).cast("bigint"), "_whole")
    whole = stored(whole.select("_file", "_nth", "_state", "_whole"), "xml-whole")
    sizes = whole.groupBy("_file", "_whole").agg((F.count(F.lit(1)) > 1).alias("_glued"))
    whole = stored(whole.join(sizes.hint("merge"), ["_file", "_whole"]), "xml-glued")
    # the texts are shuffled by their number, whose key is one chunk
    told = stored(chunks.join(whole.hint("merge"), ["_file", "_nth"]), "xml-told")
    single = told.filter(~F.col("_glued")).select("_file", F.col("_whole").alias("_nth"), "_text")
    parts = told.filter("_glued")
    # what a comment or the like holds between its ends need not be carried along
    for state in (IN_COMMENT, IN_INSTRUCTION, IN_DOCTYPE):
        parts = parts.filter((F.col("_state") != state) | _ends(F.col("_text"), state))
    parts = parts.select("_file", "_whole", F.struct("_nth", "_text").alias("_part"))
    joined = parts.groupBy("_file", "_whole").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["_text"]), "")
    return single.unionByName(stored(joined.select("_file", F.col("_whole").alias("_nth"), text.alias("_text")), "xml-joined"))


def pieces_of(spark: SparkSession, paths: str | list[str], spec: FileSpec, blocks: list[str], glob: str | None) -> DataFrame:
    """_file, _nth (rising per file) and _text: the document cut where a record or a block opens.

    A piece that starts with a record holds it to its end; only an empty record is followed by other text.
    '<' in character data is masked.
    """
    names = "|".join(re.escape(t) for t in dict.fromkeys([record_tag(spec), *blocks]))
    cut = F.split(_masked(F.col("_text")), rf"(?=<(?:{names})[\s/>])", -1)
    pieces = chunks_of(spark, paths, spec, glob).select("_file", "_nth", F.posexplode(cut).alias("_at", "_text"))
    return pieces.select("_file", (F.shiftleft("_nth", 32) + F.col("_at")).alias("_nth"), "_text")


def read_xml(spark: SparkSession, paths: str | list[str], spec: FileSpec, glob: str | None = None) -> DataFrame:
    """Records that stand on the spec's path, numbered per file in document order.

    Fields outside the records' branch come from the block around the record: the first such
    element of the block, wherever the block names it.
    """
    require_valid(spec)
    *above, tag = record_path(spec)
    outer = [f for f in spec.fields if header_tag(spec, f) is not None and not f.xml_attribute]
    heads = {header_tag(spec, f): block_tag(spec, f) for f in outer}
    blocks = sorted(set(heads.values()))
    pieces = pieces_of(spark, paths, spec, blocks, glob)
    bare = F.col("_text")
    starts = F.col("_text").rlike(opens_at(tag))
    alone = _empty(tag)
    empty = F.col("_text").rlike(f"^{alone}")
    changes = {"_depth": _change(bare), **{f"_in_{a}": _change(bare, a) for a in sorted(set(above))}}
    opened = {f"_no_{b}": F.col("_text").rlike(opens_at(b)).cast("bigint") for b in blocks}
    outside = F.when(~starts, F.col("_text")).when(empty, F.regexp_replace("_text", f"^{alone}", ""))
    found = {h: F.when(F.contains(outside, F.lit(f"<{h}")), F.nullif(_unmasked(
        F.regexp_extract(outside, rf"(?s)({_empty(h)}|<{re.escape(h)}[\s>].*?</{re.escape(h)}\s*>)", 1)), F.lit(""))) for h in heads}
    # narrow rows go through the running sums; texts are joined back by their number, headers by their block
    marks = stored(pieces.select(
        "_file", "_nth", starts.alias("_starts"), *[c.alias(f"d{n}") for n, c in changes.items()], *[c.alias(f"d{n}") for n, c in opened.items()],
        *[c.alias(f"_head_{h}") for h, c in found.items()],
    ), "xml-marks")
    names = [*changes, *opened]
    sums = running_sums(marks.select("_file", "_nth", "_starts", *[f"d{n}" for n in names]), ("_file",), ("_nth",), {n: F.col(f"d{n}") for n in names})
    # the state before a piece, for what it stands in; blocks count the one that it opens itself
    before = {n: F.col(n) - F.col(f"d{n}") for n in changes}
    on_path = before["_depth"] == len(above)
    for a in set(above):
        on_path = on_path & (before[f"_in_{a}"] >= above.count(a))
    state = stored(sums.select("_file", "_nth", (F.col("_starts") & on_path).alias("_record"), *opened), "xml")
    records = row_numbers(state.filter("_record"), ("_file",), ("_nth",), "_rn")
    records = records.select("_file", "_nth", (F.col("_rn") - 1).alias("_seq"), *opened)
    element = F.when(empty, F.regexp_extract("_text", f"^({alone})", 1)).otherwise(F.col("_text"))
    for block in blocks:
        own = [h for h, b in heads.items() if b == block]
        holding = marks.select("_file", "_nth", *[f"_head_{h}" for h in own]).filter(" or ".join(f"`_head_{h}` is not null" for h in own))
        of_block = holding.hint("merge").join(state.select("_file", "_nth", f"_no_{block}"), ["_file", "_nth"]).groupBy("_file", f"_no_{block}")
        firsts = of_block.agg(*[
            F.min_by(quoted(f"_head_{h}"), F.when(quoted(f"_head_{h}").isNotNull(), F.col("_nth"))).alias(f"_head_{h}") for h in own
        ])
        # a header is parsed once for all records of its block
        parsed, values = _head_values(spec, own)
        firsts = stored(firsts.select("*", *parsed).select("_file", f"_no_{block}", *[v.alias(f"_of_{n}") for n, v in values.items()]), "xml-heads")
        records = records.join(joinable(firsts), ["_file", f"_no_{block}"], "left")
    numbered = records.hint("merge").join(pieces.select("_file", "_nth", _unmasked(element).alias("_xml")), ["_file", "_nth"])
    return parse_xml_text(numbered.drop("_nth", *opened), spec)
