"""Chat formatting: records of any known layout become turns, turns become marked text.

A record is a JSON object. The set of its nested field paths (``messages[].role``) is hashed;
this fingerprint selects a declarative layout, which says where roles and texts stand. The
fingerprints of a layout's own paths, with and without its optional ones, are known beforehand. Any
other is resolved once per worker: the layout whose required paths it has all of, and most of, so
that fields beside the known ones do no harm.

Every turn is written by itself, so a conversation may have any number of rows, and formatting
moves none: ``<|turn|>role<|text|>text<|end|>``, a conversation being its pieces in order. Within
roles and texts, control strings (those of the template and of other common ones) are broken by a
backslash behind their first character; one that has backslashes there already gets one more, so
``unescaped`` gives back every text. The loss mask covers the escaped texts of assistants.

Defined cases: null record, JSON that cannot be read, records that are no object or fit no layout:
no turns, layout null (``unfit`` lists their paths, nothing is dropped); null, missing optional and
empty texts are empty turns, but an optional part that is missing altogether gives none; numbers
and other values of a text are written as JSON; a null role is an empty one. Rows that tie in their
order keep the order of role, then text; repeated rows are repeated turns. Texts are taken whole. Added
columns change their names where the table has them already. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from specflow.llm.common import bounded_batches, fresh, slices

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: strings that must not stand in a text; none holds the first character of another further on
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


@dataclass(frozen=True)
class Part:
    """A turn: the texts at some paths, blank lines between, by a fixed role or the one at ``role_at``."""

    texts: tuple[str, ...]
    role: str | None = None
    role_at: str | None = None
    optional: bool = False


@dataclass(frozen=True)
class Layout:
    """Parts of the record itself before and after those of each element of the array ``each``."""

    name: str
    before: tuple[Part, ...] = ()
    each: str | None = None
    parts: tuple[Part, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    #: paths that may be missing although a part names them
    optional: tuple[str, ...] = ()

    def paths(self) -> tuple[frozenset[str], frozenset[str]]:
        """Required and optional paths."""
        named: dict[str, bool] = {}
        for prefix, parts in (("", self.before), (f"{self.each}[].", self.parts)):
            for part in parts:
                for path in (*part.texts, *([part.role_at] if part.role_at else ())):
                    full = (prefix + path).removesuffix(".")
                    named[full] = named.get(full, True) and (part.optional or full in self.optional)
        return frozenset(p for p, o in named.items() if not o), frozenset(p for p, o in named.items() if o)


SHARED_ROLES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant", "model": "assistant", "instruction": "system"}
SYSTEM = Part(("system",), "system", optional=True)
LAYOUTS = (
    Layout("turn", before=(Part(("text",), role_at="role"),)),
    Layout("prompt_completion", before=(SYSTEM, Part(("prompt",), "user"), Part(("completion",), "assistant"))),
    Layout("prompt_response", before=(SYSTEM, Part(("prompt",), "user"), Part(("response",), "assistant"))),
    Layout("preference", before=(SYSTEM, Part(("prompt",), "user"), Part(("chosen",), "assistant"))),
    Layout("question_answer", before=(Part(("context", "question"), "user"), Part(("answer",), "assistant")), optional=("context",)),
    Layout("instruction", before=(SYSTEM, Part(("instruction", "input"), "user"), Part(("output",), "assistant")), optional=("input",)),
    Layout("messages", before=(SYSTEM,), each="messages", parts=(Part(("content",), role_at="role"),)),
    Layout("message_parts", before=(SYSTEM,), each="messages", parts=(Part(("content[].text",), role_at="role"),)),
    Layout("conversations", before=(SYSTEM,), each="conversations", parts=(Part(("value",), role_at="from"),), roles=SHARED_ROLES),
    Layout("pairs", before=(SYSTEM,), each="turns", parts=(Part(("user",), "user"), Part(("assistant",), "assistant"))),
)


def paths(value: object, at: str = "") -> Iterator[str]:
    """Paths of the leaves; an empty object or array is one."""
    if isinstance(value, dict) and value:
        for name, inner in value.items():
            yield from paths(inner, f"{at}.{name}" if at else name)
    elif isinstance(value, list) and value:
        for inner in value:
            yield from paths(inner, f"{at}[]")
    else:
        yield at


def fingerprint(found: Iterable[str]) -> int:
    """Signed 64-bit hash of a set of paths."""
    h = xxh3_64_intdigest("\n".join(sorted(set(found))).encode("utf-8", "surrogatepass"))
    return h - (1 << 64 if h >> 63 else 0)


def known(layouts: Iterable[Layout]) -> dict[int, Layout | None]:
    """Layouts by the fingerprints of their own paths; the earlier of two that look alike."""
    out: dict[int, Layout | None] = {}
    for layout in layouts:
        required, optional = layout.paths()
        for n in range(len(optional) + 1):
            for extra in combinations(sorted(optional), n):
                out.setdefault(fingerprint(required | set(extra)), layout)
    return out


def resolved(found: set[str], layouts: Iterable[Layout]) -> Layout | None:
    """The layout that needs the most of the paths, of those that miss none."""
    fit = [x for x in layouts if x.paths()[0] and x.paths()[0] <= found]
    return max(fit, key=lambda x: (len(x.paths()[0]), len(x.paths()[1] & found)), default=None)


def looked_up(value: object, path: str) -> list[object]:
    """Values at a path, in order; none if it is not there."""
    values = [value]
    for step in path.split(".") if path else ():
        name = step.removesuffix("[]")
        values = [v[name] for v in values if isinstance(v, dict) and name in v]
        if step.endswith("[]"):
            values = [x for v in values if isinstance(v, list) for x in v]
    return values


def as_text(value: object) -> str:
    text = value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()  # JSON can spell halves of code points


def turns_of(record: object, layout: Layout) -> Iterator[tuple[str, str]]:
    """Role and text of each turn."""
    whole = [(part, record) for part in layout.before]
    elements = looked_up(record, f"{layout.each}[]") if layout.each else []
    for part, at in whole + [(part, element) for element in elements for part in layout.parts]:
        values = [looked_up(at, path) for path in part.texts]
        if part.optional and not any(values):
            continue
        role = part.role if part.role_at is None else as_text(next(iter(looked_up(at, part.role_at)), None))
        text = "\n\n".join(t for t in ("".join(map(as_text, v)) for v in values) if t)
        yield layout.roles.get(role, role), text


def reader(layouts: tuple[Layout, ...]) -> Callable[[bytes], tuple[str | None, int | None, list[str], list[tuple[str, str]]]]:
    """A function from JSON to layout, fingerprint, paths (of records that fit none) and turns."""
    chosen = known(layouts)

    def read(body: bytes):
        try:
            record = json.loads(body)
            found = set(paths(record)) if isinstance(record, dict) else None
        except (ValueError, RecursionError):
            found = None
        if found is None:
            return None, None, [], []
        print_ = fingerprint(found)
        if print_ not in chosen:
            if len(chosen) > 100_000:
                chosen.clear()
                chosen.update(known(layouts))
            chosen[print_] = resolved(found, layouts)
        layout = chosen[print_]
        if layout is None:
            return None, print_, sorted(found), []
        return layout.name, print_, [], list(turns_of(record, layout))

    return read


def canonical(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The rows with ``layout``, ``fingerprint``, ``unfit`` and ``turns`` (array of role, text) of their records."""
    names, out = df.columns, fresh(df, "layout", "fingerprint", "unfit", "turns")
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(layouts)
        for part, bodies in slices(batches, record):
            layout, prints, unfit, turns = zip(*map(read, bodies))
            added = [
                pa.array(layout, pa.string()), pa.array(prints, pa.int64()), pa.array(unfit, pa.list_(pa.string())),
                pa.array([[{"role": r, "text": t} for r, t in row] for row in turns], pa.list_(turn)),
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *added], [*names, *out])

    kinds = ("string", "bigint", "array<string>", "array<struct<role:string,text:string>>")
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(out, kinds))])
    return bounded_batches(df).mapInArrow(each, schema)


def layouts_found(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Report: rows per fingerprint and layout, and the paths of those that fit none."""
    read = canonical(df.select(F.col(record).alias("record")), "record", layouts)
    return read.groupBy("fingerprint", "layout").agg(F.count(F.lit(1)).alias("rows"), F.first("unfit").alias("unfit"))


def _patterns(controls: tuple[str, ...]) -> list[tuple[str, str]]:
    """For each first character of control strings: it, and a pattern of what may follow it."""
    firsts = sorted({c[0] for c in controls})
    if any(f in c[1:] for f in firsts for c in controls) or any("\\" in c or len(c) < 2 for c in controls):
        raise ValueError("a control string holds the first character of another, or a backslash, or is too short")
    return [(re.escape(f), "|".join(re.escape(c[1:]) for c in controls if c[0] == f)) for f in firsts]


def escaped(c: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The text without control strings: each gets a backslash behind its first character."""
    c = F.coalesce(c, F.lit(""))
    for first, rest in _patterns(controls):
        c = F.regexp_replace(c, rf"({first})(\\*)({rest})", r"$1$2\\$3")
    return c


def unescaped(c: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The text that was escaped: each control string that is broken loses a backslash."""
    for first, rest in _patterns(controls):
        c = F.regexp_replace(c, rf"({first})(\\*)\\({rest})", "$1$2$3")
    return c


def formatted(df: DataFrame, role: str = "role", text: str = "text", learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The rows, a turn each, with ``piece`` and its loss mask, code points ``loss_from`` to before ``loss_to``.

    The mask is null for roles that are not ``learnt``. No row moves.
    """
    piece, start, end, head, body = fresh(df, "piece", "loss_from", "loss_to", "_head", "_body")
    heads = F.concat(F.lit(TURN), escaped(F.col(role)), F.lit(TEXT))
    marked = df.withColumns({head: heads, body: escaped(F.col(text))})
    masked = F.col(role).isin(*learnt)
    return marked.withColumns({
        piece: F.concat(head, body, F.lit(END)),
        start: F.when(masked, F.length(head)), end: F.when(masked, F.length(head) + F.length(body)),
    }).drop(head, body)


def read_back(c: Column) -> Column:
    """Array of role and text of formatted turns, one or many in a row."""
    def turn(marked: Column) -> Column:
        at = F.instr(marked, TEXT)
        return F.struct(
            unescaped(F.substr(marked, F.lit(len(TURN) + 1), at - 1 - len(TURN))).alias("role"),
            unescaped(F.substr(marked, at + len(TEXT))).alias("text"),
        )

    pieces = F.split(c, re.escape(END))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def conversations(df: DataFrame, id: str, order: list[str], piece: str = "piece", mask: tuple[str, str] = ("loss_from", "loss_to")) -> DataFrame:
    """One row per conversation: ``id``, ``formatted``, ``loss`` (array of from, to); a task holds one of them at a time."""
    start, end = mask
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def row(key: object, pieces: list[str], spans: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([key], kind), pa.array(["".join(pieces)], pa.string()), pa.array([spans], pa.list_(span)),
        ], [id, "formatted", "loss"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, spans, size = None, [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if pieces and r["key"] != now:
                    yield row(now, pieces, spans)
                    pieces, spans, size = [], [], 0
                now = r["key"]
                pieces.append(r["piece"])
                if r["start"] is not None:
                    spans.append({"from": size + r["start"], "to": size + r["end"]})
                size += len(r["piece"])
        if pieces:
            yield row(now, pieces, spans)

    kind = pa.string() if df.schema[id].dataType == T.StringType() else pa.int64()
    read = in_order(df, id, order).select(F.col(id).alias("key"), F.col(piece).alias("piece"), F.col(start).alias("start"), F.col(end).alias("end"))
    return bounded_batches(read).mapInArrow(each, T.StructType([
        df.schema[id], T.StructField("formatted", T.StringType()),
        T.StructField("loss", T._parse_datatype_string("array<struct<from:bigint,to:bigint>>")),
    ]))


def in_order(df: DataFrame, id: str, order: list[str]) -> DataFrame:
    """Rows of an id one behind the other in one partition."""
    return df.repartition(id).sortWithinPartitions(id, *order)


def digests(df: DataFrame, id: str, order: list[str], piece: str = "piece", mask: tuple[str, str] = ("loss_from", "loss_to")) -> DataFrame:
    """Per conversation, from the formatted turns alone: ``n_turns``, ``turns_sha256`` over role, line break,
    text, line break of each turn, ``loss_chars`` and ``loss_sha256`` of the unescaped text under the
    mask, ``formatted_chars``. Rows are streamed in order; texts do not add up in a task."""
    start, end = mask
    added = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [id, *added])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for key, turns, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("key", "turns", "loss", "chars"))):
                if state is None or state[0] != key:
                    if state is not None:
                        out.append(told(state))
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in turns:
                    state[1] += 1
                    state[2].update(f"{turn['role']}\n{turn['text']}\n".encode())
                state[3] += len(loss or "")
                state[4].update((loss or "").encode())
                state[5] += chars
            if out:
                yield rows(out)
        if state is not None:
            yield rows([told(state)])

    def told(state: list) -> tuple:
        key, n, turns, chars, loss, size = state
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

    kind = pa.string() if df.schema[id].dataType == T.StringType() else pa.int64()
    under = unescaped(F.substr(piece, F.col(start) + 1, F.col(end) - F.col(start)))
    read = in_order(df, id, order).select(
        F.col(id).alias("key"), read_back(F.col(piece)).alias("turns"), under.alias("loss"), F.length(piece).cast("bigint").alias("chars")
    )
    fields = [T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in added]
    return bounded_batches(read).mapInArrow(each, T.StructType([df.schema[id], *fields]))
