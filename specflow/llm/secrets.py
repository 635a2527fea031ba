"""Secret scans: fixed patterns, and strings near sensitive words that zstandard cannot foretell.

Patterns find assignments, access keys and long hex runs. Beyond those, every token within
``REACH`` code points before or after a sensitive word is a candidate, and with one every token
that follows it across a line end, as in the body of a key. zstandard is primed with a
dictionary of identifiers and the code around the candidate; the candidate's novelty is the
number of bytes that it adds to the compressed surroundings, per byte of its own. Names and
repeated strings add next to nothing, random strings nearly their entropy.

Defined cases: a null or empty text has no spans; copies are scanned alike; very long texts
are scanned whole, each candidate with a bounded stretch around it. Spans count code points; those
that start together are ordered by kind. An empty table gives an empty result; the added column
changes its name where the table has it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specflow.llm.common import bounded_batches, fresh, slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = re.compile(
    r"passphrase|password|passwd|pwd|secret|token|credential|bearer|(api|private|access)[_\x20-]?key|auth", re.ASCII | re.IGNORECASE
)
SENSITIVE_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
CANDIDATE_LETTER = re.compile(r"[A-Za-z0-9+/_=-]")
#: candidates of fewer code points must hold a digit, which capitalised words do not
SHORT = 16
NEXT_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*(?=[A-Za-z0-9+/_=-]{8})")
#: code points around a sensitive word in which candidates start or end, and around a candidate that prime the compressor
REACH, AROUND = 80, 400
#: least compressed bytes per byte, and least kinds of letters (lower, upper, digit), of a reported string
NOVELTY, MIXED = 0.5, 2
IDENTIFIERS = (
    "access_token refresh_token id_token client_secret client_id api_key apiKey secret_key secretKey private_key "
    "public_key password passwd passphrase username user_name credentials credential authorization Authorization "
    "Bearer Basic authenticate authentication auth_token session_token csrf_token token_type expires_in grant_type "
    "certificate signature fingerprint encryption decrypt encrypt connection_string database hostname localhost "
    "environment variable configuration settings default example placeholder changeme your_api_key_here required "
    "function return import export class public static private protected void string integer boolean true false null "
    "None self request response header headers content application json xml http https www com org net config get set"
).encode()


def patterns(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns; matches of a kind do not overlap."""
    spans = []
    folded = text.lower()
    if any(name in folded for name in ASSIGN_NAMES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is what the open-ended pattern would match there
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda span: span[1]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def novelty(text: str, start: int, end: int, known: zstandard.ZstdCompressionDict) -> float:
    """Compressed bytes that the candidate adds to its surroundings, per byte of its own."""
    around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).encode("utf-8", "replace")
    own = text[start:end].encode("utf-8", "replace")
    press = zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_dict_id=False)
    return (len(press.compress(around + own)) - len(press.compress(around))) / len(own)


def mixed(candidate: str) -> int:
    return sum(any(test(c) for c in candidate) for test in (str.islower, str.isupper, str.isdigit))


def scan(text: str, known: zstandard.ZstdCompressionDict) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    spans = patterns(text)
    folded = text.lower()
    if any(stem in folded for stem in SENSITIVE_STEMS):
        starts, ends = covered(spans)
        reached = 0
        for word in SENSITIVE.finditer(text):
            at, last = max(reached, word.start() - REACH), word.end() + REACH
            # a candidate that is cut by the reach counts whole
            while at > reached and CANDIDATE_LETTER.match(text, at - 1):
                at -= 1
            while found := CANDIDATE.search(text, at, last + 8):
                start, end = CANDIDATE.match(text, found.start()).span()
                at = reached = end
                if line := NEXT_LINE.match(text, end):
                    last = max(last, line.end())  # the next line is of the same block
                before = bisect_left(starts, end) - 1
                if before >= 0 and ends[before] > start:
                    continue
                kinds = mixed(text[start:end])
                telling = kinds >= MIXED and (end - start >= SHORT or any(c.isdigit() for c in text[start:end]))
                if telling and novelty(text, start, end, known) >= NOVELTY:
                    spans.append(("novel", start, end))
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def find_secrets(df: DataFrame, text: str = "text", out: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``out``, an array of (kind, start, end), end exclusive."""
    keep = df.columns if keep is None else keep
    (out,) = fresh(df.select(keep), out)
    passed = [f for f in df.schema.fields if f.name in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        for part, rows in slices(batches, text):
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in scan(row.decode("utf-8", "replace"), known)] for row in rows
            ]
            columns = [part.column(f.name) for f in passed] + [pa.array(found, span_type)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([*passed, T.StructField(out, T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])))])
    needed = [f.name for f in df.schema.fields if f.name in keep or f.name == text]
    return bounded_batches(df.select(*needed)).mapInArrow(each, schema)
