"""Benchmark decontamination: a Wu-Manber search for windows of benchmark words.

Patterns are the windows of ``width`` consecutive words of every item, an item with fewer
words being one window. For each pattern length m the shift table tells, for the block of
two words that ends at a place, how many places no pattern can end; where the shift is 0 the
block's bucket names the patterns that end so, and those are compared word by word, then as
bytes. Stretches of all documents of a batch advance together. Benchmarks of more than
``words_per_block`` words are searched in blocks, each broadcast by itself, in one pass
through all of them.

Defined cases: a null or empty text has no words and is clean; items without words have no
windows; items with the same id are one item, a null item id is written as an empty string.
Copies of a document are judged alike. Texts of any length are searched whole. An empty benchmark
leaves all documents clean, an empty table gives an empty result; added columns change their names where the
table has them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specflow.llm.common import LOWER, bounded_batches, fresh, slices

WIDTH = 13
WORDS_PER_BLOCK = 2_000_000
#: window ends that one stretch covers
STRETCH = 256
SHIFT_BITS = 20

_LOWER = np.frombuffer(LOWER, np.uint8)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = True
_IN_WORD[0x61:0x7B] = True
_IN_WORD[0x80:] = True
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            def grown(base: int) -> np.ndarray:
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                return np.cumprod(factors, dtype=np.uint64)

            self.up, self.down = grown(_BASE), grown(_UNBASE)
        return self.up[:size], self.down[:size]


_POWERS = Powers()


def words_of(rows: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined lower-case text, word starts, ends and 64-bit hashes, and each row's first word (one more at the end)."""
    joined = b"\n".join(rows).translate(LOWER) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    begins = np.cumsum([0, *[len(r) + 1 for r in rows]])
    return joined, starts, ends, hashes, np.searchsorted(starts, begins)


def blocks_of(hashes: np.ndarray) -> np.ndarray:
    """Hash of the two words that end at each place."""
    out = hashes.copy()
    out[1:] += hashes[:-1] * np.uint64(_BASE)
    return out * _MIX


class Length:
    """Shift table and buckets for the patterns of ``m`` words."""

    def __init__(self, m: int, patterns: dict[bytes, set[int]]):
        self.m = m
        self.texts = list(patterns)
        self.items = [patterns[t] for t in self.texts]
        joined, starts, ends, hashes, first = words_of(self.texts)
        self.words = hashes.reshape(len(self.texts), m)
        blocks = blocks_of(hashes).reshape(len(self.texts), m) if m > 1 else self.words * _MIX
        least = 1 if m > 1 else 0
        self.shift = np.full(1 << SHIFT_BITS, m - least, np.uint8 if m < 250 else np.int32)
        for place in range(least, m):
            at = blocks[:, place] >> np.uint64(64 - SHIFT_BITS)
            self.shift[at] = np.minimum(self.shift[at], m - 1 - place)
        last = blocks[:, -1]
        order = np.argsort(last, kind="stable")
        self.suffixes, self.begin, self.count = np.unique(last[order], return_index=True, return_counts=True)
        self.order = order

    def find(self, joined: bytes, starts, ends, hashes, blocks, first) -> Iterator[tuple[int, int]]:
        """(place of the last word, pattern) of every occurrence."""
        m = self.m
        slots = ((blocks if m > 1 else hashes * _MIX) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)
        here, stop = [], []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= m:
                cuts = np.arange(a + m - 1, b, STRETCH)
                here.append(cuts)
                stop.append(np.minimum(cuts + STRETCH, b))
        if not here:
            return
        at, stop = np.concatenate(here), np.concatenate(stop)
        ended = []
        while len(at):
            jump = self.shift[slots[at]].astype(np.int64)
            ended.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        at = np.concatenate(ended)
        suffix = (blocks if m > 1 else hashes * _MIX)[at]
        bucket = np.searchsorted(self.suffixes, suffix)
        bucket[bucket == len(self.suffixes)] = 0
        same = self.suffixes[bucket] == suffix
        at, bucket = at[same], bucket[same]
        for part in range(0, len(at), 100_000):
            counts = self.count[bucket[part : part + 100_000]]
            ends_at = np.repeat(at[part : part + 100_000], counts)
            nth = np.arange(len(ends_at)) - np.repeat(np.cumsum(counts) - counts, counts)
            pattern = self.order[np.repeat(self.begin[bucket[part : part + 100_000]], counts) + nth]
            for word in range(m):
                same = hashes[ends_at - (m - 1) + word] == self.words[pattern, word]
                ends_at, pattern = ends_at[same], pattern[same]
            for end, found in zip(ends_at.tolist(), pattern.tolist()):
                a = end - m + 1
                spelled = b" ".join([joined[s:e] for s, e in zip(starts[a : end + 1].tolist(), ends[a : end + 1].tolist())])
                if spelled == self.texts[found]:
                    yield end, found


class Patterns:
    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.ids = [i for i, _ in items]
        grouped: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        for place, (_, body) in enumerate(items):
            joined, starts, ends, _, _ = words_of([body])
            words = [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
            m = min(width, len(words))
            for i in range(len(words) - m + 1 if words else 0):
                grouped[m][b" ".join(words[i : i + m])].add(place)
        self.lengths = [Length(m, patterns) for m, patterns in grouped.items()]


_BUILT: dict[str, Patterns] = {}


def built(name: str, shared, width: int) -> Patterns:
    """Tables of a broadcast block of items, built once in each worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Patterns(shared.value, width)
    return _BUILT[name]


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint [start, end) spans that cover the same places."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.c_[spans[new, 0], np.r_[reach[np.flatnonzero(new)[1:] - 1], reach[-1]]]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, words_per_block: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about ``words_per_block`` words, one on the driver at a time."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # a word takes two bytes at least, with what parts it from the next
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // (2 * words_per_block) + 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for nth in range(blocks):
        yield [(r["item"], r["text"].encode()) for r in rows.filter(block == nth).toLocalIterator()]


def contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, words_per_block: int = WORDS_PER_BLOCK, keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all), ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans``.

    ``spans`` are the hit stretches as little-endian 32-bit pairs of word places, end exclusive.
    """
    spark = df.sparkSession
    keep = df.columns if keep is None else keep
    n_words, n_hit, items, spans = fresh(df.select(keep), "n_words", "n_hit", "items", "spans")
    new = [
        T.StructField(n_words, T.LongType()), T.StructField(n_hit, T.LongType()),
        T.StructField(items, T.ArrayType(T.StringType())), T.StructField(spans, T.BinaryType()),
    ]
    out = df.withColumns({n_words: F.lit(0).cast("bigint"), n_hit: F.lit(0).cast("bigint"),
                          items: F.array().cast("array<string>"), spans: F.lit(b"")})
    passed = [f for f in df.schema.fields if f.name in keep or f.name == text]
    out = out.select(*[f.name for f in passed], n_words, n_hit, items, spans)
    schema = T.StructType([*passed, *new])
    for block in benchmark_blocks(benchmark, item, item_text, words_per_block):
        shared, name = spark.sparkContext.broadcast(block), uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            patterns = built(name, shared, width)
            for part, rows in slices(batches, text, 2 << 20):
                joined, starts, ends, hashes, first = words_of(rows)
                blocks = blocks_of(hashes)
                found: dict[int, set[str]] = defaultdict(set)
                hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for length in patterns.lengths:
                    for end, pattern in length.find(joined, starts, ends, hashes, blocks, first):
                        row = int(np.searchsorted(first, end, "right")) - 1
                        hits[row].append((end - length.m + 1 - first[row], end + 1 - first[row]))
                        found[row].update(patterns.ids[i] for i in length.items[pattern])
                counts, ids, covers = [], [], []
                before = zip(part.column(items).to_pylist(), part.column(spans).to_pylist())
                for row, (had, covered) in enumerate(before):
                    known = np.frombuffer(covered, "<i4").reshape(-1, 2)
                    if row in hits:
                        known = merged(np.concatenate([known, np.array(hits[row], "<i4")]))
                    counts.append(int((known[:, 1] - known[:, 0]).sum()))
                    ids.append(sorted(found[row].union(had)) if row in found else had)
                    covers.append(known.astype("<i4").tobytes())
                columns = [part.column(f.name) for f in passed]
                columns += [pa.array(np.diff(first), pa.int64()), pa.array(counts, pa.int64())]
                columns += [pa.array(ids, pa.list_(pa.string())), pa.array(covers, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        out = bounded_batches(out).mapInArrow(search, schema)
    return out.select(*keep, n_words, n_hit, items, spans)


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit", share: int = 20):
    """Hit at all, and at least one word in ``share``."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words))
