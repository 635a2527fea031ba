"""Source divergence audit: how far the word counts of a language's sources lie apart.

Terms are runs of letters (every code point from U+0080 up counts as one), A-Z lower-cased. A
language keeps the terms that ``least`` of its documents hold. Each source, and the language as a
whole, gives a kept term the share ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``; two shares lie
``floor((p - q)^2 / (p + q))`` apart. All of it is whole numbers, so results are exact.

Pairs of sources are compared by count-level bitmaps. Kept terms get ids: a block of about
``SPAN`` terms by hash, and a place in it by falling count, so that the ids of a 64-bit word have
few different counts. For every source and count there is a bitset of the terms that have this
count there, stored as its words that are not empty. Within a word, AND and popcount of two
sources' bitsets give the number of terms of each pair of counts; the terms that a source lacks
are the complement of its bitsets. Only cells that hold a term are multiplied by their distance.
Blocks are dealt to tasks together with ``GROUPS`` times ``GROUPS`` sources at most, so neither
a large vocabulary nor many sources meet in one task.

Defined cases: null text, language and source count as empty ones; every row is a document, also
if it is repeated; a text is taken whole, however long (a term, too); equal distances rank by
item; a language without kept terms has distances of 0 and no terms; a lone source has no pairs.
An empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.llm.common import bounded_batches, frozen, slices, word_lists

#: lower-cases A-Z and turns every ASCII byte that is no letter into a blank
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: terms that a task counts before it hands the counts on
HELD = 500_000
#: term ids of a block
SPAN = 1_024
#: sources on each side of a task's comparison
GROUPS = 16
WORD = 64


def term_counts(df: DataFrame) -> DataFrame:
    """Occurrences and documents of every term of every (lang, source), added up per task first."""

    def rows(counts: dict, docs: dict) -> pa.RecordBatch:
        keys = [key for key, c in counts.items() for _ in range(len(c))]
        terms = [t for c in counts.values() for t in c]
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
            pa.array(terms, pa.binary()).cast(pa.string()),
            pa.array([n for c in counts.values() for n in c.values()], pa.int64()),
            pa.array([docs[key][t] for key, c in counts.items() for t in c], pa.int64()),
        ], ["lang", "source", "term", "n", "docs"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        for part, texts in slices(batches, "text"):
            groups = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
            for key, text in zip(groups, texts):
                count, seen = counts.setdefault(key, Counter()), set()
                for words in word_lists(text.translate(LETTERS)):
                    count.update(words)
                    seen.update(words)
                docs.setdefault(key, Counter()).update(seen)
            if sum(map(len, counts.values())) > HELD:
                yield rows(counts, docs)
                counts, docs = {}, {}
        if counts:
            yield rows(counts, docs)

    schema = "lang string, source string, term string, n bigint, docs bigint"
    partial = bounded_batches(df).mapInArrow(each, schema)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), in 38 digits."""
    above = (n + 2).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_cells(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over a block's terms of the distance between each source of one chunk and each of another.

    Rows of word -1 name the sources: their place, their share of a term that they lack, and in
    ``bits`` the number of the block's terms. The others are words of bitsets.
    """
    lang, _, left, right = (k.as_py() for k in key)
    at, word, p, bits, chunk = (table.column(c).to_numpy() for c in ("at", "word", "p", "bits", "chunk"))
    bits = bits.astype(np.int64).view(np.uint64)
    head = word < 0
    size = int(bits[head][0])

    def side(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = head & (chunk == number)
        order = np.argsort(at[mine])
        return at[mine][order], p[mine][order], ~head & (chunk == number)

    def levels(names: np.ndarray, lacking: np.ndarray, here: np.ndarray, valid: np.uint64) -> tuple[np.ndarray, ...]:
        """Source, share and bitset of each count that occurs in a word, the count 0 included."""
        group, used = np.searchsorted(names, at[here]), np.zeros(len(names), np.uint64)
        np.bitwise_or.at(used, group, bits[here])
        return (
            np.concatenate([group, np.arange(len(names))]),
            np.concatenate([p[here], lacking]),
            np.concatenate([bits[here], valid & ~used]),
        )

    one, other = side(left), side(right)
    sums = np.zeros(len(one[0]) * len(other[0]), np.int64)
    for w in range(-(-size // WORD)):
        here = word == w
        valid = np.uint64((1 << min(WORD, size - w * WORD)) - 1)
        ga, pa_, ba = levels(*one[:2], one[2] & here, valid)
        gb, pb, bb = levels(*other[:2], other[2] & here, valid)
        joint = np.bitwise_count(ba[:, None] & bb[None, :])
        i, j = np.nonzero(joint)
        apart = (pa_[i] - pb[j]) ** 2 // (pa_[i] + pb[j])
        # a word's sum is below 64 * 10^9, which a double holds exactly
        sums += np.bincount(ga[i] * len(other[0]) + gb[j], apart * joint[i, j], len(sums)).astype(np.int64)
    a, b = np.repeat(one[0], len(other[0])), np.tile(other[0], len(one[0]))
    if left != right:
        a, b, sums = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sums, sums])
    differ = a != b
    return pa.table({
        "lang": pa.array([lang] * int(differ.sum()), pa.string()),
        "a": pa.array(a[differ], pa.int32()), "b": pa.array(b[differ], pa.int32()), "value": pa.array(sums[differ], pa.int64()),
    })


def audit(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10,
) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources (``pair``) and the
    ``top`` terms that a source holds more of than its language (``term``)."""
    documents = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = frozen(term_counts(documents), "terms")
    totals = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = frozen(totals.filter(F.col("docs") >= least).select("lang", "term", "total"), "kept")
    langs = frozen(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n")), "langs")

    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / SPAN))
    place = F.row_number().over(W.partitionBy("lang", "block").orderBy(F.desc("total"), "term")) - 1
    ids = kept.join(langs, "lang").withColumn("block", block).withColumn("place", place)
    held = frozen(counts.drop("docs").join(ids, ["lang", "term"]), "held")

    order = W.partitionBy("lang").orderBy("source")
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = documents.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = frozen(groups.select(
        "lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("v", F.lit(0)).alias("v"),
        (F.row_number().over(order) - 1).alias("at"),
    ).withColumn("chunk", F.floor(F.col("at") / GROUPS).cast("int")), "groups")

    shares = held.join(groups.drop("v"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    return pairs(shares, groups, ids).unionByName(terms(shares, top))


def pairs(shares: DataFrame, groups: DataFrame, ids: DataFrame) -> DataFrame:
    """Distance of each source to every other of its language, summed over all kept terms."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % WORD).cast("int"))
    words = shares.withColumn("word", F.floor(F.col("place") / WORD).cast("int"))
    words = words.groupBy("lang", "block", "chunk", "at", "word", "n", "p").agg(F.bit_or(bit).alias("bits")).drop("n")
    blocks = ids.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("bits"))
    lacking = share(F.lit(0).cast("bigint"), F.col("group_n"), F.col("v"))
    heads = blocks.join(groups, "lang").select("lang", "block", "chunk", "at", F.lit(-1).alias("word"), lacking.alias("p"), "bits")

    # each chunk of sources meets each other one once
    chunks = groups.groupBy("lang").agg(F.max("chunk").alias("last"))
    against = F.explode(F.sequence(F.lit(0), F.col("last")))
    dealt = words.unionByName(heads).join(chunks, "lang").withColumn("against", against)
    dealt = dealt.withColumns({"left": F.least("chunk", "against"), "right": F.greatest("chunk", "against")})
    cells = dealt.select("lang", "block", "left", "right", "chunk", "at", "word", "p", "bits")
    parts = cells.groupBy("lang", "block", "left", "right").applyInArrow(joint_cells, "lang string, a int, b int, value bigint")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    one = groups.select("lang", "source", F.col("at").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    every = one.join(other, "lang").filter(F.col("a") != F.col("b")).join(summed, ["lang", "a", "b"], "left")
    every = every.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return every.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def terms(shares: DataFrame, top: int) -> DataFrame:
    """The terms that stand out most in each source; tasks cut to ``top`` before the rows meet."""
    p, q = F.col("p"), F.col("q")
    more = shares.withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v"))).filter(p > q)
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(p, q).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return more.withColumn("rank", rank).filter(F.col("rank") <= top)
