"""Spelling variant grouping: words one edit apart, and the commoner form that a variant stands for.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Tasks count them before
the counts meet. To plant errors whose forms are known, ``every`` deletes a code point of each run
for which crc32 of ``<id>:<run>`` is a multiple of it; this depends on nothing but id and run.

Near words are found by asymmetric chunks. The shorter word of a pair (either one, if they are
equally long) is cut into two disjoint chunks; one edit leaves a chunk whole. The other word
gives its positional grams: of the length of each chunk, at the place where the chunk still
stands after the edit, which is its own place for a chunk before the edit, and one further for a
chunk behind an inserted code point. Chunks and grams that are equal and within that shift join,
and what is left between them is verified: it must differ by one edit. An edit could be told in
two places only at a border of chunks; the last possible place counts, so each pair is found once.

Chunks that very many words share are refined instead of joined: where the words that share one
would give more than ``PAIRS`` candidates, the rest of each word is cut into two chunks again and
one of these has to be shared as well, until the rest is one code point. Then a chunk and a rest
can belong to at most 90 shorter words and 90 * 90 longer ones, as the alphabet has 90 letters.
So no candidate is dropped, and no list of words grows with the input.

Defined cases: a null text has no words, a null id counts as an empty one; copies count as often
as they occur; runs are taken whole, however long; of equally common near words the smallest in
code-point order is the form. An empty table gives an empty result. Only the id and the text are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specflow.llm.common import bounded_batches, frozen, slices, word_lists

#: of Latin-1: lower-cases A-Z and turns everything but letters into a blank
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: words that a task counts before it hands the counts on
HELD = 500_000
#: candidates of a chunk from which it is refined
PAIRS = 5_000


def letter_runs(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased runs as Latin-1, whose bytes are code points; other letters become blanks."""
    return word_lists(text.decode("utf-8", "replace").encode("latin-1", "replace").translate(LETTERS))


def word_counts(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 6, every: int | None = None) -> DataFrame:
    """word, n: occurrences of the words of ``least`` code points or more."""

    def rows(counts: Counter) -> pa.RecordBatch:
        found = [(w.decode("latin-1"), n) for w, n in counts.items() if n and len(w) >= least]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"]
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part, texts in slices(batches, "text"):
            for key, body in zip(part.column("id").to_pylist(), texts):
                prefix = crc32(f"{key}:".encode())
                for runs in letter_runs(body):
                    words = [w for w in runs if len(w) >= least]
                    counts.update(words)
                    for word in set(words) if every else ():
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                        if h % every == 0:
                            n, at = words.count(word), h % len(word)
                            counts[word] -= n
                            counts[word[:at] + word[at + 1 :]] += n
            if len(counts) > HELD:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    read = df.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return bounded_batches(read).mapInArrow(each, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def cut(rows: DataFrame, pieces: int) -> DataFrame:
    """Rows (word, n, len, extra, piece) with the ``piece``-th of so many pieces apart from the rest.

    ``len`` is the length of the shorter word; a longer one (``extra`` 1) has one code point more
    in the piece, and what follows stands one further.
    """
    def place(piece: Column) -> Column:
        return F.floor(F.col("len") * piece / pieces).cast("int")

    start, end, extra = place(F.col("piece")), place(F.col("piece") + 1), F.col("extra")
    return rows.select(
        "word", "n", "len", "extra", "piece", (end - start).alias("width"),
        F.concat(F.substr("word", F.lit(1), start), F.lit("|"), F.substr("word", end + extra + 1)).alias("rest"),
        F.substr("word", start + 1, end + extra - start).alias("middle"),
    )


KEY = ["len", "piece", "rest"]


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Pairs of words one edit apart, each once: a, a_n, b, b_n; ``words`` has distinct ``word`` and ``n``.

    In a pair, a is the shorter word, or the smaller one of two that are equally long.
    """
    sized = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"))
    sized = sized.withColumn("len", F.length("word") - F.col("extra")).filter("len > 0")
    rows, pieces, found = sized.withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1)))), 2, None
    while True:
        rows = frozen(cut(rows, pieces), "chunks")
        shorter, longer = F.sum(1 - F.col("extra")), F.sum("extra")
        candidates = shorter * (shorter - 1) / 2 + shorter * longer
        crowded = rows.groupBy(*KEY, "width").agg(candidates.alias("candidates"))
        crowded = frozen(crowded.filter((F.col("candidates") > pairs) & (F.col("width") > 1)).select(*KEY), "crowded")
        joined = verified(rows.join(crowded, KEY, "left_anti"), pieces)
        found = joined if found is None else found.unionByName(joined)
        if crowded.isEmpty():
            return found
        halves = F.explode(F.array(2 * F.col("piece"), 2 * F.col("piece") + 1))
        rows = rows.join(crowded, KEY, "left_semi").select("word", "n", "len", "extra", halves.alias("piece"))
        pieces *= 2


def verified(rows: DataFrame, pieces: int) -> DataFrame:
    """Joins equal rests and keeps the pairs whose pieces differ by one edit."""
    a = rows.filter("extra = 0").select(*KEY, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("middle").alias("a_middle"))
    b = rows.select(*KEY, "extra", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("middle").alias("b_middle"))
    # an insertion that could as well stand behind the piece belongs to a later one
    own = (F.col("piece") == pieces - 1) | ~F.startswith(F.col("b_middle"), F.col("a_middle"))
    order = F.when(F.col("extra") == 0, F.col("a") < F.col("b")).otherwise(own)
    edit = F.levenshtein("a_middle", "b_middle", 1) == 1
    return a.join(b, KEY).filter(order & edit).select("a", "a_n", "b", "b_n")


def variants(words: DataFrame, ratio: int = 5, pairs: int = PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the distinct words.

    A word's form is its commonest near word, if that is ``ratio`` times as common at least; its
    root is where following forms ends.
    """
    if ratio < 2:
        raise ValueError("forms must be commoner than their variants: ratio of 2 or more")
    words = frozen(words.select("word", "n"), "words")
    found = frozen(near_pairs(words, pairs), "near")
    both = found.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        found.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    form_n = F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less"))
    told = words.join(best, "word", "left").select(
        "word", F.when(form_n.isNotNull(), F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form_n.alias("form_n"),
    )
    told = frozen(told, "forms")
    roots = followed(told.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """word, root: links without circles followed to their ends, twice as far in each round."""
    links = frozen(links, "links")
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = links.join(onward, F.col("root") == F.col("at"), "left")
        moved = frozen(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return links


def spelling_variants(
    df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 6, often: int = 5, ratio: int = 5, every: int | None = None,
) -> DataFrame:
    """Words of ``least`` code points and ``often`` occurrences or more, with their forms and roots."""
    return variants(word_counts(df, id, text, least, every).filter(F.col("n") >= often), ratio)
