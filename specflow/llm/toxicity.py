"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of the text with A-Z lower-cased, hashed to ``2**BITS``
places. Place j weighs r[j] = log of the ratio of its smoothed shares in documents of
label 1 and of label 0; logistic regression is trained on the scaled features (Wang and
Manning, 2012). Classifier and ratios are fit on the labelled rows of smallest id hash, at
most ``ROWS`` of each label and ``CHARACTERS`` code points in all, passing over texts that
no longer fit; the labels' true shares weigh the loss.

Defined cases: a null or empty text has no features and scores the bias; labels that are null
teach nothing, an id with several labels counts as 1 if one of them is; rows with the same id
all teach. Without rows of both labels every text scores the smoothed share of label 1. Texts of
any length are scored whole; copies score alike, and n-grams that weigh the same are kept by their
place. An empty table gives an empty result; added columns change their names where the table has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specflow.llm.common import LOWER, bounded_batches, fresh, slices

ORDERS = (4, 5, 6)
BITS = 20
ROWS = 2_000
CHARACTERS = 24_000_000
#: places that the regression may use, those with the largest ratios
FEATURES = 16_384
ALPHA = 0.5
PENALTY = 1e-4
ROUNDS = 150
THRESHOLD = 0.3

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


class Places:
    """Distinct feature places of a text; remembers its scratch table."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)

    def of(self, text: bytes) -> np.ndarray:
        codes = np.frombuffer((b" " + text.translate(LOWER) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        found = []
        for order in ORDERS:
            size = len(codes) - order + 1
            if size < 1:
                continue
            mixed = codes[:size] * _FACTORS[0]
            for step in range(1, order):
                mixed = (mixed ^ (mixed >> np.uint32(15))) * _FACTORS[step] + codes[step : step + size]
            found.append((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
        if not found:
            return np.zeros(0, np.uint32)
        places = np.concatenate(found)
        # the last writer of a place is its only holder
        order = np.arange(len(places), dtype=np.int32)
        self.last[places] = order
        return places[self.last[places] == order]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray) -> float:
        z = float(self.weights[places].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[bytes, int]], shares: tuple[float, float]) -> Model:
    """Naive Bayes ratios and logistic regression; ``shares`` are the labels' true shares."""
    weights = np.zeros(1 << BITS, np.float32)
    labels = np.array([label for _, label in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        return Model(weights, float(np.log(max(shares[1], 1e-6) / max(shares[0], 1e-6))))
    cut = Places()
    # places are found twice rather than held for all rows
    counts = np.zeros((2, 1 << BITS), np.int32)
    for text, label in rows:
        counts[label, cut.of(text)] += 1
    # shares of documents of the label that hold the place; long documents do not outweigh short ones
    sizes = np.array([[(labels == 0).sum()], [(labels == 1).sum()]])
    smooth = (counts + ALPHA) / (sizes + 2 * ALPHA)
    ratio = np.log(smooth[1] / smooth[0])
    seen = counts.sum(axis=0)
    telling = np.abs(ratio) * np.sqrt(seen)
    telling[seen < 3] = 0
    chosen = np.argsort(-telling, kind="stable")[:FEATURES]
    chosen = chosen[telling[chosen] > 0]
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    kept = [c[c >= 0] for c in (column[cut.of(text)] for text, _ in rows)]
    row = np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k in kept])
    col = np.concatenate(kept)
    value = ratio[chosen].astype(np.float32)[col]
    weight = np.where(labels == 1, shares[1] / sizes[1, 0], shares[0] / sizes[0, 0])
    weight /= weight.sum()
    beta, bias = np.zeros(len(chosen)), float(np.log(shares[1] / shares[0]))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, value * beta[col], len(kept)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) * weight
        gradient = np.append(np.bincount(col, value * error[row], len(chosen)) + PENALTY * beta, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        beta, bias = beta - move[:-1], bias - move[-1]
    weights[chosen] = beta * ratio[chosen]
    return Model(weights, float(bias))


def train(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model of the rows of ``df`` that ``labels`` names."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id"))
    known = known.agg(F.max(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = tuple((counts.get(c, 0) + 0.5) / (sum(counts.values()) + 1) for c in (0, 1))
    picks = None
    for c in (0, 1):
        some = known.filter(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(ROWS)
        picks = some if picks is None else picks.union(some)
    # at most 2 * ROWS rows
    held = df.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    held = held.join(F.broadcast(picks), "_id").withColumn("_size", F.length("_text")).withColumn("_hash", F.xxhash64("_text"))
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_hash")]
    # equal rows are one row with their number
    texts = held.groupBy("_id", "_hash", "_size", "_label").agg(F.count(F.lit(1)).alias("_n")).orderBy(*order).limit(2 * ROWS).collect()
    taken, left, space = [], 2 * ROWS, CHARACTERS
    for r in texts:
        # a text that does not fit is passed over
        n = min(r["_n"], left, space // r["_size"] if r["_size"] else r["_n"])
        if n:
            taken.append((r["_id"], r["_hash"], len(taken), n, r["_label"]))
            left, space = left - n, space - n * r["_size"]
    if not taken:
        return fit([], shares)
    kind = T.StructType([held.schema["_id"], T.StructField("_hash", T.LongType()), T.StructField("_at", T.LongType())])
    chosen = df.sparkSession.createDataFrame([t[:3] for t in taken], kind)
    # at most CHARACTERS in all
    found = held.join(F.broadcast(chosen), ["_id", "_hash"]).groupBy("_at").agg(F.first("_text").alias("_text"))
    text_at = {r["_at"]: r["_text"].encode() for r in found.collect()}
    rows = [(text_at[at], label) for _, _, at, n, label in taken for _ in range(n)]
    return fit(rows, shares)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``out``, the probability of label 1."""
    keep = df.columns if keep is None else keep
    (out,) = fresh(df.select(keep), out)
    shared = df.sparkSession.sparkContext.broadcast(model)
    passed = [f for f in df.schema.fields if f.name in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Places()
        for part, rows in slices(batches, text):
            scores = pa.array([shared.value.score(cut.of(row)) for row in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in passed], scores], schema.names)

    schema = T.StructType([*passed, T.StructField(out, T.DoubleType())])
    needed = [f.name for f in df.schema.fields if f.name in keep or f.name == text]
    return bounded_batches(df.select(*needed)).mapInArrow(each, schema)
