"""Sharding by jump consistent hash (Lamping and Veach, 2014): no ring table.

The id and the number of shards decide; with one more shard, rows move only into the new
one. Slots number the rows of a shard from 0 without gaps and without gathering a shard.

Defined cases: a null id is a key like any other, so such rows share a shard; rows with
the same id share a shard, where each copy has a slot of its own, in the order in which tasks wrote
them; a null text has no bytes, a long one counts whole. An empty table gives an empty result; added
columns change their names where the table has them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.llm.common import numbered

STEP = 2862933555777941757  # the multiplier of the published algorithm


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys at once."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    ahead = np.zeros(len(state), np.int64)
    while len(going):
        shard[going] = ahead
        state[going] = state[going] * np.uint64(STEP) + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead = ((ahead + 1) * (float(1 << 31) / draw)).astype(np.int64)
        inside = ahead < shards
        going, ahead = going[inside], ahead[inside]
    return shard


def shard_of(key, shards: int):
    """Column of shards for a column of ids of any type."""

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key.cast("string")))


def shard_rows(df: DataFrame, shards: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size (bytes of the text plus 1), text_crc32, shard, grown_shard and slot of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(id),
        (F.octet_length(whole) + 1).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        shard_of(F.col(id), shards).alias("shard"),
        shard_of(F.col(id), shards + 1).alias("grown_shard"),
    )
    return numbered(narrow, "shards", "shard", "slot")[0]
