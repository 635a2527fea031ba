from collections import defaultdict
from zlib import crc32

import numpy as np

from specflow.llm.sharding import jump, shard_rows


def one_jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_follows_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for shards in (1, 2, 16, 17, 1000):
        assert jump(keys, shards).tolist() == [one_jump(int(k), shards) for k in keys]
    counts = np.bincount(jump(np.arange(100_000, dtype=np.uint64), 16), minlength=16)
    assert counts.min() > 5_500 and counts.max() < 7_000


def test_rows_keep_their_bytes_and_get_gapless_slots(documents):
    got = shard_rows(documents, 16).collect()
    want = documents.collect()
    assert len(got) == len(want)
    text = sorted((len((r["text"] or "").encode()) + 1, crc32((r["text"] or "").encode())) for r in want)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == text
    slots, shard = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shard[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard.values())


def test_empty_table(nothing):
    assert shard_rows(nothing, 16).count() == 0
