import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from specflow.llm import simhash

from .conftest import prose, rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, width=4):
    words = [w.decode() for w in (text or "").translate(UPPER).encode().split()]
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    """Smallest print reachable from each."""
    todo, out = set(prints), {}
    for start in sorted(prints):
        if start not in todo:
            continue
        todo.discard(start)
        queue = [start]
        while queue:
            at = queue.pop()
            out[at] = start
            near = [p for p in todo if bin(p ^ at).count("1") <= distance]
            todo.difference_update(near)
            queue += near
    return out


def test_fingerprints_and_components(documents, spark):
    table = documents.collect()
    prints = [brute_print(r["text"]) for r in table]
    of = brute_components(set(prints))
    least = {}
    for r, p in zip(table, prints):
        if r["doc_id"] is not None:
            least[of[p]] = min(least.get(of[p], r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], p - (1 << 64) if p >> 63 else p, least.get(of[p])) for r, p in zip(table, prints)), key=repr)
    assert rows(simhash.near_duplicates(documents), "doc_id", "fingerprint", "component_id") == want


def planted(seed, size):
    """Chains, dense groups and lone fingerprints."""
    draw = random.Random(seed)
    out = {draw.getrandbits(64) for _ in range(size)}
    for _ in range(6):
        at = draw.getrandbits(64)
        for _ in range(size // 6):
            out.add(at)
            for bit in draw.sample(range(64), draw.randint(1, 6)):
                at ^= 1 << bit
    centre = draw.getrandbits(64)
    for _ in range(size):
        other = centre
        for bit in draw.sample(range(64), draw.randint(0, 5)):
            other ^= 1 << bit
        out.add(other)
    return out


@pytest.mark.parametrize("per_cell", [20_000, 40])
def test_links_join_what_is_within_reach(spark, per_cell):
    prints = planted(4, 300)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "_print bigint")
    found = simhash.links(nodes, 4, per_cell).collect()
    assert len(found) < 60 * len(prints)
    joined = simhash.components(spark.createDataFrame([tuple(r) for r in found], "a bigint, b bigint")).collect()
    got = {r["node"] % (1 << 64): r["root"] for r in joined}
    groups = {}
    for p, root in brute_components(prints).items():
        groups.setdefault(root, set()).add(p)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    ours = {}
    for node, root in got.items():
        ours.setdefault(root, set()).add(node)
    assert {frozenset(g) for g in ours.values()} == want


def test_embedding_is_a_lower_bound_and_grids_meet():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 62, 2_000).astype(np.uint64) * np.uint64(3)
    flips = np.array([sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), False)) for _ in a], np.uint64)
    b = a ^ flips
    x, y = simhash.embed(a), simhash.embed(b)
    assert (np.bitwise_count(x ^ y) <= np.bitwise_count(a ^ b)).all()
    for v, code in zip(a[:200].tolist(), x[:200].tolist()):
        counts = [bin(v >> s & 3).count("1") for s in range(0, 64, 2)]
        assert [code >> s & 3 for s in range(0, 64, 2)] == [(0, 1, 3)[c] for c in counts]
    apart = [sum(abs(bin(v >> s & 3).count("1") - bin(w >> s & 3).count("1")) for s in range(0, 64, 2)) for v, w in zip(a[:200].tolist(), b[:200].tolist())]
    assert np.bitwise_count(x ^ y)[:200].tolist() == apart
    meet = np.zeros(len(a), bool)
    for mask in simhash.grids(4):
        meet |= (x & mask) == (y & mask)
    assert meet.all()


def test_a_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501)]
    got = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_one_row_of_each_component_stays(documents):
    found = simhash.near_duplicates(documents.select("doc_id", "text"))
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    prints = {brute_print(r["text"]) for r in documents.collect()}
    assert kept.count() == len(set(brute_components(prints).values()))
    assert found.count() == documents.count()


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def test_near_copies_of_prose(spark):
    draw = random.Random(8)
    base = prose(draw, 400)
    texts = [base, base.upper(), base.replace("  ", " ") + " more", prose(draw, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got[1] == 0 and got[3] == 3
