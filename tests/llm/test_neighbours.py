import numpy as np
import pytest
from pyspark.sql import functions as F

from specflow.llm import neighbours


def brute(table, is_query, k=10):
    """Nearest other rows of each query by double-precision distance, ties to smaller ids."""
    found = {}
    for q in table:
        if is_query(q[0]):
            score = {}
            for other in table:
                if other[0] != q[0]:
                    apart = float(np.sqrt(((np.array(q[1]) - np.array(other[1])) ** 2).sum()))
                    score[other[0]] = min(apart, score.get(other[0], np.inf))
            found[q[0]] = sorted((s, i) for i, s in score.items())[:k]
    return found


def vectors(spark, rows):
    schema = "vec_id bigint, embedding array<float>, query_id int, list int, score string"
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], schema)


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["score"], r["vec_id"]))
    return out


def clustered(n, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((30, 16))
    points = centres[draw.integers(0, 30, n)] + 0.4 * draw.standard_normal((n, 16))
    return [(i, [float(x) for x in p.astype(np.float32)]) for i, p in enumerate(points)]


def recall(got, want):
    hits = sum(len({i for _, i in got[q]} & {i for _, i in own}) for q, own in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_scores_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 300)
    rows = clustered(3_000)
    hot = rows[100][1]
    rows += [(3_000 + i, hot) for i in range(1_500)]
    got = results(neighbours.search(vectors(spark, rows).repartition(6), F.col("vec_id") % 100 == 0))
    want = brute(rows, lambda i: i % 100 == 0)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    of = dict(rows)
    for q, own in got.items():
        for score, other in own:
            exact = np.sqrt(((np.array(of[q]) - np.array(of[other])) ** 2).sum())
            assert score == pytest.approx(exact, abs=1e-12)
    assert got[100] == want[100] and got[3_000] == want[3_000]


def test_few_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i * 100, [float(i), 1.0, -0.0]) for i in range(4)] + [(7, [1.0, 1.0, 0.0]), (7, [9.0, 9.0, 9.0]), (100, [1.0, 1.0, 0.0])]
    bad = [(200_000, None), (300_000, [0.0, 0.0, 0.0]), (400_000, [nan, 1.0, 1.0]), (500_000, [inf, 1.0, 1.0]),
           (600_000, [None, 1.0, 1.0]), (700_000, []), (800_000, [1.0]), (None, [1.0, 1.0, 1.0])]
    got = results(neighbours.search(vectors(spark, rows + bad), F.col("vec_id") % 100 == 0))
    assert got == brute(rows, lambda i: i % 100 == 0)


def test_empty_table(spark):
    assert neighbours.search(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    only = vectors(spark, [(0, [1.0, 2.0])])
    assert neighbours.search(only, F.lit(True)).count() == 0


def test_walk_finds_the_nearest_centroids():
    points = np.array([v for _, v in clustered(4_000)])
    graph = neighbours.Graph(points, 200)
    sizes = [len(x) for x in neighbours.split(points, np.arange(len(points)), 25, np.random.default_rng(7))]
    assert sum(sizes) == len(points) and max(sizes) <= 25
    apart, reach = graph.walk(points[:200], 1.3)
    exact = np.sqrt(((graph.centres[None] - points[:200, None]) ** 2).sum(axis=2))
    met = np.isfinite(apart)
    assert np.allclose(apart[met], exact[met])
    assert (apart.argmin(axis=1) == exact.argmin(axis=1)).mean() > 0.97
    inside = exact <= reach[:, None]
    assert (met & inside).sum() > 0.97 * inside.sum()
    rows, homes = graph.homes(points[:200])
    counts = np.bincount(rows, minlength=200)
    assert counts.min() == 1 and 1 < counts.max() <= neighbours.COPIES and len(set(zip(rows, homes))) == len(rows)


def test_the_index_reads_few_lists_of_many(spark):
    """20 000 vectors: bounded lists, real copies, pruning that selects, and still the right neighbours."""
    rows = clustered(20_000, 9)
    points = np.array([v for _, v in rows])
    graph = neighbours.Graph(points[: neighbours.SAMPLE], len(points) // neighbours.LIST_ROWS, 4)
    count = len(graph.centres)
    of, homes = graph.homes(points)
    held = np.bincount(homes, minlength=count)
    apart, reach = graph.walk(points[::100], neighbours.PRUNE)
    read = (apart <= reach[:, None]).sum(axis=1)
    assert count > 100 and held.max() < 10 * neighbours.LIST_ROWS
    assert len(of) / len(points) > 1.1
    assert read.mean() < 0.25 * count
    assert len(set(graph.shelf)) == 4 and (np.diff(graph.shelf) >= 0).all()
    got = results(neighbours.search(vectors(spark, rows).repartition(6), F.col("vec_id") % 500 == 0))
    exact = {}
    for q in range(0, len(rows), 500):
        gaps = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        gaps[q] = np.inf
        exact[q] = [(gaps[i], int(i)) for i in np.lexsort((np.arange(len(rows)), gaps))[:10]]
    assert recall(got, exact) >= 0.9


def test_sf_tables(spark):
    path = "/root/testdata/sf0.01"
    got = results(neighbours.search(spark.read.parquet(f"{path}/embeddings.parquet"), F.col("vec_id") % 100 == 0))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert recall(got, brute(rows, lambda i: i % 100 == 0)) >= 0.9
