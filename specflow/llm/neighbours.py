"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced splits of a bounded sample; they and a graph that links each to
its nearest ones are broadcast. A vector goes to its nearest list and to the next ones whose
centroid is nearly as near (boundary vectors). A query walks the graph and reads every list whose
centroid is within a ratio of the nearest one.

Lists are short, and those that split late, which lie side by side, stand on one shelf. A shelf
holds a vector once with the lists it is in, a query comes once with the lists it reads there, and
the nearest of all of them leave the task together. Large shelves, and shelves that many queries
read, are dealt as pairs of chunks. Queries with too few finds read every list.

Only the ``k + 1`` smallest ids of equal vectors are indexed: others cannot be among the
``k`` nearest of any query, because ties go to smaller ids.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, neither do null ids. Rows with the same id are one
candidate, at their smallest distance. With fewer candidates than ``k`` all are returned. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specflow.llm.common import bounded_batches, frozen

#: rows from which centroids are found (rows of smallest id hash), and most centroids
SAMPLE = 32_768
MOST_LISTS = 8_192
#: vectors a list holds on average before replication, and a shelf of neighbouring lists
LIST_ROWS = 160
SHELF_ROWS = 4_096
#: links of a centroid, and centroids that a walk leaves from at least
LINKS, LEAST = 24, 24
#: a vector's walk goes on from centroids within this ratio of the nearest
EXPLORE = 1.1
#: a vector is copied to lists within this ratio of its nearest centroid, to so many in all
CLOSURE, COPIES = 1.15, 5
#: a query reads all lists within this ratio of its nearest centroid
PRUNE = 1.105
#: vectors and queries that meet in one group
CHUNK = 8_192


def usable(vector: str) -> Column:
    """Not null, not zero, and all components finite."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < infinite), F.lit(False)))
    return F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def split(points: np.ndarray, at: np.ndarray, most: int, random: np.random.Generator) -> list[np.ndarray]:
    """Cuts the points into clusters of at most ``most``."""
    if len(at) <= most:
        return [at]
    own = points[at]
    ways = min(8, -(-len(at) // most))
    centres = own[random.choice(len(own), ways, replace=False)]
    for _ in range(6):
        near = (own @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        centres = np.stack([own[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(ways)])
    parts = [at[near == c] for c in range(ways) if (near == c).any()]
    if len(parts) == 1:
        parts = np.array_split(at, 2)
    return [leaf for part in parts for leaf in split(points, part, most, random)]


class Graph:
    """Centroids, the links between them, and where walks begin."""

    def __init__(self, points: np.ndarray, lists: int, shelves: int = 1):
        random = np.random.default_rng(7)
        most = max(1, -(-len(points) * 5 // (4 * lists)))
        leaves = split(points, np.arange(len(points)), most, random)
        self.centres = np.stack([points[leaf].mean(axis=0) for leaf in leaves]).astype(np.float64)
        # leaves come in the order of the splits, so neighbours are near each other
        before = np.cumsum([len(leaf) for leaf in leaves]) - [len(leaf) for leaf in leaves]
        self.shelf = (before * shelves // len(points)).astype(np.int32)
        own = np.concatenate([((points[leaf] - centre) ** 2).sum(axis=1) for leaf, centre in zip(leaves, self.centres)])
        self.radius = float(np.sqrt(np.median(own)))
        count = len(self.centres)
        squares = (self.centres**2).sum(axis=1)
        links = []
        for start in range(0, count, 512):
            apart = squares - 2 * self.centres[start : start + 512] @ self.centres.T
            apart[np.arange(len(apart)), np.arange(start, start + len(apart))] = -np.inf
            links.append(np.argsort(apart, axis=1)[:, 1 : LINKS + 1])
        ring = ((np.arange(count) + 1) % count)[:, None]
        self.links = np.concatenate([np.concatenate(links), ring], axis=1)
        self.begin = np.unique(np.linspace(0, count - 1, min(16, count)).astype(np.int64))

    def walk(self, vectors: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the centroids that a best-first walk meets (else infinite), and each vector's reach.

        The reach is ``ratio`` times the nearest distance found, or times half a list's usual radius
        if that is more. A walk ends when no centroid within its reach is left to go on from;
        all vectors advance together.
        """
        rows, count = len(vectors), len(self.centres)
        apart = np.full((rows, count), np.inf)
        apart[:, self.begin] = np.sqrt(((self.centres[self.begin] - vectors[:, None]) ** 2).sum(axis=2))
        left = apart.copy()
        going, steps = np.arange(rows), 0
        while len(going):
            pick = left[going].argmin(axis=1)
            reach = ratio * np.maximum(apart[going].min(axis=1), self.radius / 2)
            cost = left[going, pick]
            more = (cost <= reach) | (steps < LEAST) & np.isfinite(cost)
            going, pick, steps = going[more], pick[more], steps + 1
            left[going, pick] = np.inf
            near = self.links[pick]
            gaps = np.sqrt(((self.centres[near] - vectors[going][:, None]) ** 2).sum(axis=2))
            new = np.isinf(apart[going[:, None], near])
            at, to = np.repeat(going, new.sum(axis=1)), near[new]
            apart[at, to] = gaps[new]
            left[at, to] = gaps[new]
        return apart, ratio * np.maximum(apart.min(axis=1), self.radius / 2)

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs: the nearest list of each, and further ones of boundary vectors."""
        apart, _ = self.walk(vectors, EXPLORE)
        ids = np.argsort(apart, axis=1, kind="stable")[:, :COPIES]
        far = np.take_along_axis(apart, ids, 1)
        rows, places = np.nonzero(far <= CLOSURE * far[:, :1])
        return rows, ids[rows, places]

    def by_shelf(self, rows: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Pairs grouped by row and shelf: rows, shelves, lists of each."""
        order = np.lexsort((lists, self.shelf[lists], rows))
        rows, lists = rows[order], lists[order]
        shelves = self.shelf[lists]
        cuts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (shelves[1:] != shelves[:-1])]) if len(rows) else np.zeros(0, int)
        return rows[cuts], shelves[cuts], [part.tolist() for part in np.split(lists, cuts[1:])] if len(rows) else []


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """id and vec (doubles as bytes), with the ``most`` smallest ids of equal vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: dict[bytes, set[int]] = {}
            # adding zero turns minus zero into zero
            for id, vec in zip(batch.column("id").to_pylist(), matrix(batch.column("vec")) + 0.0):
                ids.setdefault(vec.tobytes(), set()).add(id)
            found = [(i, vec) for vec, own in ids.items() for i in sorted(own)[:most]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([v for _, v in found], pa.binary())], ["id", "vec"]
            )

    combined = bounded_batches(rows).mapInArrow(each, "id bigint, vec binary")
    place = F.dense_rank().over(W.partitionBy("vec").orderBy("id"))
    return combined.withColumn("place", place).filter(F.col("place") <= most).select("id", "vec").distinct()


def nearest(probes: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the nearest on each shelf, among the lists that a query reads there."""
    spark = probes.sparkSession
    # one row for each shelf, of which there are MOST_LISTS at most
    held = {r["shelf"]: r["count"] for r in postings.groupBy("shelf").count().collect()}
    asked = {r["shelf"]: r["count"] for r in probes.groupBy("shelf").count().collect()}
    deal = [(i, -(-n // CHUNK), -(-asked[i] // CHUNK)) for i, n in held.items() if i in asked]
    sizes = F.broadcast(spark.createDataFrame(deal, "shelf int, parts int, asks int"))
    pick = "cast(pmod(xxhash64({}), {}) as int)"
    left = probes.join(sizes, "shelf").selectExpr(
        "query_id", "vec", "shelf", "lists", pick.format("query_id, vec", "asks") + " AS ask", "explode(sequence(0, parts - 1)) AS part"
    )
    right = postings.join(sizes, "shelf").selectExpr(
        "id", "vec", "shelf", "lists", "explode(sequence(0, asks - 1)) AS ask", pick.format("id", "parts") + " AS part"
    )

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids = rows["id"].to_numpy()
            vectors = np.frombuffer(b"".join(rows["vec"]), np.float64).reshape(len(rows), -1)
            sizes = [len(own) for own in rows["lists"]]
            lists, at = np.concatenate(rows["lists"].to_list()), np.repeat(np.arange(len(rows)), sizes)
            order = np.argsort(lists, kind="stable")
            lists, at = lists[order], at[order]
            for query, vec, read in zip(queries["query_id"], queries["vec"], queries["lists"]):
                starts, ends = np.searchsorted(lists, read, "left"), np.searchsorted(lists, read, "right")
                found = np.unique(np.concatenate([at[a:b] for a, b in zip(starts, ends)]))
                found = found[ids[found] != query]
                score = np.sqrt(((vectors[found] - np.frombuffer(vec, np.float64)) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], score))[:k]
                out += zip([query] * len(best), ids[found[best]], score[best])
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["shelf", "ask", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id bigint, vec_id bigint, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of every row for which ``is_query`` holds."""
    spark = df.sparkSession
    valid = df.filter(usable(vector) & F.col(id).isNotNull())
    valid = valid.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vec"), is_query.alias("asks"))
    lengths = valid.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths["n"] if lengths else 0
    valid = valid.filter(F.size("vec") == length)
    rows = frozen(distinct_vectors(valid.select("id", "vec"), k + 1), "vectors")
    total = rows.count()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not total:
        return empty
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    points = np.stack([np.frombuffer(r["vec"], np.float64) for r in sample])
    lists = max(1, min(MOST_LISTS, total // LIST_ROWS, len(points) // 4))
    graph = spark.sparkContext.broadcast(Graph(points, lists, max(1, min(lists, total // SHELF_ROWS))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if len(part):
                vectors = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float64).reshape(len(part), -1)
                rows_, shelves, homes = graph.value.by_shelf(*graph.value.homes(vectors))
                taken = part.take(pa.array(rows_))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(shelves, pa.int32()), pa.array(homes, pa.list_(pa.int32()))], ["id", "vec", "shelf", "lists"])

    def asking(all_lists: bool):
        """Queries with the lists they read, per shelf."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                if len(part):
                    vectors = matrix(part.column("vec")) + 0.0
                    apart, reach = graph.value.walk(vectors, PRUNE)
                    read = np.ones(apart.shape, bool) if all_lists else apart <= reach[:, None]
                    places, shelves, lists = graph.value.by_shelf(*np.nonzero(read))
                    vecs = [v.tobytes() for v in vectors]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(places)), pa.array([vecs[p] for p in places], pa.binary()),
                         pa.array(shelves, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "vec", "shelf", "lists"])

        return each

    postings = frozen(bounded_batches(rows).mapInArrow(post, "id bigint, vec binary, shelf int, lists array<int>"), "postings")
    queries = frozen(valid.filter("asks").select("id", "vec").distinct(), "queries")
    read = "query_id bigint, vec binary, shelf int, lists array<int>"
    probes = frozen(bounded_batches(queries).mapInArrow(asking(False), read), "probes")
    found = frozen(ranked(nearest(probes, postings, k), k), "found")
    few = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    # every list for the queries that found too few; the number of lists is bounded
    short = queries.join(few.withColumnRenamed("query_id", "id"), "id", "left_anti")
    wide = frozen(bounded_batches(short).mapInArrow(asking(True), read), "wide")
    rest = ranked(nearest(wide, postings, k), k)
    names = ["query_id", "rank", "vec_id", "score"]
    return found.join(few, "query_id", "left_semi").select(names).unionByName(rest.select(names))
