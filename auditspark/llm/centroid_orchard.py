"""Centroid clustering with exact integer vectors and Orchard's search.

Vectors are scaled and floored to integers, so distances, sums and means are
exact. Nearest centroids are found by Orchard's search: every centroid has the
list of the others sorted by their distance from it; a vector walks along the list
of its best centroid so far, skips centroids that it has visited, jumps to the list
of a closer one as soon as it finds it, and stops strictly beyond twice its current
distance, where by the triangle inequality no centroid can be as close. Ties go to
the smaller number; as the stop is strict, a tied centroid is always seen.

Each round reads the written integer vectors once; a task sends one row of sums for
each of its clusters, which Spark adds up. Only the centroids themselves (their
number and their components are parameters) come to the driver.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: components up to this size have squared distances of 64 such terms within 64 bits
NARROW = 1 << 27
#: components of this size or more have no 64-bit form; such vectors are left out like non-finite ones
WIDEST = 1 << 62
BLOCK = 1 << 13  # vectors that walk together


def integers(rows: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """Rows whose vector has ``dims`` finite components, with ``q``: floor(scale * x) of each."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < F.lit(float(WIDEST))))
    kept = rows.where((F.size(v) == dims) & good)
    return kept.withColumn("q", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


class Orchard:
    """Sorted neighbour lists of the centroids, and the search over them."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = max((abs(x) for c in centroids for x in c), default=0) > NARROW  # then Python's integers
        self.c = np.array(centroids, dtype=object if self.exact else np.int64).reshape(len(centroids), -1)
        between = ((self.c[:, None, :] - self.c[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.array([sorted(range(len(self.c)), key=lambda j, i=i: (between[i, j], j)) for i in range(len(self.c))]).reshape(len(self.c), -1)
        self.far = np.take_along_axis(between, self.lists, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of the nearest centroids of the rows of ``x``."""
        if self.exact or (len(x) and int(np.abs(x).max()) > NARROW):
            x, c = x.astype(object), self.c.astype(object)
        else:
            c = self.c
        n, k = len(x), len(self.c)
        best = np.zeros(n, np.int64)
        dist = ((x - c[0]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        place = np.zeros(n, np.int64)  # in the list of the best centroid
        live = np.arange(n)
        while True:
            live = live[place[live] < k]
            at, p = best[live], place[live]
            near = (self.far[at, p] <= 4 * dist[live]).astype(bool)  # beyond twice the distance: squared, four times
            live, at, p = live[near], at[near], p[near]
            if not len(live):
                return best, dist
            other = self.lists[at, p]
            place[live] += 1
            new = ~visited[live, other]
            who, other = live[new], other[new]
            visited[who, other] = True
            d = ((x[who] - c[other]) ** 2).sum(axis=1)
            closer = ((d < dist[who]) | ((d == dist[who]) & (other < best[who]))).astype(bool)
            who = who[closer]
            best[who], dist[who], place[who] = other[closer], d[closer], 0


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def _means(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids of the next round: exact floored means, empty ones as they were."""
    def sums(batches):
        orchard, total, count = Orchard(centroids), np.zeros((len(centroids), dims), object), np.zeros(len(centroids), np.int64)
        for b in _blocks(batches):
            x = _vectors(b.column(0), dims)
            of, _ = orchard.nearest(x)
            small = len(x) and int(np.abs(x).max()) <= NARROW  # a block's sums fit then
            for j in np.unique(of):
                mine = x[of == j]
                total[j] += (mine if small else mine.astype(object)).sum(axis=0).astype(object)
                count[j] += len(mine)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used], pa.int64())] + [pa.array(total[used, i].tolist(), pa.decimal128(38, 0)) for i in range(dims)],
            ["c", "n", *[f"s{i}" for i in range(dims)]])

    parts = vectors.select("q").mapInArrow(sums, "c int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(dims)))
    out = [list(c) for c in centroids]
    for r in parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)]).collect():  # a row for each centroid
        out[r.c] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
    return out


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2",
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite (or too
    large for 64 bits once scaled). The first centroids are the ``k`` vectors with the
    smallest SHA-256 of ``seed:id``; equal ids are ordered by their components, a null
    id stands for empty text. With fewer vectors than ``k`` there are as many centroids
    as vectors; an empty table gives no rows. Repeated rows each have a row; several
    centroids may be equal, and then the smallest number has the vectors. A distance or
    inertia beyond 64 bits is null. Other columns are not read.
    """
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = named.schema["id"].dataType.simpleString()
    vectors = cut(integers(named, "v", dims, scale).select("id", "q"), "integer-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.q) for r in vectors.orderBy(key, "q").limit(k).select("q").collect()]  # k rows
    if not centroids:
        return rows.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = _means(vectors, centroids, dims)

    def assign(batches):
        orchard = Orchard(centroids)
        for b in _blocks(batches):
            of, dist = orchard.nearest(_vectors(b.column(1), dims))
            far = pa.array([int(d) if d < 1 << 63 else None for d in dist], pa.int64()) if dist.dtype == object else pa.array(dist, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of, pa.int32()), far], ["id", "cluster", "distance"])

    spark = rows.sparkSession
    placed = cut(vectors.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned-vectors")
    wide = "decimal(38,0)"
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide)).alias("s"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("m")).collect()
    whole = all(r.n == r.m for r in sums)
    total = sum(int(r.s or 0) for r in sums) if whole else None
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    facts = [(r.cluster, fits(int(r.s)) if r.n == r.m else None, fits(total), [int(x) for x in centroids[r.cluster]]) for r in sums]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return placed.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
