"""Centroid clustering by exponion search (operator 13).

Lloyd's rounds over integer vectors. Each vector keeps an upper bound of the distance to
its own centroid and a lower bound of the distance to any other; both move with the
centroids. While the upper bound stays below the lower one, or below half the way to the
nearest other centroid, nothing can have changed. Otherwise the own distance is computed;
if that does not settle it, only centroids are scanned inside a ball around the own one,
of radius twice that distance plus the way to the nearest other centroid: the nearest and
the second nearest of all lie in there. The candidates are a prefix of the list of other
centroids sorted by distance. The radius is inclusive and bounds only skip where they are
strictly apart, so ties go to the smaller number as in the full search.

Vectors, assignments and bounds are one table, written anew each round (the one before is
removed then), so a lost executor costs no more than the round at work. A task adds one row
with the exact integer sums of what it has assigned; the driver sees only their total, the
size of the centroids. Bounds are widened by a hair each time, distances are exact.

Defined cases: a vector that is null or has another number of components, a null, NaN or
infinite one takes no part (no row); a null id takes part but begins no cluster; repeated
rows are vectors of their own; of equal hashes the smaller vector begins first; with fewer
vectors than clusters there are as many as vectors; equal centroids leave all but the first
empty, and empty ones stay; an empty table gives no rows; other columns are not read.
Components times the scale must stay below 2**26 (an error otherwise).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored
from .vectors import from_binary, quantised, to_binary

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
#: A row is a vector, or, without one, the sums of a task: per cluster of all components, then counts, then distances.
STATE = "vec_id long, vec binary, cluster int, distance long, upper double, lower double, sums array<long>"
OUTPUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_HAIR = 1e-12


class Geometry:
    """Centroids, their distances from each other in sorted lists, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids, k = centroids, len(centroids)
        apart = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).astype(float))
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.nearest = self.apart[:, 0] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(float))
        self.moved = moved * (1 + _HAIR)
        self.others_moved = np.array([np.delete(self.moved, c).max(initial=0.0) for c in range(k)])

    def squared(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        apart = vectors - self.centroids[which]
        return np.einsum("ij,ij->i", apart, apart)

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: list[int] | None = None) -> None:
        """Bring assignments and bounds of vectors up to date, in place; ``scanned`` counts the distances computed."""
        k = len(self.centroids)
        count = (lambda n: scanned.append(int(n))) if scanned is not None else lambda n: None
        new = np.flatnonzero(cluster < 0)
        if len(new):  # as if they had been assigned to centroid 0, with nothing known
            cluster[new], upper[new], lower[new] = 0, np.inf, -np.inf
        upper += self.moved[cluster]
        lower -= self.others_moved[cluster]
        upper *= 1 + _HAIR
        lower -= np.where(np.isfinite(lower), np.abs(lower) * _HAIR, 0)
        safe = np.maximum(lower, self.nearest[cluster] / 2 * (1 - _HAIR))
        doubt = np.flatnonzero(upper >= safe)
        own = self.squared(vectors[doubt], cluster[doubt])
        count(len(doubt))
        upper[doubt] = np.sqrt(own) * (1 + _HAIR)
        left = upper[doubt] >= safe[doubt]
        doubt, best = doubt[left], own[left]
        if not len(doubt):
            return
        centre, found = cluster[doubt], cluster[doubt].copy()
        radius = (2 * upper[doubt] + self.nearest[centre]) * (1 + _HAIR)
        inside = (self.apart[centre] <= radius[:, None]).sum(1)  # the lists are sorted: a prefix
        second = np.full(len(doubt), np.inf)
        for j in range(k - 1):
            rows = np.flatnonzero(inside > j)
            if not len(rows):
                break
            other = self.order[centre[rows], j]
            d = self.squared(vectors[doubt[rows]], other)
            count(len(rows))
            wins = (d < best[rows]) | ((d == best[rows]) & (other < found[rows]))
            second[rows] = np.minimum(second[rows], np.where(wins, best[rows], d))
            best[rows], found[rows] = np.where(wins, d, best[rows]), np.where(wins, other, found[rows])
        cluster[doubt] = found
        upper[doubt], lower[doubt] = np.sqrt(best) * (1 + _HAIR), np.sqrt(second) * (1 - _HAIR)


def _rows(ids: pa.Array, vec: pa.Array, cluster: np.ndarray, distance: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    columns = [ids, vec, pa.array(cluster, pa.int32()), pa.nulls(n, pa.int64()) if distance is None else pa.array(distance, pa.int64()), pa.array(upper), pa.array(lower), pa.nulls(n, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, STATE_NAMES)


STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]


def _pack(scale: int, width: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, vectors = quantised(batch.column(1), scale, width, exact_width=True)
            n = len(vectors)
            yield _rows(batch.column(0).filter(pa.array(usable)), to_binary(vectors), np.full(n, -1), None, np.zeros(n), np.zeros(n))

    return pack


def _assign(geometry: Geometry, width: int, last: bool) -> Callable:
    """A round over rows of STATE; sums of the round before are left out. The last one also computes all distances."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(geometry.centroids)
        sums, counts, inertia = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            vectors = from_binary(batch.column(1), width)
            cluster, upper, lower = (np.array(batch.column(c).to_numpy(zero_copy_only=False), kind) for c, kind in ((2, np.int64), (4, float), (5, float)))
            geometry.assign(vectors, cluster, upper, lower)
            distance = geometry.squared(vectors, cluster) if last else None
            by = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[by], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(vectors[by].astype(np.int64), first, axis=0)
                counts[present] += np.diff([*first, len(by)])
                if last:
                    inertia[present] += np.add.reduceat(distance[by], first)
            yield _rows(batch.column(0), batch.column(1), cluster, distance, upper, lower)
        total = pa.array([np.concatenate([sums.ravel(), counts, inertia]).tolist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind) for kind in (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.float64())] + [total], STATE_NAMES)

    return assign


def _totals(state: DataFrame, k: int, width: int) -> tuple[list[list[int]], list[int], list[int]]:
    """Sums, counts and inertia per cluster: k * (width + 2) numbers from one row a task, added up by Spark."""
    parts = state.where("vec is null").select(F.posexplode("sums").alias("at", "part"))
    total = [0] * (k * (width + 2))
    for row in parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total")).collect():
        total[row["at"]] = int(row["total"])
    return [total[c * width : (c + 1) * width] for c in range(k)], total[k * width : k * (width + 1)], total[k * (width + 1) :]


def first_centroids(vectors: DataFrame, id_column: str, vector_column: str, clusters: int, width: int, scale: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of seed and id, in the order of the hashes."""
    x, hashed = F.col(vector_column), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    usable = (F.size(x) == width) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & usable).select(hashed.alias("hash"), x.cast("array<double>").alias("x")).orderBy("hash", "x").limit(clusters).collect()
    return np.floor(scale * np.array([row.x for row in rows], float)).astype(np.int64).reshape(len(rows), width)


def cluster_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector that takes part: OUTPUT."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, id_column, vector_column, clusters, width, scale, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], OUTPUT)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("x")).mapInArrow(_pack(scale, width), STATE)
    geometry, path = Geometry(centroids), None
    for done in range(rounds + 1):
        state, now = stored(rows.mapInArrow(_assign(geometry, width, done == rounds), STATE), "clusters")
        if path:
            remove(spark, path)
        path = now
        sums, counts, inertia = _totals(state, k, width)
        if done < rounds:
            after = np.array([[x // n for x in total] if n else list(c) for total, n, c in zip(sums, counts, geometry.centroids.tolist(), strict=True)], np.int64)
            geometry, rows = Geometry(after, geometry.centroids), state
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in geometry.centroids.tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return state.where("vec is not null").select("vec_id", "cluster", "distance", of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))
