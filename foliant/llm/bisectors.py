"""Centroid clustering by a tournament over bisectors.

Of two centroids, the one nearer to a vector is told by the side of their bisector that it lies on: the sign of a linear form
with an integer normal and threshold, both computed once a round for each pair. A vector's nearest of k centroids is left
after k - 1 such tests; a zero is a tie, which the smaller number wins. A distance is computed only to the winner. All
arithmetic is on integers, so that results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components beyond are held at it: 64 products of a component and a normal then fit 64 bits.
MOST = 1 << 27
#: Rows that a tournament holds at once.
TOGETHER = 4_096


def integer_vectors(table: DataFrame, dimensions: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v (array<bigint>: floor(scale * x)) of the rows of `table` (vec_id, embedding) whose embedding has exactly so many
    components, none null or not finite. Components of over 2**27 once scaled are held at that; repeated rows are kept."""
    inside = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.coalesce((F.size("embedding") == dimensions) & inside, F.lit(False))
    held = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), scale * x.cast("double")))))
    return table.where(fits).select(F.col("vec_id").cast("long"), held.alias("v"))


def first_centroids(vectors: DataFrame, k: int = 16, seed: int = 1) -> list[list[int]]:
    """The k vectors with the least SHA-256 of seed and id (of one hash: the least vector); fewer where there are fewer rows."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def bisectors(centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """normals[i, j] and thresholds[i, j]: normal @ x - threshold is by how much x is nearer to j than to i, in squares."""
    c = np.array(centroids, np.int64)
    squares = (c * c).sum(axis=1)
    return 2 * (c[None] - c[:, None]), squares[None] - squares[:, None]


def winners(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row of x."""
    left = np.zeros(len(x), np.int64)
    for j in range(1, len(normals)):
        side = np.einsum("nd,nd->n", x, normals[left, j]) - thresholds[left, j]
        left[side > 0] = j
    return left


def _matrices(batches, column: str, d: int):
    """(slice of a batch, its vectors as rows)."""
    for b in batches:
        for i in range(0, b.num_rows, TOGETHER):
            part = b.slice(i, TOGETHER)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, list[int]]:
    """Of each centroid that won vectors, the exact sums of their components, and how many they are. A task returns a row a
    centroid; the driver sees one number a centroid and component."""
    d = len(centroids[0])

    def each(batches):
        normals, thresholds = bisectors(centroids)
        total = np.zeros((len(centroids), d + 1), np.int64)
        for _, x in _matrices(batches, "v", d):
            won = winners(x, normals, thresholds)
            order = np.argsort(won, kind="stable")
            there, at = np.unique(won[order], return_index=True)
            total[there, :d] += np.add.reduceat(x[order], at, axis=0)
            total[there, d] += np.diff([*at, len(x)])
        kept = np.flatnonzero(total[:, d])
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(list(total[kept]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = vectors.select("v").mapInArrow(each, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("at", "part"))
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out.setdefault(r["cluster"], [0] * (d + 1))[r["at"]] = int(r["total"])
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance (squared) of every row of `vectors` (vec_id, v)."""

    def each(batches):
        normals, thresholds = bisectors(centroids)
        c = np.array(centroids, np.int64)
        for b, x in _matrices(batches, "v", c.shape[1]):
            won = winners(x, normals, thresholds)
            apart = x - c[won]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(won, pa.int32()), pa.array((apart * apart).sum(axis=1), pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(each, "vec_id long, cluster int, distance long")


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> list[list[int]]:
    """Centroids after so many rounds; one without a vector stays where it is."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        sums = cluster_sums(vectors, centroids)
        centroids = [[x // sums[i][-1] for x in sums[i][:-1]] if i in sums else c for i, c in enumerate(centroids)]
    return centroids


def cluster_vectors(table: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dimensions: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors of `table` (vec_id, embedding) that
    `integer_vectors` keeps.

    Fewer vectors than k make as many centroids as there are; none give an empty result. A null id hashes like an empty
    one. An inertia beyond 64 bits is null. The table is read once a round and twice besides; between rounds only the
    centroids are kept, k times `dimensions` numbers.
    """
    vectors = integer_vectors(table, dimensions, scale)
    centroids = fit(vectors, k, rounds, seed)
    if not centroids:
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return table.sparkSession.createDataFrame([], kinds)
    rows = materialize(assigned(vectors, centroids), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by_cluster = F.array(*[long(inertia.get(i, 0)) for i in range(len(centroids))])[F.col("cluster")]
    name = F.array(*[F.lit(x) for x in names])[F.col("cluster")]
    return rows.select("vec_id", "cluster", "distance", by_cluster.alias("cluster_inertia"), long(sum(inertia.values())).alias("inertia"), name.alias("centroid_sha256"))
