"""Centroid clustering: integer vectors, and nearest centroids by a tournament of bisector signs.

x is nearer to centroid j than to i where 2 (c_j - c_i) . x > |c_j|^2 - |c_i|^2. These normals and
thresholds are integers and are computed once per pair of centroids and round; per vector k - 1
of the tests, one for each challenger of the centroid standing so far, eliminate all losers. A sign
of zero favours the smaller number. Only the winner's distance is computed.

Every round is one pass over the staged integers: tasks assign their vectors and send a count and
a sum per cluster and component, added up with partial sums; the driver holds k centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import staged

K, WIDTH, ROUNDS, SEED, SCALE = 40, 64, 5, "2", 256
RESULT = (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))
BATCH = 4096


def narrow(width: int) -> int:
    """Components up to this size keep all products and sums in 64 bits; larger ones use Python's integers."""
    return 1 << ((60 - (width - 1).bit_length()) // 2)


class Tournament:
    """Nearest centroids of integer vectors: normals and thresholds of all pairs, then k - 1 signs a vector."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(x) > narrow(len(row)) for row in centroids for x in row)
        self.exact = np.array(centroids, object).reshape(len(centroids), -1)
        self.centroids = self.exact if wide else self.exact.astype(np.int64)
        squares = (self.centroids * self.centroids).sum(axis=1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, the smaller of equals, and the squared distance."""
        standing = np.zeros(len(vectors), np.int64)
        narrow = vectors.dtype != object and self.centroids.dtype != object
        normals, vectors = (self.normals, vectors) if narrow else (self.normals.astype(object), vectors.astype(object))
        for challenger in range(1, len(self.centroids)):
            normal = normals[standing, challenger]
            side = np.einsum("ij,ij->i", normal, vectors) if narrow else (normal * vectors).sum(axis=1)
            standing[(side > self.thresholds[standing, challenger]).astype(bool)] = challenger
        apart = vectors - (self.centroids if narrow else self.exact)[standing]
        return standing, (apart * apart).sum(axis=1)


def _usable(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, x) of the rows with `width` finite components, as doubles."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("x"))
    return rows.where((F.size("x") == width) & fine).select("vec_id", "x")


def _quantised(rows: DataFrame, width: int, scale: int) -> DataFrame:
    """The components as integers: in `vector`, or, where one is not narrow, in decimal in `large`."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = np.asarray(part.column("x").flatten()).reshape(-1, width)
                scaled = np.floor(x * scale)
                wide = ~(np.abs(scaled) <= narrow(width)).all(axis=1)
                small = np.where(wide[:, None], 0, scaled).astype(np.int32)
                offsets = pa.array(np.arange(0, small.size + 1, width, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        pa.ListArray.from_arrays(offsets, pa.array(small.ravel()), mask=pa.array(wide)),
                        pa.array([[str(_floor(float(c), scale)) for c in x[i]] if w else None for i, w in enumerate(wide)], pa.list_(pa.string())),
                    ],
                    names=["vec_id", "vector", "large"],
                )

    return rows.mapInArrow(run, "vec_id long, vector array<int>, large array<string>")


def _floor(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def _rows(batch: pa.RecordBatch, width: int):
    """(rows, matrix) of the narrow and of the wide vectors of a batch."""
    for name in ("vector", "large"):
        column = batch.column(batch.schema.get_field_index(name))
        rows = np.flatnonzero(np.asarray(column.is_valid()))
        if len(rows):
            flat = column.take(pa.array(rows)).flatten()
            if name == "vector":
                yield rows, np.asarray(flat).astype(np.int64).reshape(-1, width)
            else:
                yield rows, np.array([int(c) for c in flat.to_pylist()], object).reshape(-1, width)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    order = [digest, F.col("vector"), F.col("large")]
    rows = vectors.orderBy(*order).limit(k).toArrow().to_pylist()
    return [[int(c) for c in row["vector"] or row["large"]] for row in rows]


def _moved(vectors: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """Each centroid as the floor of its vectors' mean; without vectors it stays."""

    def run(batches):
        tournament, k = Tournament(centroids), len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for _, matrix in _rows(batch.slice(at, BATCH), width):
                    near, _ = tournament.nearest(matrix)
                    order = np.argsort(near, kind="stable")
                    met, starts = np.unique(near[order], return_index=True)
                    sums[met] += np.add.reduceat(matrix[order], starts, axis=0)
                    counts += np.bincount(near, minlength=k)
        for cluster in np.flatnonzero(counts):
            total = [int(counts[cluster]), *map(int, sums[cluster])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(cluster)] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(map(str, total)))],
                names=["cluster", "place", "total"],
            )

    parts = vectors.mapInArrow(run, "cluster int, place int, total string")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toArrow().to_pylist()
    found = {(row["cluster"], row["place"]): int(row["total"]) for row in sums}
    return [
        [found[at, place + 1] // found[at, 0] for place in range(width)] if (at, 0) in found else centroid
        for at, centroid in enumerate(centroids)
    ]


def clusters(vectors: DataFrame, k: int = K, width: int = WIDTH, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> DataFrame:
    """Per vector of vectors(vec_id, embedding) with `width` finite components: vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x), x as double. Centroids start as the k vectors with the
    smallest sha256 of `seed:vec_id`; `rounds` times every vector goes to the nearest (squared
    distance, the smaller number of equals) and every centroid with vectors to the exact floor of
    their mean; then vectors are assigned once more. Other vectors (null, of another length, with
    null or non-finite components) are left out. With fewer than k vectors there are as many
    centroids. Repeated rows each count; rows with one id and different vectors start in the order
    of their components; a null id hashes as `null`. Distances and sums beyond 64 bits are null;
    components must stay below 10^30. Other columns are ignored; an empty table gives an empty result.
    """
    rows = staged(_quantised(_usable(vectors, width), width, scale), "integers")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in RESULT))
    for _ in range(rounds):
        centroids = _moved(rows, centroids, width)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches):
        tournament = Tournament(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                cluster, distance = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows, object)
                for which, matrix in _rows(part, width):
                    cluster[which], distance[which] = tournament.nearest(matrix)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        pa.array(cluster),
                        pa.array([int(d) if d < 1 << 63 else None for d in distance], pa.int64()),
                        pa.array([digests[c] for c in cluster], pa.string()),
                    ],
                    names=["vec_id", "cluster", "distance", "centroid_sha256"],
                )

    found = staged(rows.mapInArrow(assign, "vec_id long, cluster int, distance long, centroid_sha256 string"), "assigned")
    # one row per cluster, k at most
    sums = found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"), F.count("distance").alias("known")
    )
    totals = {row["cluster"]: int(row["total"]) if row["n"] == row["known"] else None for row in sums.toArrow().to_pylist()}
    whole = None if None in totals.values() else sum(totals.values())
    inertias = [(cluster, _long(total), _long(whole)) for cluster, total in totals.items()]
    inertias = vectors.sparkSession.createDataFrame(inertias, "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(inertias), "cluster").select("vec_id", *(name for name, _ in RESULT))


def _long(total: int | None) -> int | None:
    return total if total is not None and total < 1 << 63 else None
