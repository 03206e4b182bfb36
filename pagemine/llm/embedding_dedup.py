"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one kept per group.

Vectors of one label and dimension are assigned to the nearest of k unit centroids. A link between
vectors of two cells is found in the cell of the smaller number, which vectors of the other visit as
guests: all but those that are too far from the plane between the two centroids, or from the cell's
cap (its centroid and its farthest own vector), to be near any vector of it. So every link is found
once, and nothing is approximated: centroids decide where work is done.

Equal vectors are one unit with a multiplicity, from the task that places them on. A cell that holds
more than BLOCK units is cut into blocks, and each pair of blocks is multiplied in a task of its own;
a smaller cell is one task. A vector is shuffled to its cell, and once more per block its cell has,
never once per pair of vectors. A product yields each unit's links and a spanning forest of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemine.llm.common import components, staged

#: Centroids are fitted per (label, dimension) on at most SAMPLE vectors, one for about CELL_SIZE vectors, at most MAX_CELLS.
SAMPLE, CELL_SIZE, MAX_CELLS, ROUNDS = 8192, 2048, 1024, 8
#: Units a task takes from each side, rows multiplied at once, and vectors placed at once.
BLOCK, ROWS, PART = 4096, 512, 2048
#: How close to the threshold a product is computed anew, pair by pair, and how much wider the guest test is.
NEAR = 1e-9


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of unit vectors; starts from evenly spaced rows, empty cells keep their centroid."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cells = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cells, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def cells_of(vectors: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell per unit vector, a matrix of the smaller-numbered cells each must visit as a guest, and all cosines to centroids."""
    near = vectors @ centroids.T
    own = np.argmax(near, axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0.0))[own]
    height = near[np.arange(len(vectors)), own][:, None] - near
    # sin of the link angle; a height of at most this over the plane may have a near vector behind it
    reach = np.sqrt(1 - threshold * threshold) if threshold > 0 else 1.0
    guests = height <= (reach + NEAR) * apart + NEAR
    return own, guests & (np.arange(len(centroids))[None, :] < own[:, None]), near


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, vector) that can link: labelled, with finite components that are not all zero."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), values.alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(fine & some)
    return rows.select("vec_id", "label", "vector", F.size("vector").alias("width"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as rows of doubles."""
    width = len(column[0])
    return np.asarray(column.flatten()).reshape(-1, width)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # scaled first, so that neither tiny nor huge components lose their squares
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _centroids(rows: DataFrame, groups: DataFrame, sample: int, cell_size: int, max_cells: int) -> DataFrame:
    """(label, width, centroids) per group: fitted in one task on a bounded sample of the group."""
    rate = F.least(F.lit(1.0), F.lit(sample / 2) / F.col("n"))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(groups.withColumn("rate", rate), ["label", "width"]).where(draw < F.col("rate"))

    def learn(key, table):
        # the draw keeps sample / 2 on average; more than `sample` could only be one id repeated
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")[:sample]
        vectors = _unit(_matrix(table.column("vector").combine_chunks())[order])
        k = max(1, min(max_cells, len(vectors), round(table.column("n")[0].as_py() / cell_size)))
        centroids = spherical_kmeans(vectors, k)
        return pa.table({"label": [key[0].as_py()], "width": pa.array([key[1].as_py()], pa.int32()), "centroids": pa.array([centroids.tobytes()], pa.binary())})

    return picked.groupBy("label", "width").applyInArrow(learn, "label string, width int, centroids binary")


def _packed(vector: np.ndarray) -> bytes:
    """A vector's components in as few bytes as hold them exactly."""
    short = vector.astype(np.float32)
    return (short if (short == vector).all() else vector).tobytes()


def _unpacked(column, width: int) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float32 if len(v) == 4 * width else np.float64).astype(np.float64) for v in column]).reshape(-1, width)


_PLACED = "label string, width int, digest binary, vec_id long, cell int, own boolean, near double, copies long, vector binary"


def _placer(threshold: float):
    """Places a part of a group: a row per id (cell null), and a row per distinct vector and cell that it lives in or visits."""

    def place(key, table, centroid_table):
        label, width, _ = (k.as_py() for k in key)
        ids = table.column("vec_id").to_numpy()
        matrix = _matrix(table.column("vector").combine_chunks()) if len(ids) else np.empty((0, width))
        # -0.0 and 0.0 are equal; adding zero makes them the same bytes
        packed = [_packed(v) for v in matrix + 0.0]
        pairs = sorted({(p, int(i)) for p, i in zip(packed, ids)})
        units: dict[bytes, list[int]] = {}
        for p, i in pairs:
            units.setdefault(p, []).append(i)
        vectors = list(units)
        digests = {p: hashlib.blake2b(f"{label}/{width}/".encode() + p, digest_size=16).digest() for p in vectors}
        unit = _unit(_unpacked(vectors, width)) if vectors else np.empty((0, width))
        centroids = np.frombuffer(centroid_table.column("centroids")[0].as_py()).reshape(-1, width)
        own, guests, near = cells_of(unit, centroids, threshold)
        who, where = np.nonzero(guests)
        which = np.concatenate([np.arange(len(vectors)), who]).astype(int)
        cells = np.concatenate([own, where]).astype(np.int32)
        n = len(pairs) + len(which)
        none = [None] * len(pairs)
        return pa.table(
            {
                "label": pa.array([label] * n, pa.string()),
                "width": pa.array(np.full(n, width, np.int32)),
                "digest": pa.array([digests[p] for p, _ in pairs] + [digests[vectors[i]] for i in which], pa.binary()),
                "vec_id": pa.array([i for _, i in pairs] + [units[vectors[i]][0] for i in which], pa.int64()),
                "cell": pa.array(none + cells.tolist(), pa.int32()),
                "own": pa.array(none + [at < len(vectors) for at in range(len(which))], pa.bool_()),
                "near": pa.array(none + near[which, cells].tolist(), pa.float64()),
                "copies": pa.array(none + [len(units[vectors[i]]) for i in which], pa.int64()),
                "vector": pa.array(none + [vectors[i] for i in which], pa.binary()),
            }
        )

    return place


def _multiplier(threshold: float):
    """Links of the units of two blocks of a cell, or of one: (digest, links), and edges (a, b) that join what they join."""

    def multiply(key, table):
        _, width, _, low, high = (k.as_py() for k in key)
        rows: dict[tuple[int, bytes], list] = {}
        columns = [table.column(c).to_pylist() for c in ("block", "digest", "vec_id", "own", "copies", "vector")]
        for block, digest, vec_id, own, copies, vector in zip(*columns, strict=True):
            unit = rows.setdefault((block, digest), [vec_id, own, 0, vector])
            unit[0] = min(unit[0], vec_id)
            unit[2] += copies
        names = sorted(rows)
        ids = np.array([rows[n][0] for n in names], np.int64)
        own = np.array([rows[n][1] for n in names], bool)
        copies = np.array([rows[n][2] for n in names], np.int64)
        unit = _unit(_unpacked([rows[n][3] for n in names], width))
        blocks = np.array([n[0] for n in names])
        left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        links, group = np.zeros(len(names), np.int64), np.arange(len(names))
        for at in range(0, len(left), ROWS):
            i = left[at : at + ROWS]
            cosine = unit[i] @ unit[right].T
            linked = cosine >= threshold
            for a, b in zip(*np.nonzero(np.abs(cosine - threshold) <= NEAR), strict=True):
                linked[a, b] = float(np.dot(unit[i[a]], unit[right[b]])) >= threshold
            linked &= own[i][:, None] | own[right][None, :]  # two guests meet elsewhere
            if low == high:
                linked[i[:, None] == right[None, :]] = False
            else:
                links[right] += linked.T @ copies[i]
            links[i] += linked @ copies[right]
            for a in np.flatnonzero(linked.any(axis=1)):
                met = np.unique(group[np.append(right[linked[a]], i[a])])
                if len(met) > 1:
                    group[np.isin(group, met)] = met[0]
        hit = np.flatnonzero(links)
        edges = [(int(ids[at]), int(ids[group[at]])) for at in np.flatnonzero(group != np.arange(len(group)))]
        return pa.table(
            {
                "digest": pa.array([names[h][1] for h in hit] + [None] * len(edges), pa.binary()),
                "links": pa.array([int(links[h]) for h in hit] + [None] * len(edges), pa.int64()),
                "a": pa.array([None] * len(hit) + [e[0] for e in edges], pa.int64()),
                "b": pa.array([None] * len(hit) + [e[1] for e in edges], pa.int64()),
            }
        )

    return multiply


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, cell_size: int = CELL_SIZE, max_cells: int = MAX_CELLS) -> DataFrame:
    """Per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link when their labels and dimensions are equal, labels not null, and their cosine
    in double precision is at least `threshold`. n_links counts the other vectors linked directly;
    component_id is the smallest vec_id reachable by links, itself included; kept marks it. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing. Rows that
    repeat id, label and vector are one vector; where an id has several vectors, each is compared and
    the id has the links of all. A null vec_id links with nothing, has a null component and is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = _usable(vectors)
    groups = staged(rows.groupBy("label", "width").agg(F.count("*").alias("n")), "groups")
    fitted = staged(_centroids(rows, groups, sample, cell_size, max_cells), "centroids")
    # a group's vectors are assigned PART at a time, each part with its own copy of the centroids
    parts = groups.withColumn("parts", F.ceil(F.col("n") / F.lit(PART)).cast("int")).select("label", "width", "parts")
    dealt = rows.join(parts, ["label", "width"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    copies = fitted.join(parts, ["label", "width"]).select("label", "width", "centroids", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    by = ["label", "width", "part"]
    placed = staged(dealt.groupBy(*by).cogroup(staged(copies, "copies").groupBy(*by)).applyInArrow(_placer(threshold), _PLACED), "placed")

    # a guest stays where the cell's cap, widened by the link angle, reaches it
    cell = ["label", "width", "cell"]
    caps = placed.where("own").groupBy(*cell).agg(F.min("near").alias("edge"))
    angle = lambda c: F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    near_enough = angle(F.col("near")) <= angle(F.col("edge")) + F.acos(F.lit(max(-1.0, min(1.0, threshold)))) + F.lit(1e-7)
    held = placed.where("cell is not null").join(caps, cell).where(F.col("own") | near_enough)
    sizes = held.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    held = held.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = held.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    work = pairs.select(*cell, "low", "high", "block", "digest", "vec_id", "own", "copies", "vector").groupBy(*cell, "low", "high")
    found = staged(work.applyInArrow(_multiplier(threshold), "digest binary, links long, a long, b long"), "found")

    members = placed.where("cell is null").select("vec_id", "digest")
    units = staged(members.groupBy("digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "units")
    links = found.where("digest is not null").groupBy("digest").agg(F.sum("links").alias("links"))
    known = staged(units.join(links, "digest", "left").select("digest", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "links")
    joined = staged(members.join(known, "digest"), "members")
    per_id = joined.groupBy("vec_id").agg(F.sum("links").alias("links"), F.min("first").alias("low"), F.max("first").alias("high"))
    # units joined by an id that has several vectors
    bridges = joined.join(per_id.where("low <> high").select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    labels = components(found.where("a is not null").select("a", "b").unionByName(bridges)).withColumnsRenamed({"node": "low", "component": "_component"})
    named = per_id.where("links > 0").join(labels, "low", "left").select("vec_id", "links", F.least(F.coalesce("_component", "low"), "low").alias("component"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(staged(named, "named"), "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
