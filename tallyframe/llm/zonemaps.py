"""Exact integer k-means over Hilbert-ordered blocks with zone maps.

Vectors become integers and are sorted along a Hilbert curve through all their components, so a run of
rows lies in a small box. Each run is one stored block with the box's corners and the sum of its rows.
The least and greatest distances from a box to the centroids leave few candidates per block; a block with
one candidate is assigned by its stored sum, the others by exact distances to their candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize

#: Scaled components beyond this could bring a squared distance out of a long's range.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Settings:
    width: int = 64
    scale: int = 1024
    clusters: int = 8
    rounds: int = 10
    seed: str = "3"
    #: Bits of each component on the curve, and vectors of a block.
    bits: int = 4
    block: int = 128


def whole(embeddings: DataFrame, settings: Settings, key: str, vector: str) -> DataFrame:
    """(vec_id, x) of the vectors that are kept: floor(scale * component) as 32-bit integers in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for value in batch.column(1):
                out.append(None)
                if not value.is_valid or len(value.values) != settings.width or value.values.null_count:
                    continue
                x = value.values.to_numpy()
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(settings.scale * x)
                if not (np.abs(scaled) <= LARGEST).all():
                    raise ArithmeticError(f"a component times {settings.scale} is beyond {LARGEST}: its distance may exceed a long")
                out[-1] = scaled.astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "x"])

    read = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>"))
    return read.mapInArrow(run, "vec_id long, x binary").where("x IS NOT NULL")


def matrix_of(column: pa.Array, width: int, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows of ``bits``-bit numbers), as rows of bytes in order.

    Each level of the grid, from coarse to fine, says in which half of each axis a cell lies; reflections
    and swaps with the first axis turn the finer levels so that the curve enters the next half where it
    left the last one. The Gray code of the halves is then the place among them.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in range(len(x)):
            upper = (x[axis] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    levels = [(x >> level) & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels).T.astype(np.uint8), axis=1)


def zone_blocks(vectors: DataFrame, settings: Settings) -> DataFrame:
    """Stored blocks along the curve: ids, rows, low and high corners, and sums.

    The curve spans the least to greatest value of each component. Rows at one place of the curve are told
    apart by their row number, so many equal vectors make many blocks in many tasks.
    """
    width, top = settings.width, (1 << settings.bits) - 1

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), width)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], names=["axis", "low", "high"]
            )

    ends = vectors.select("x").mapInArrow(extent, "axis int, low int, high int").groupBy("axis").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    corners = {r["axis"]: (r["low"], r["high"]) for r in ends.collect()}  # one row per component
    least = np.array([corners.get(i, (0, 0))[0] for i in range(width)], dtype=np.int64)
    span = np.maximum(np.array([corners.get(i, (0, 0))[1] for i in range(width)], dtype=np.int64) - least, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = (matrix_of(batch.column(1), width) - least) * top // span
            keys = hilbert_keys(cells, settings.bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=["vec_id", "x", "row", "place"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            while len(ids) >= settings.block:
                yield block(ids[: settings.block], rows[: settings.block])
                ids, rows = ids[settings.block :], rows[settings.block :]
        if ids:
            yield block(ids, rows)

    def block(ids: list, rows: list) -> pa.RecordBatch:
        data = b"".join(rows)
        x = np.frombuffer(data, dtype=np.int32).reshape(-1, width)
        made = [data, x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), x.sum(axis=0, dtype=np.int64).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), *(pa.array([m], pa.binary()) for m in made)], names=["ids", "rows", "low", "high", "sums"]
        )

    placed = materialize(
        vectors.select("vec_id", "x", F.monotonically_increasing_id().alias("row")).mapInArrow(
            place, "vec_id long, x binary, row long, place binary"
        ),
        "placed",
    )
    ordered = placed.repartitionByRange("place", "row").sortWithinPartitions("place", "row").select("vec_id", "x")
    return materialize(ordered.mapInArrow(cut, "ids array<long>, rows binary, low binary, high binary, sums binary"), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """By block and centroid, whether the centroid can be the nearest one of some point of the block's box.

    It can't if its least distance to the box is more than the greatest distance of another one; nor if it is
    further than the one that is nearest to the box's middle from every point of the box: the difference of
    the two squared distances is linear, so its least value over the box is a sum over components.
    """
    low, high, centroids = (np.asarray(a, dtype=np.float64) for a in (low, high, centroids))
    out = np.ones((len(low), len(centroids)), dtype=bool)
    to_low, to_high = low[:, None] - centroids, centroids - high[:, None]
    nearest = np.square(np.maximum(np.maximum(to_low, to_high), 0)).sum(axis=2)
    furthest = np.square(np.maximum(-to_low, -to_high)).sum(axis=2)
    # Sums of rounded squares may be off in the last places; a block is only ruled out by more than that.
    slack = 1 + 1e-9
    out &= nearest <= furthest.min(axis=1)[:, None] * slack
    middle = (low + high)[:, None] / 2 - centroids
    best = centroids[np.square(middle).sum(axis=2).argmin(axis=1)]
    apart = best[:, None] - centroids
    least = 2 * np.where(apart > 0, apart * low[:, None], apart * high[:, None]).sum(axis=2)
    offset = np.square(centroids).sum(axis=1) - np.square(best).sum(axis=1)[:, None]
    size = np.abs(2 * apart * np.maximum(np.abs(low), np.abs(high))[:, None]).sum(axis=2) + np.abs(offset)
    return out & (least + offset <= size * 1e-9)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centroid of each row and the squared distance, in exact integers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every partial sum is a whole number that a double holds
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        far = np.square(a).sum(axis=1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(axis=1)
    else:
        far = np.stack([np.square(x.astype(np.int64) - c).sum(axis=1) for c in centroids], axis=1)
    which = far.argmin(axis=1)
    return which, far[np.arange(len(x)), which].astype(np.int64)


def block_sums(zones: DataFrame, centroids: np.ndarray, settings: Settings) -> DataFrame:
    """(cluster, axis, total): sums of the vectors by nearest centroid; axis -1 counts them, axis -2 the
    vectors that no distance was computed for."""
    width, k = settings.width, len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, free = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = (matrix_of(batch.column(i), width) for i in (1, 2))
            possible = candidates(low, high, centroids)
            stored = matrix_of(batch.column(3), width, np.int64)
            for number, some in enumerate(possible):
                chosen = np.flatnonzero(some)
                data = batch.column(0)[number].as_buffer()
                n = data.size // (4 * width)
                if len(chosen) == 1:
                    sums[chosen[0]] += stored[number]
                    counts[chosen[0]] += n
                    free[chosen[0]] += n
                    continue
                x = np.frombuffer(data, dtype=np.int32).reshape(-1, width)
                which = chosen[nearest(x, centroids[chosen])[0]]
                for c in np.unique(which):
                    sums[c] += x[which == c].sum(axis=0, dtype=np.int64)
                counts += np.bincount(which, minlength=k)
        totals = np.concatenate([sums, counts[:, None], free[:, None]], axis=1)
        axes = np.append(np.arange(width), [-1, -2]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k, dtype=np.int32), width + 2)), pa.array(np.tile(axes, k)), pa.array(totals.ravel())],
            names=["cluster", "axis", "total"],
        )

    made = zones.select("rows", "low", "high", "sums").mapInArrow(run, "cluster int, axis int, total long")
    return made.groupBy("cluster", "axis").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def first_centroids(vectors: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors of least seeded hash of their id; equal ids by their components' bytes."""
    seeded = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.orderBy(seeded, "x").limit(settings.clusters).select("x").collect()
    return np.array([np.frombuffer(r["x"], dtype=np.int32) for r in rows], dtype=np.int64).reshape(-1, settings.width)


def moved(zones: DataFrame, centroids: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Centroids after one round, and the share of vectors that needed no distance. The driver sees one row
    per cluster and component."""
    of: dict[int, dict[int, int]] = {}
    for row in block_sums(zones, centroids, settings).collect():
        of.setdefault(row["cluster"], {})[row["axis"]] = int(row["total"])
    out = centroids.copy()
    for cluster, sums in of.items():
        if sums[-1]:
            out[cluster] = [sums[axis] // sums[-1] for axis in range(settings.width)]
    all_rows = sum(sums[-1] for sums in of.values())
    return out, sum(sums[-2] for sums in of.values()) / max(all_rows, 1)


def assign(zones: DataFrame, centroids: np.ndarray, settings: Settings) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width = settings.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            possible = candidates(*(matrix_of(batch.column(i), width) for i in (2, 3)), centroids)
            for number, some in enumerate(possible):
                chosen = np.flatnonzero(some)
                x = np.frombuffer(batch.column(1)[number].as_buffer(), dtype=np.int32).reshape(-1, width)
                which, far = nearest(x, centroids[chosen])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[number].values, pa.array(chosen[which].astype(np.int32)), pa.array(far)],
                    names=["vec_id", "cluster", "distance"],
                )

    return zones.select("ids", "rows", "low", "high").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    embeddings: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Kept are vectors of ``width`` components, none null or non-finite. Components become
    floor(scale * component); beyond ``LARGEST`` the job fails, as distances would leave a long's range.
    Rows that repeat an id are vectors of their own; a null id is kept and hashed as the word ``null``. Ties
    go to the smaller centroid number; empty centroids stay; with fewer vectors than ``clusters`` there are as
    many centroids as vectors. An empty table, or one without such vectors, gives an empty result. Other
    columns are not read.
    """
    vectors = materialize(whole(embeddings, settings, key, vector), "whole-vectors")
    centroids = first_centroids(vectors, settings)
    zones = zone_blocks(vectors, settings)
    for _ in range(settings.rounds):
        centroids, _ = moved(zones, centroids, settings)
    made = materialize(assign(zones, centroids, settings), "assigned")
    sums = made.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    hashes = [hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest() for c in centroids.tolist()]
    # One row per cluster.
    named = embeddings.sparkSession.createDataFrame(list(enumerate(hashes)), "cluster int, centroid_sha256 string")
    sums = sums.join(F.broadcast(named), "cluster")
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    return made.join(F.broadcast(sums), "cluster").join(F.broadcast(total), F.lit(True)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
