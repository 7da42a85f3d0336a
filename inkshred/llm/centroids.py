"""Operator 12: k-means assignment by Exponion search (Newling and Fleuret 2016), in exact integers.

Every vector keeps an upper bound of the distance to its centroid and a lower
bound of that to any other.  A round first moves the bounds by how far the
centroids moved.  Vectors whose bounds still part them from all others keep
their centroid without a look; the rest measure their own centroid again and,
where that is not enough, scan only the centroids inside a ball around it: in
the sorted list of its neighbours, up to twice the distance plus the distance
to the nearest neighbour.  The radius counts as inside, so a centroid as near
as the present one is among those compared, and the smaller number wins.

Bounds are doubles kept wide by a relative SLACK; whatever is decided by
comparing distances is decided on exact integers.  A round is one pass: tasks
hold the centroids (k x d numbers) and the neighbour lists (k x k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table, written

SLACK = 1e-9
#: Scaled components beyond this could make a squared distance exceed 64 bits.
MOST = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, distance long, upper double, lower double"


def scaled(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: the vectors with exactly ``dims`` components, all of them finite, as integers floor(scale * x); others are left out."""
    x = F.col("x")
    v = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    kept = v.filter(x.isNotNull() & (F.size(x) == dims)).filter(~F.exists(x, bad))
    whole = F.transform(x, lambda c: F.when(F.abs(c * scale) < MOST, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} exceeds {MOST}")).cast("int")))
    return kept.select("vec_id", whole.alias("v"))


def seeds(vectors: DataFrame, k: int = 16, seed: int = 1) -> np.ndarray:
    """The first k vectors by sha256 of seed and id (equal ids: by components; a null id counts as an empty text), fewer where there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


@dataclass
class Centroids:
    """Centroids with their sorted neighbour lists and the squared distances to them; moved: how far each went in the last round."""

    at: np.ndarray
    moved: np.ndarray
    order: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        square = ((at[:, None, :] - at[None, :, :]) ** 2).sum(2)
        order = np.argsort(square, axis=1, kind="stable")
        for c, row in enumerate(order):  # itself first, also before others in the same place
            order[c] = [c, *row[row != c]]
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        return cls(at, moved, order, np.sqrt(np.take_along_axis(square, order, 1).astype(np.float64)))


def _nearest(v: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid among ``which`` (ascending), and the least squared distance to another of them."""
    square = np.stack([((v - at[c]) ** 2).sum(1) for c in which], 1)
    best = square.argmin(1)  # the first of equal ones: the smallest number
    low = np.take_along_axis(square, best[:, None], 1)[:, 0]
    np.put_along_axis(square, best[:, None], np.iinfo(np.int64).max, 1)
    return which[best], low, square.min(1)


def assign(v: np.ndarray, c: Centroids, cluster: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, squared distance (-1: not measured), upper and lower bound of every vector; without former ones all centroids are compared."""
    wide = lambda x: np.sqrt(x.astype(np.float64)) * (1 + SLACK)
    narrow = lambda x: np.sqrt(x.astype(np.float64)) * (1 - SLACK)
    if cluster is None:
        cluster, square, other = _nearest(v, c.at, np.arange(len(c.at)))
        return cluster, square, wide(square), narrow(other)
    if len(c.at) == 1:
        square = ((v - c.at[0]) ** 2).sum(1)
        return cluster, square, wide(square), lower
    most = np.argsort(-c.moved, kind="stable")[:2]
    upper = upper + c.moved[cluster]
    lower = (lower - np.where(cluster == most[0], c.moved[most[1]], c.moved[most[0]])) * (1 - SLACK)
    square = np.full(len(v), -1, np.int64)
    half = c.near[:, 1] / 2 * (1 - SLACK)
    todo = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
    square[todo] = ((v[todo] - c.at[cluster[todo]]) ** 2).sum(1)
    upper[todo] = wide(square[todo])
    todo = todo[upper[todo] >= np.maximum(lower[todo], half[cluster[todo]])]
    radius = (2 * upper[todo] + c.near[cluster[todo], 1]) * (1 + SLACK)
    for own in np.unique(cluster[todo]):
        mine = todo[cluster[todo] == own]
        reach = np.searchsorted(c.near[own], radius[cluster[todo] == own], "right")  # the radius itself is inside
        for n in np.unique(reach):
            some = mine[reach == n]
            found, low, other = _nearest(v[some], c.at, np.sort(c.order[own, :n]))
            # a centroid outside the ball is farther than radius - upper from the vector
            beyond = (c.near[own, n] - upper[some]) * (1 - SLACK) if n < len(c.at) else np.full(len(some), np.inf)
            cluster[some], square[some], upper[some] = found, low, wide(low)
            lower[some] = np.minimum(narrow(other), beyond)
    return cluster, square, upper, lower


def _pass(rows: DataFrame, c: Centroids, first: bool, last: bool) -> DataFrame:
    """The state of every vector after one round; the last one measures every distance."""
    frozen = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = frozen.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten()
            v = flat.to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            old = () if first else tuple(batch.column(x).to_numpy().copy() for x in ("cluster", "upper", "lower"))
            cluster, square, upper, lower = assign(v, cents, *old)
            if last:
                rest = square < 0
                square[rest] = ((v[rest] - cents.at[cluster[rest]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(square), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "distance", "upper", "lower"])

    return mapped(rows.select("vec_id", "v") if first else rows, run, STATE)


def moved(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """The centroids at the componentwise floor of the mean of their vectors; empty ones stay.

    The sums are one row for each cluster (k rows of d numbers), combined
    before the shuffle; all integers.
    """
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(at.shape[1])))
    out = at.copy()
    for r in sums.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(at.shape[1])]
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after ``rounds`` rounds of assigning and moving and a last assignment, and the centroids.

    distance is squared.  Vectors that are null, of another length, or with a
    null or non-finite component are left out.  Repeated rows each have their
    own; a null vec_id is kept.  Equal distances go to the smaller number.  An
    empty table gives no rows and no centroids; with fewer vectors than k
    there are as many centroids as vectors.  Scaled components of 2^27 or more
    raise an error, as distances would not fit.  The state of a round is
    written to the shared folder, so a lost executor costs one round.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors, dims, scale), "vectors")
    at = seeds(rows, k, seed)
    if not len(at):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), at.reshape(0, dims)
    cents = Centroids.of(at)
    for i in range(rounds):
        rows = written(_pass(rows, cents, i == 0, False), f"assigned{i}")
        after = moved(rows, cents.at)
        cents = Centroids.of(after, cents.at)
    return _pass(rows, cents, rounds == 0, True).select("vec_id", "cluster", "distance"), cents.at


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all embeddings, with what each and all of them sum up to."""
    state, at = clusters(table(spark, sf_dir, "embeddings"))
    state = written(state, "clustered")
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    shas = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(at.tolist())], "cluster int, numbers string").select("cluster", F.sha2("numbers", 256).alias("centroid_sha256"))
    about = sums.join(shas, "cluster").crossJoin(total)  # k rows beside one
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The same rounds unrolled, every vector against every centroid."""
    near = "SELECT r, vec_id, v, d, c FROM (SELECT r, vec_id, v, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS p FROM (SELECT x.r, x.vec_id, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x, {m} m)) WHERE p = 1"
    parts = [
        "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64)",
        "x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(v, lambda x: floor(64 * x)::BIGINT) AS v FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS w FROM x QUALIFY c < {k})",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({near.format(m=f'm{i}')})",
            f"s{i} AS (SELECT c, i, (s - (s % n + n) % n) // n AS y FROM (SELECT c, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS y, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i))",
            f"m{i + 1} AS MATERIALIZED (SELECT c, coalesce(y, w) AS w FROM m{i} LEFT JOIN (SELECT c, list(y ORDER BY i) AS y FROM s{i} GROUP BY c) USING (c))",
        ]
    parts.append(f"a AS MATERIALIZED ({near.format(m=f'm{rounds}')})")
    return f"WITH {', '.join(parts)} SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.w, ',')) AS centroid_sha256 FROM a JOIN m{rounds} m USING (c)"


SQL12 = _sql()
