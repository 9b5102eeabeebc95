"""Ball k-means: exact Lloyd rounds that compare a member only with the centroids that can be as near as its own.

A cluster is a ball, its centroid and the distance of its farthest member. A centroid is a neighbour of the ball if it is at most twice the
radius away, as no other can be nearer to a member than the ball's own. Of the members those in the stable core, nearer to
their centroid than half the way to the nearest neighbour, stay without a comparison. The others lie in annuli: one that a neighbour can
reach (at most half the way) is compared with that neighbour and all nearer ones, no farther ones.
All is in squared distances of whole numbers, so a comparison is left out only where it can't change the result, ties included.

A round is one pass over the vectors, written with their cluster and distance to the shared folder; vectors are never shuffled or sorted. Components
and counts are summed in each task before they are merged: a row for each cluster and component comes to the driver,
whatever the number of vectors, and the centroids go to the tasks. A task takes the balls of its own batches, whose radii are no larger.

Defined results: vectors of another length than ``dims``, or with a component that is null, not finite or so large that four squared
distances don't fit a long (for 64 dimensions, over 2^18), take no part; sums of distances that don't fit one are null; rows that repeat a vector count each; a null vec_id is assigned but starts no cluster;
equal hashes (of rows that share a vec_id) are ordered by their vectors; fewer vectors than clusters give a cluster for each; an empty
table gives an empty one; columns other than ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import sliced
from corpusloom.runtime import drop, stash

CLUSTERS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
STATE = "vec_id long, v array<int>, cluster int, distance long"
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Vectors worked on at once.
BATCH = 4096


def largest(dims: int, bits: int) -> int:
    """The largest whole component of which four squared distances stay below 2^bits."""
    return math.isqrt((1 << bits) // (16 * dims)) - 1


def whole_vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part as whole numbers."""
    x = F.col("embedding")
    fine = F.coalesce((F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= largest(dims, 63) // scale)), F.lit(False))
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def starts(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The first centroids: vectors in the order of a hash of their ids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.where("vec_id IS NOT NULL").orderBy(key, "v").limit(clusters).select("v").collect()]


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, pair by pair."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def apart(centroids: np.ndarray) -> np.ndarray:
    """Squared distances between all centroids."""
    return np.stack([between(centroids, c[None, :]) for c in centroids])


def neighbours(centroids: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
    """For each ball the other centroids at most twice its radius away (all squared), nearest first."""
    far = apart(centroids)
    found = []
    for j, row in enumerate(far):
        near = np.flatnonzero(row <= 4 * radii[j])
        near = near[near != j]
        found.append(near[np.argsort(row[near], kind="stable")])
    return found


def nearest_of_all(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector, the smaller number first where equal."""
    best, cluster = between(v, centroids[0][None, :]), np.zeros(len(v), np.int64)
    for i in range(1, len(centroids)):
        d = between(v, centroids[i][None, :])
        nearer = d < best
        best[nearer], cluster[nearer] = d[nearer], i
    return cluster, best


def reassigned(v: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the cluster that each vector was in, through the balls; and how many distances to other centroids were computed."""
    own = between(v, centroids[cluster])
    radii = np.zeros(len(centroids), np.int64)
    np.maximum.at(radii, cluster, own)
    near, far = neighbours(centroids, radii), apart(centroids)
    best, result, compared = own.copy(), cluster.copy(), 0
    for j in np.unique(cluster):
        if not len(near[j]):
            continue
        members = np.flatnonzero(cluster == j)
        # The annulus of a member: how many neighbours are within twice its own distance. The core has none.
        ring = np.searchsorted(far[j][near[j]], 4 * own[members], "right")
        members = members[np.argsort(-ring, kind="stable")]
        reach = np.cumsum(np.bincount(ring, minlength=len(near[j]) + 1)[::-1])[::-1]
        for place, i in enumerate(near[j]):
            part = members[: reach[place + 1]]
            if not len(part):
                break
            d = between(v[part], centroids[i][None, :])
            better = (d < best[part]) | (d == best[part]) & (i < result[part])
            best[part[better]], result[part[better]] = d[better], i
            compared += len(part)
    return result, best, compared


def assigned(vectors: DataFrame, centroids: list[list[int]], first: bool) -> DataFrame:
    """STATE after one assignment; ``vectors`` are (vec_id, v), or STATE of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.array(centroids, np.int64)
        for batch in sliced(batches, BATCH):
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            # Doubles are exact for small numbers, and faster.
            kind = np.float64 if max(np.abs(v).max(), np.abs(center).max()) <= largest(center.shape[1], 53) else np.int64
            old = None if first else batch.column("cluster").to_numpy()
            cluster, distance = nearest_of_all(v.astype(kind), center.astype(kind)) if first else reassigned(v.astype(kind), old, center.astype(kind))[:2]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64))], names=["vec_id", "v", "cluster", "distance"])

    return vectors.mapInArrow(run, STATE)


def component_sums(state: DataFrame, clusters: int, dims: int) -> DataFrame:
    """(cluster, place, n, s): the sum of each component over a cluster, and its vectors; each task gives at most one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dims)
            n += np.bincount(cluster, minlength=clusters)
            for c in np.unique(cluster):
                s[c] += v[cluster == c].sum(0, dtype=np.int64)
        there = np.flatnonzero(n)
        columns = (np.repeat(there, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(there)), np.repeat(n[there], dims), s[there].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "place", "n", "s"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, place int, n long, s long")
    return parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def ball_kmeans(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "2") -> DataFrame:
    """SCHEMA: every vector's cluster after ``rounds`` rounds of assignment and new centroids and a last assignment."""
    vectors = whole_vectors(embeddings, dims, scale)
    centroids = starts(vectors, clusters, seed)
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    state = stash(assigned(vectors, centroids, True), "ball-kmeans")
    for _ in range(rounds):
        for row in component_sums(state, len(centroids), dims).collect():
            centroids[row["cluster"]][row["place"]] = row["s"] // row["n"]
        before = state
        state = stash(assigned(before, centroids, False), "ball-kmeans")
        drop(before)
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    whole = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = [F.element_at(F.lit(values), F.col("cluster") + 1) for values in ([inertia.get(j, 0) for j in range(len(centroids))], digests)]
    return state.select("vec_id", "cluster", "distance", of[0].cast("long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of[1].alias("centroid_sha256"))


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same in SQL, every vector against every centroid in each round."""
    parts = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), cells AS MATERIALIZED (
  SELECT r, unnest(v) AS x, unnest(range({dims})) AS i FROM kept
), c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, unnest(range({dims})) AS i
  FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {clusters})
)"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min(d * 64 + c) AS best FROM (SELECT r, c, sum((cells.x - c{n}.x) * (cells.x - c{n}.x))::BIGINT AS d FROM cells JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r
)""")
        if n < rounds:
            parts.append(f"""s{n} AS (
  SELECT best % 64 AS c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{n} JOIN cells USING (r) GROUP BY 1, 2
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, c{n}.i, CASE WHEN n IS NULL THEN c{n}.x ELSE (s - (s % n + n) % n) // n END AS x FROM c{n} LEFT JOIN s{n} USING (c, i)
)""")
    parts.append(f"""digests AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM (SELECT vec_id, best % 64 AS c, best // 64 AS d FROM a{rounds} JOIN kept USING (r)) JOIN digests USING (c)
""")
    return ",\n".join(parts[:-1]) + ", " + parts[-1]


ORACLE = _oracle()
