"""Centroid clustering with equal-average equal-variance search.

Components become integers, floor(scale * x), so that every sum, distance and centroid is exact and no result depends on
the order of rows. Centroids start as the vectors with the smallest hash of their id; a round assigns every vector to its
nearest centroid and replaces each centroid that has vectors by the floor of their mean.

Search: centroids are sorted by the sum of their components (dims times the mean). A vector starts between the two
neighbours of its own sum and scans outwards, the nearer side first. With S the sum and V = dims * (sum of squares) - S^2,
    dims * |x - c|^2 >= (Sx - Sc)^2 + (sqrt(Vx) - sqrt(Vc))^2.
When (Sx - Sc)^2 alone exceeds dims * (best distance), no centroid further out can win and the scan ends; when both parts
exceed it, this centroid is skipped. All others get their exact integer distance. Ties go to the smaller number; the square
roots are compared with a margin above their rounding error, so nothing that ties or wins is skipped.

Each round is one scan of the table; tasks add up their own vectors, so a round shuffles at most k * dims numbers a task,
and the driver keeps k * dims numbers. No vector is shuffled: a vector that repeats in a third of all rows changes nothing.

Kept are vectors with exactly ``dims`` components, none NULL, NaN or infinite; others are left out. Components beyond
+-2^24 are set to that bound, as no long holds their squares. Repeated rows count each; a NULL id hashes like an empty one;
equal hashes are ordered by their vectors; with fewer than k vectors there are fewer centroids, and an empty table gives an
empty one. Columns other than the two named ones are left out.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import query, table

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
BOUND = 1 << 24
MOST = (1 << 63) - 1


def integers(column, dims: int, scale: int) -> np.ndarray:
    """Rows of integer components of an Arrow list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat.reshape(-1, dims) * scale), -BOUND, BOUND).astype(np.int64)


class SortedCentroids:
    """Centroids in the order of their means, with deviations, for the outward scan."""

    def __init__(self, centroids):
        points = np.array(centroids, np.int64)
        sums = points.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        self.k, self.dims = points.shape
        self.number, self.points, self.sums = order, points[order], sums[order]
        self.deviation = self.spread(self.points, self.sums)

    @staticmethod
    def spread(points, sums):
        return np.sqrt((points.shape[1] * (points * points).sum(axis=1) - sums * sums).astype(np.float64))

    def nearest(self, x: np.ndarray):
        """(number, squared distance) for each row, and how many distances were computed."""
        sums = x.sum(axis=1)
        deviation = self.spread(x, sums)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        far = 2 * self.dims * BOUND + 1
        best = np.full(len(x), self.dims * 4 * BOUND * BOUND, np.int64)
        number = np.full(len(x), self.k, np.int64)
        live, computed = np.arange(len(x)), 0
        while len(live):
            lower, upper = left[live], right[live]
            below = np.where(lower >= 0, sums[live] - self.sums[np.maximum(lower, 0)], far)
            above = np.where(upper < self.k, self.sums[np.minimum(upper, self.k - 1)] - sums[live], far)
            down = below <= above
            gap, at = np.where(down, below, above), np.where(down, lower, upper)
            left[live], right[live] = lower - down, upper + ~down
            limit = self.dims * best[live]
            near = (gap < far) & (gap * gap <= limit)  # mean inequality: nothing further out can win
            live, gap, at, limit = live[near], gap[near], at[near], limit[near]
            bound = gap.astype(np.float64) ** 2 + (deviation[live] - self.deviation[at]) ** 2
            rest = bound <= limit * (1 + 1e-9) + 1  # deviation inequality: this one cannot win
            rows, c = live[rest], at[rest]
            diff = x[rows] - self.points[c]
            distance = np.einsum("ij,ij->i", diff, diff)
            computed += len(rows)
            name = self.number[c]
            better = (distance < best[rows]) | ((distance == best[rows]) & (name < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], name[better]
        return number, best, computed


def kept_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where((F.size("v") == dims) & finite)


def first_centroids(kept: DataFrame, k: int, dims: int, scale: int, seed) -> list:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = kept.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    values = pa.array([r.v for r in chosen], pa.list_(pa.float64()))
    return integers(values, dims, scale).tolist() if chosen else []


def totals(kept: DataFrame, centroids: list, dims: int, scale: int) -> dict:
    """number -> (vectors, sum of distances, componentwise sums) over all vectors; tasks add up first."""
    search = SortedCentroids(centroids)

    def add(batches):
        n, cost, sums = np.zeros(search.k, np.int64), [0] * search.k, np.zeros((search.k, dims), np.int64)
        for batch in batches:
            x = integers(batch.column(0), dims, scale)
            number, distance, _ = search.nearest(x)
            for c in np.unique(number):
                mine = number == c
                n[c] += mine.sum()
                cost[c] += sum(distance[mine].tolist())
                sums[c] += x[mine].sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.record_batch([
            pa.array(used, pa.int32()), pa.array(n[used]), pa.array([Decimal(cost[c]) for c in used], pa.decimal128(38)),
            pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "cost", "sums"])

    parts = kept.select("v").mapInArrow(add, "cluster int, n long, cost decimal(38,0), sums array<long>")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)))
    return {r.cluster: (r.n, int(r.cost), [r[f"s{i}"] for i in range(dims)]) for r in added.collect()}


def clustered(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS,
    scale: int = SCALE, seed=SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid of every kept vector."""
    kept = kept_vectors(vectors, vec_id, embedding, dims)
    schema = (f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid array<long>")
    centroids = first_centroids(kept, k, dims, scale, seed)
    if not centroids:
        return kept.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for c, (n, _, sums) in totals(kept, centroids, dims, scale).items():
            centroids[c] = [s // n for s in sums]
    cost = {c: cost for c, (_, cost, _) in totals(kept, centroids, dims, scale).items()}
    own = np.array([min(cost.get(c, 0), MOST) for c in range(len(centroids))], np.int64)
    whole = min(sum(cost.values()), MOST)
    search = SortedCentroids(centroids)
    listed = pa.array(centroids, pa.list_(pa.int64()))

    def assign(batches):
        for batch in batches:
            number, distance, _ = search.nearest(integers(batch.column(1), dims, scale))
            yield pa.record_batch([
                batch.column(0), pa.array(number, pa.int32()), pa.array(distance), pa.array(own[number]),
                pa.array(np.full(len(number), whole, np.int64)), listed.take(pa.array(number))],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return kept.mapInArrow(assign, schema)


def _oracle() -> str:
    parts = [f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(least(greatest(floor({SCALE} * CAST(x AS DOUBLE)), -{BOUND}), {BOUND}) AS BIGINT)) AS c
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
m0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, c FROM (SELECT c, sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM v) ORDER BY h LIMIT {K})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""
d{r} AS (
  SELECT v.vec_id, v.c, m.k, CAST(list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (v.c[i] - m.c[i]) * (v.c[i] - m.c[i]))) AS BIGINT) AS d
  FROM v CROSS JOIN m{r} m),
a{r} AS (SELECT vec_id, c, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS pos FROM d{r}) WHERE pos = 1)""")
        if r < ROUNDS:
            parts.append(f"""
s{r} AS (
  SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(c) AS x, unnest(range({DIMS})) AS i FROM a{r}) GROUP BY k, i),
f{r} AS (
  SELECT k, list(CASE WHEN s % n < 0 THEN (s - (s % n) - n) // n ELSE (s - (s % n)) // n END ORDER BY i) AS c FROM s{r} GROUP BY k),
m{r + 1} AS (SELECT m.k, coalesce(f.c, m.c) AS c FROM m{r} m LEFT JOIN f{r} f ON m.k = f.k)""")
    return ",".join(parts) + f"""
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN m{ROUNDS} m ON a.k = m.k
"""


@query("op12_centroid_clustering", _oracle())
def op12(spark, sf_dir):
    """Cluster, exact distance and inertia of every embedding with 64 finite components."""
    done = clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
