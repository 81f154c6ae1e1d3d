"""Centroid clustering with exact integer distances, and bounds that spare most vectors the scan of all centroids.

Every vector keeps a lower bound of its distance to all centroids but its own. When centroids move, the plain way
loosens that bound by the longest drift. Here each cluster is a sphere (its centroid and its farthest vector), and in
the plane through the sphere's center and a moved centroid's two places the drift counts only as far as it can bring
that centroid nearer to any vector of the sphere. A vector whose own distance stays below its bound, or below
half the gap from its centroid to the next, keeps its cluster; the others are ambiguous and scan all centroids.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.common import dropped, written
from takt.sources.runs import shared_folder

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
LARGEST = 1 << 62  # grid values are held in 64 bits; what lies beyond this counts as this
LONG = (1 << 63) - 1
IN_DOUBLES, IN_LONGS = 1 << 22, 1 << 27  # squared distances of values up to these are exact in doubles, in 64 bits (to 64 components)
SLACK = 1e-9
STATE = "vec_id long, v array<long>, cluster int, distance decimal(38,0), lower double, scans int"


def gaps(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    top = max(np.abs(v).max(initial=0), np.abs(centers).max(initial=0))
    if top <= IN_DOUBLES and v.shape[1] <= DIMENSIONS:
        x, c = v.astype(np.float64), centers.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    kind = np.int64 if top <= IN_LONGS and v.shape[1] <= DIMENSIONS else object
    x, c = v.astype(kind), centers.astype(kind)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def own_gaps(v: np.ndarray, centers: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centroid of its cluster."""
    top = max(np.abs(v).max(initial=0), np.abs(centers).max(initial=0))
    kind = np.int64 if top <= IN_LONGS and v.shape[1] <= DIMENSIONS else object
    return ((v.astype(kind) - centers.astype(kind)[cluster]) ** 2).sum(axis=1)


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[a, j]: the most by which centroid j's move brings it nearer to any vector within radius[a] of before[a].

    Seen from the middle of j's old and new place, a vector at the angle t to the move comes nearer by less than
    drift * cos(t): the places that gain more lie inside a hyperbola's branch, and that inside its asymptotes. The
    smallest angle over the sphere is its center's less arcsin(radius / distance); a sphere that
    holds the middle or touches the axis may gain the whole drift, one that lies behind gains nothing.
    """
    before, after = before.astype(np.float64), after.astype(np.float64)
    move = after - before
    drift = np.linalg.norm(move, axis=1)
    out = np.zeros((len(before), len(before)))
    for j in np.nonzero(drift > 0)[0]:
        seen = before - (before[j] + after[j]) / 2
        far = np.linalg.norm(seen, axis=1)
        outside = far > radius
        safe = np.where(outside, far, 1.0)
        angle = np.arccos(np.clip(seen @ (move[j] / drift[j]) / safe, -1, 1)) - np.arcsin(np.clip(radius / safe, 0, 1))
        out[:, j] = np.where(outside & (angle > 0), drift[j] * np.maximum(np.cos(np.minimum(angle, np.pi / 2)), 0), drift[j])
    return out * (1 + SLACK)


@dataclass(frozen=True)
class Pass:
    """What a pass over the vectors needs: centroids, and by cluster how much bounds loosen and half the gap to the next centroid."""

    centers: list[list[int]]
    loosen: list[float]
    half_gap: list[float]

    @classmethod
    def between(cls, before: list[list[int]] | None, after: list[list[int]], radius: list[float]) -> Pass:
        k = len(after)
        c = np.array(after, object)
        apart = np.sqrt(gaps(c, c).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        most = np.zeros(k)
        if before is not None:
            most = np.where(np.eye(k, dtype=bool), 0.0, loosening(np.array(before, object), c, np.array(radius))).max(axis=1)
        return cls(after, most.tolist(), (apart.min(axis=1) / 2).tolist())

    def place(self, v: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(cluster, squared distance, lower bound, scanned) of vectors, given those of the pass before."""
        centers = np.array(self.centers, object)
        n, k = len(v), len(centers)
        out_c, out_d, out_l = np.zeros(n, np.int32), np.zeros(n, object), np.full(n, np.inf)
        scan = np.ones(n, bool)
        if cluster is not None:
            own = own_gaps(v, centers, cluster)
            bound = np.maximum(lower - np.array(self.loosen)[cluster], 0)
            near = np.sqrt(own.astype(np.float64))
            limit = np.maximum(bound, np.array(self.half_gap)[cluster])
            scan = ~(near + SLACK * (1 + near) < limit * (1 - SLACK))
            out_c[:], out_d[:], out_l[:] = cluster, own, bound
        if scan.any():
            all_d = gaps(v[scan], centers)
            best = np.argmin(all_d, axis=1)  # the first of equal ones
            rows = np.arange(len(best))
            out_c[scan], out_d[scan] = best, all_d[rows, best]
            if k > 1:
                rest = all_d.astype(np.float64)
                rest[rows, best] = np.inf
                out_l[scan] = np.sqrt(rest.min(axis=1)) * (1 - SLACK)
        return out_c, out_d, out_l, scan


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with that many components, none NULL or non-finite; v holds floor(scale * x)."""
    e = F.col("embedding").cast("array<double>")
    fine = (F.size(e) == dimensions) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    grid = F.transform(e, lambda x: F.greatest(F.least(F.floor(x * scale).cast("long"), F.lit(LARGEST)), F.lit(-LARGEST)))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), grid.alias("v"))


def placed(state: DataFrame, step: Pass) -> DataFrame:
    """state after one pass: every vector's cluster, exact distance and lower bound."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            first = b.column(2).null_count > 0
            got = step.place(v, None if first else b.column(2).to_numpy(), None if first else b.column(4).to_numpy())
            scans = b.column(5).to_numpy() + got[3]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got[0], pa.int32()), pa.array([int(d) for d in got[1]], pa.decimal128(38, 0)), pa.array(got[2], pa.float64()),
                 pa.array(scans.astype(np.int32))], names=["vec_id", "v", "cluster", "distance", "lower", "scans"])

    return state.mapInArrow(run, STATE)


def summaries(state: DataFrame, dimensions: int, kind: str) -> dict[int, tuple]:
    """cluster -> (count, componentwise sums, largest and summed squared distance): one row a cluster."""
    rows = state.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("v", F.lit(i)).cast(kind)) for i in range(dimensions)]).alias("sums"),
        F.max("distance").alias("far"), F.sum("distance").alias("inertia")).collect()
    return {r["cluster"]: (r["n"], [int(x) for x in r["sums"]], int(r["far"]), int(r["inertia"])) for r in rows}


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
              folder: str | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) of every vector that is kept.

    Kept are vectors with ``dimensions`` components, none NULL or non-finite, on the grid floor(scale * x). Centroids
    start as the kept vectors with the smallest sha256 of ``1:<vec_id>`` (vectors without an id last, repeated ids by
    components); fewer vectors than clusters start as many centroids. ``rounds`` times all vectors go to the nearest
    centroid (ties: the smaller number) and centroids become floor means, empty ones stay; then all are placed once
    more. scans counts the passes that looked at all centroids for a vector. Repeated rows and ids are rows of their
    own; an empty table, or one without such a vector, gives no row. Grid values beyond 2**62 count as 2**62, and
    distances or sums too large for a long as the largest long. Labels and other columns are not read.

    The driver holds centroids and one summary row a cluster. State is written once a pass to the shared folder, and
    what the pass before wrote is removed.
    """
    spark = vectors.sparkSession
    root = folder or shared_folder(spark)
    kept = kept_vectors(vectors, dimensions, scale)
    by_hash = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(by_hash.asc_nulls_last(), "v").limit(clusters).collect()
    size = kept.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    state = kept.select("*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("decimal(38,0)").alias("distance"),
                        F.lit(None).cast("double").alias("lower"), F.lit(0).alias("scans"))
    if not first:
        long = F.lit(None).cast("long")
        return state.select("vec_id", "cluster", *[long.alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                            F.lit(None).cast("string").alias("centroid_sha256"), "scans")
    kind = "long" if size[0] * (size[1] + 1) < LONG else "decimal(38,0)"
    centers, before, radius, path, found = [list(r["v"]) for r in first], None, [0.0] * len(first), None, {}
    for number in range(rounds + 1):
        if centers != before:  # centroids that stay where they are change no vector
            now = f"{root}/pass-{number}"
            state = written(placed(state, Pass.between(before, centers, radius)), now)
            if path:
                dropped(spark, path)
            path = now
            found = summaries(state, dimensions, kind)
        before = centers
        if number < rounds:
            radius = [float(np.sqrt(float(found[c][2]))) * (1 + SLACK) if c in found else 0.0 for c in range(len(centers))]
            centers = [[s // found[c][0] for s in found[c][1]] if c in found else centers[c] for c in range(len(centers))]
    inertia = [found[c][3] if c in found else 0 for c in range(len(centers))]
    by_cluster = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return state.select("vec_id", "cluster", F.least("distance", F.lit(LONG)).cast("long").alias("distance"),
                        by_cluster([min(x, LONG) for x in inertia]).cast("long").alias("cluster_inertia"),
                        F.lit(min(sum(inertia), LONG)).cast("long").alias("inertia"),
                        F.sha2(by_cluster([",".join(map(str, c)) for c in centers]).cast("binary"), 256).alias("centroid_sha256"), "scans")


def oracle(rounds: int = ROUNDS) -> str:
    """The same rows from all distances, without bounds; scans is not part of it."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS best FROM (
  SELECT r, vec_id, x.v AS v, k, list_sum(list_transform(list_zip(x.v, c.v), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS d FROM kept x, c{r} c) GROUP BY r)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
  SELECT best.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY ALL) GROUP BY k),
c{r + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k)""")
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {CLUSTERS}),
{", ".join(steps)}
SELECT a.vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best.k"""


ORACLE = oracle()
