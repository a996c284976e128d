"""Centroid clustering in exact integers, with bounds loosened by planar geometry.

Every vector carries an upper bound on the distance to its centroid and a lower bound on that to any other one. When the
centroids move, the lower bound need not give way by the whole drift: the vectors of a cluster lie in a sphere, and in the
plane of the sphere's centre and another centroid's old and new place ``a`` and ``b``, the points that come nearer by more than
``s`` lie between the branches of a hyperbola, inside the cone around ``b - a`` from the middle whose half angle has the
cosine ``s / |b - a|``. So the sphere comes nearer by at most the drift times the cosine of the smallest angle at which the cone
meets it. Vectors whose bounds do not settle the matter are compared with their own centroid, and if that is not enough
either, with all of them, in integers.

A round is one pass without a shuffle: it reads the table of the round before and writes its own, with a few rows of totals
per task beside the vectors. Totals of a round (one row per centroid and component) are all that reaches the driver, and
centroids all that reaches the tasks; a table goes when the next one is written.

Defined results: vectors that are null, of another length, or hold null or non-finite components have no row; an empty table
gives none. Fewer vectors than centroids make as many centroids as vectors. Repeated rows count as often as they
stand there, equal ids start in the order of their components; rows without an id are clustered, and start a centroid only
after all others. Components beyond +-2**27 after scaling count as that number, so that distances fit 64 bits. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shipping import ship
from tidemark.session import materialize, scratch_space

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
FURTHEST = 1 << 27
SLACK = 1e-9  # share of a bound that rounding may cost; real errors are below a thousandth of it
STATE = "vec_id long, v binary, cluster int, upper double, lower double, distance long, n long, totals array<long>"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def whole_vectors(table: DataFrame, width: int = WIDTH, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Ids and integer components of the vectors that take part."""
    x = table[vector]
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    chosen = table.where(F.coalesce((F.size(x) == width) & sound, F.lit(False)))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(FURTHEST)), F.lit(-FURTHEST)).cast("int"))
    return chosen.select(table[vec_id].cast("long").alias("vec_id"), whole.alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "x").limit(clusters).collect()
    return [list(r["x"]) for r in rows]


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most * most * v.shape[1] * 4 < 1 << 53:  # doubles hold every step exactly
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    wide = v.astype(np.int64)
    return np.stack([((wide - c) ** 2).sum(1) for c in centroids], 1)


def loosened(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much any other centroid can have come nearer to a vector of it.

    The vectors of cluster i lie within ``radius[i]`` of ``before[i]``.
    """
    k = len(before)
    most = np.zeros(k)
    for j in range(k):
        way = after[j] - before[j]
        drift = float(np.sqrt((way * way).sum()))
        if drift == 0:
            continue
        for i in range(k):
            if i == j:
                continue
            to = before[i] - (before[j] + after[j]) / 2
            far = float(np.sqrt((to * to).sum()))
            r = radius[i] * (1 + SLACK)
            nearer = drift
            if far > r:
                cos_axis = float(np.clip((to @ way) / (far * drift), -1, 1))
                sin_sphere = r / far
                cos_sphere = np.sqrt(1 - sin_sphere * sin_sphere)
                if cos_axis < cos_sphere:  # the axis does not meet the sphere
                    cosine = cos_axis * cos_sphere + np.sqrt(1 - cos_axis * cos_axis) * sin_sphere
                    nearer = drift * min(1.0, max(0.0, cosine) + 1e-6)  # square roots near 0 cost half the digits
            most[i] = max(most[i], nearer)
    return most


class Pass:
    """One round over the vectors of a task."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None, slack: np.ndarray | None, last: bool) -> None:
        self.centroids, self.moved, self.slack, self.last = centroids, moved, slack, last
        k, width = centroids.shape
        self.sums, self.n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        self.radius, self.inertia = np.zeros(k), np.zeros(k, np.int64)
        self.scanned = 0

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.scanned += len(v)
        d = squared(v, self.centroids)
        cluster = d.argmin(1)
        at = np.arange(len(v))
        upper = np.sqrt(d[at, cluster].astype(np.float64))
        rest = d.astype(np.float64)
        rest[at, cluster] = np.inf
        return cluster, upper, np.sqrt(rest.min(1))

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), np.int64)
        for c in np.unique(cluster):
            mine = cluster == c
            out[mine] = squared(v[mine], self.centroids[c : c + 1])[:, 0]
        return out

    def settle(self, v: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, ...]:
        if cluster is None:
            cluster, upper, lower = self.scan(v)
        else:
            cluster, upper, lower = cluster.copy(), upper + self.moved[cluster], lower - self.slack[cluster]
            for tighten in (True, False):
                open_ = np.flatnonzero(~(upper + SLACK * (upper + np.abs(lower)) < lower))
                if not len(open_):
                    break
                if tighten:
                    upper[open_] = np.sqrt(self.own(v[open_], cluster[open_]).astype(np.float64))
                else:
                    cluster[open_], upper[open_], lower[open_] = self.scan(v[open_])
        distance = self.own(v, cluster) if self.last else None
        for c in np.unique(cluster):
            mine = cluster == c
            self.n[c] += mine.sum()
            self.sums[c] += v[mine].sum(0, dtype=np.int64)
            self.radius[c] = max(self.radius[c], upper[mine].max())
            if self.last:
                self.inertia[c] += distance[mine].sum()
        return cluster, upper, lower, distance

    def batch(self, ids: pa.Array, v: np.ndarray, state: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        cluster, upper, lower, distance = state
        n = len(v)
        data = np.ascontiguousarray(v, "<i4")
        places = np.arange(n + 1, dtype=np.int32) * (4 * v.shape[1])
        held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(data)])
        far = pa.nulls(n, pa.int64()) if distance is None else pa.array(distance)
        columns = [ids, held, pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), far, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, COLUMNS)

    def totals(self) -> pa.RecordBatch:
        """One row per centroid with vectors in this task: number, radius, distances and sums."""
        some = np.flatnonzero(self.n)
        m = len(some)
        columns = [
            pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(some.astype(np.int32)), pa.array(self.radius[some]),
            pa.nulls(m, pa.float64()), pa.array(self.inertia[some]), pa.array(self.n[some]), pa.array(self.sums[some].tolist(), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, COLUMNS)


def _start(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pass(centroids, None, None, False)
        for b in batches:
            if len(b):
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(b), -1)
                yield held.batch(b.column(0), v, held.settle(v, None, None, None))
        yield held.totals()

    return vectors.mapInArrow(run, STATE)


def _round(table: DataFrame, centroids: np.ndarray, moved: np.ndarray, slack: np.ndarray, last: bool) -> DataFrame:
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pass(centroids, moved, slack, last)
        for b in batches:
            if len(b):
                v = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i4").reshape(-1, width)
                state = [b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
                yield held.batch(b.column(0), v, held.settle(v, *state))
        yield held.totals()

    return table.where("v is not null").select(*COLUMNS[:5]).mapInArrow(run, STATE)


def _totals(table: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]], np.ndarray, list[int]]:
    """Numbers, sums, radii and summed distances of the centroids; at most one row per centroid and component."""
    shown = table.where("n is not null").select("cluster", "n", "upper", "distance", F.posexplode("totals").alias("at", "x"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = shown.groupBy("cluster", "at").agg(exact("n"), exact("x"), exact("distance"), F.max("upper").alias("upper")).collect()
    n, sums, radius, inertia = [0] * k, [[0] * width for _ in range(k)], np.zeros(k), [0] * k
    for r in rows:
        c = r["cluster"]
        n[c], radius[c], inertia[c] = int(r["n"]), r["upper"], int(r["distance"])
        sums[c][r["at"]] = int(r["x"])
    return n, sums, radius, inertia


def cluster(
    table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Per vector its cluster, the squared distance to its final centroid, and the cluster's figures."""
    spark = table.sparkSession
    ship(spark)
    vectors = whole_vectors(table, width, scale, vec_id, vector)
    chosen = first_centroids(vectors, clusters, seed)
    if not chosen:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array(chosen, np.int64)
    k = len(centroids)
    held = ExitStack()
    try:
        state = materialize(_start(vectors, centroids), "vectors", held.enter_context(scratch_space(spark, "centroids")))
        for r in range(rounds):
            n, sums, radius, _ = _totals(state, k, width)
            after = np.array([[s // m for s in row] if m else old for row, m, old in zip(sums, n, centroids.tolist())], np.int64)
            before, after64 = centroids.astype(np.float64), after.astype(np.float64)
            moved = np.sqrt(((after64 - before) ** 2).sum(1)) * (1 + SLACK)
            step = _round(state, after, moved, loosened(before, after64, radius), r == rounds - 1)
            now = ExitStack()
            within = None if r == rounds - 1 else now.enter_context(scratch_space(spark, "centroids"))
            state, past, held = materialize(step, "vectors", within), held, now
            past.close()
            centroids = after
        _, _, _, inertia = _totals(state, k, width)
    finally:
        held.close()
    total = sum(inertia)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    figures = spark.createDataFrame(
        [(c, inertia[c], total, marks[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return state.where("v is not null").select("vec_id", "cluster", "distance").join(F.broadcast(figures), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )  # one row per centroid


def query(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rounds as SQL, one pair of common table expressions each."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM
(SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h LIMIT {clusters}))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM
(SELECT k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{r} c) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM
(SELECT m.c AS c, unnest(v) AS x, unnest(range(1, {width + 1})) AS i FROM a{r}) GROUP BY c, i)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(f.v, c.v) AS v FROM c{r} c LEFT JOIN
(SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c) f ON f.c = c.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
(sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"""


ORACLE = oracle()
