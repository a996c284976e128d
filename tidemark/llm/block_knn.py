"""Nearest neighbours by a blocked matrix join over int8 tiles.

Candidates are packed into tiles with their int8 codes (one scale per vector) and the exact norm of what the codes leave out.
A product of int8 tiles gives every squared distance within a known bound; only candidates whose lower bound does not
exceed the upper bound of the k-th best so far are computed again from the original numbers in double precision. A task keeps one
bounded heap per query over all its tiles; the heaps of all tasks are merged at the end. The result is exact.

Queries are cut into groups of ``GROUP`` and candidates into ``slices``; every pair of group and slice is an equi-join key, so
no side is broadcast and a task holds one group and one tile. Within a tile a vector that occurs again and again stands for at
most k + 1 of its smallest ids, which is all that any query can return.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part; only
vectors of a query's length are candidates; rows that repeat an id and vector count once; rows with the query's own id never
do; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shipping import ship
from tidemark.llm.vectors import comparable, matrix
from tidemark.session import materialize

TILE, GROUP, NEAREST = 2048, 4096, 10
PACKED = "width int, n int, ids binary, vectors binary, codes binary, scales binary, rests binary"


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector, and the norm of the difference."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def _packed(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    codes, scale, rest = coded(x)
    values = [x.shape[1], len(x), ids.astype("<i8").tobytes(), x.astype("<f8").tobytes(), codes.tobytes(), scale.tobytes(), rest.tobytes()]
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < 2 else pa.binary()) for i, v in enumerate(values)], names)


def _tiles(size: int, most: int | None):
    """Pack rows (id, vector) of each length; with ``most``, at most so many ids of equal vectors in a tile."""

    def close(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order] + 0.0  # no negative zeros
        if most:
            _, group = np.unique(np.ascontiguousarray(x).view([("", np.void, 8 * x.shape[1])]).ravel(), return_inverse=True)
            place = np.lexsort((ids, group))
            again = np.zeros(len(ids), bool)
            again[1:] = (group[place][1:] == group[place][:-1]) & (ids[place][1:] == ids[place][:-1])
            place = place[~again]
            begins = np.maximum.accumulate(np.where(np.append(True, group[place][1:] != group[place][:-1]), np.arange(len(place)), 0))
            keep = np.sort(place[np.arange(len(place)) - begins < most])
            ids, x = ids[keep], x[keep]
        return _packed(ids, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(1)])
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                ids, x = part.column(0).to_numpy(), matrix(part.column(1))
                for at in range(0, len(ids), size):
                    mine = held.setdefault(width, [])
                    mine.append((ids[at : at + size], x[at : at + size]))
                    if sum(len(p[0]) for p in mine) >= size:
                        yield close(held.pop(width))
        for parts in held.values():
            yield close(parts)

    return run


class _Side:
    def __init__(self, row: dict, prefix: str) -> None:
        n, width = row[prefix + "n"], row[prefix + "width"]
        self.ids = np.frombuffer(row[prefix + "ids"], "<i8")
        self.x = np.frombuffer(row[prefix + "vectors"], "<f8").reshape(n, width)
        self.codes = np.frombuffer(row[prefix + "codes"], np.int8).reshape(n, width)
        self.scale, self.rest = (np.frombuffer(row[prefix + k], np.float64) for k in ("scales", "rests"))
        self.norm = np.linalg.norm(self.x, axis=1)
        self.near = self.norm + self.rest  # no less than the norm of the coded vector


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 tiles: partial sums of up to 1024 terms are whole numbers below 2**24, exact in single precision."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        total += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return total


def _searched(k: int):
    def offer(q: _Side, c: _Side, heaps: dict[int, list]) -> None:
        for at in range(0, len(q.ids), 256):
            rows = slice(at, at + 256)
            inner = _products(q.codes[rows], c.codes) * q.scale[rows, None] * c.scale[None]
            square = q.norm[rows, None] ** 2 + c.norm[None] ** 2
            middle = square - 2 * inner
            bound = 2 * (q.near[rows, None] * c.rest[None] + q.rest[rows, None] * c.near[None]) + 1e-9 * square
            own = q.ids[rows, None] == c.ids[None]
            upper, lower = np.where(own, np.inf, middle + bound), np.where(own, np.inf, middle - bound)
            best = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
            for i, query in enumerate(q.ids[rows].tolist()):
                heap = heaps.setdefault(query, [])
                kept = best[i] if len(heap) < k else min(best[i], (heap[0][0] ** 2) * (1 + 1e-9))
                near = np.flatnonzero((lower[i] <= kept) & ~own[i])
                away = c.x[near] - q.x[at + i]
                distance = np.sqrt(np.cumsum(away * away, 1)[:, -1])  # added up in order, as SQL does
                for d, v in zip(distance.tolist(), c.ids[near].tolist()):
                    entry = (-d, -v)
                    if len(heap) < k:
                        if entry not in heap:
                            heapq.heappush(heap, entry)
                    elif entry > heap[0] and entry not in heap:
                        heapq.heapreplace(heap, entry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[int, list]] = {}
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                offer(_Side(row, "q_"), _Side(row, "c_"), groups.setdefault(row["part"], {}))
        for heaps in groups.values():
            found = [(q, -v, -d) for q, heap in heaps.items() for d, v in heap]
            if found:
                q, v, d = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k candidates at the smallest Euclidean distance from each query: query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    ship(spark)

    def packed(df: DataFrame, size: int, most: int | None, label: str) -> DataFrame:
        rows = df.where(comparable(df[vector]) & df[vec_id].isNotNull()).select(df[vec_id].cast("long").alias("id"), df[vector].alias("vector"))
        return materialize(rows.mapInArrow(_tiles(size, most), PACKED), label)

    few = queries.where(comparable(queries[vector]) & queries[vec_id].isNotNull())
    asked = few.select(few[vec_id].alias(vec_id), few[vector].alias(vector)).repartition(max(1, -(-few.count() // GROUP)))
    asked, tiles = packed(asked, GROUP, None, "queries"), packed(candidates, TILE, k + 1, "tiles")
    parts = asked.count()
    slices = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles.count()))
    numbered = asked.withColumn("part", F.monotonically_increasing_id())
    part_of = {r["part"]: i for i, r in enumerate(numbered.select("part").collect())}  # one number per group of queries
    if not part_of:
        part_of = {-1: 0}
    dense = F.element_at(F.create_map(*[F.lit(x) for pair in part_of.items() for x in pair]), F.col("part")).cast("int")
    left = materialize(numbered.withColumn("part", dense), "groups")
    left = left.select("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.col("width"), *[F.col(c).alias(f"q_{c}") for c in asked.columns])
    every = F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1))).alias("part")
    right = tiles.select(every, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int").alias("slice"), F.col("width"), *[F.col(c).alias(f"c_{c}") for c in tiles.columns])
    met = left.hint("merge").join(right, ["part", "slice", "width"])
    best = met.mapInArrow(_searched(k), "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)


ORACLE = """
WITH fit AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
far AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM fit q JOIN fit c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, nth::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS nth FROM far) WHERE nth <= 10
"""
