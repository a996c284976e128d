"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 lattice points.

Each of ``TABLES`` tables projects a unit vector onto 8 random directions and decodes the result to the nearest point of the E8
lattice, its home cell; it also probes the ``PROBES`` neighbouring cells that lie nearest. Two vectors meet where one's home
is the other's home or probe. A pair at the limit of cosine 0.98 meets in one table with probability 0.9, in some table with
0.9999; closer pairs more often. Every pair that meets is verified by cosine in double precision.

Equal vectors are one vector with a count from the start. Cells without company are dropped before any vector moves. A full
cell is cut into tiles of bounded size; a tile compares its vectors as matrices and returns, for each vector, how many it links to,
and no more links than connect them. A pair that meets several times counts at its first meeting only, which both can tell from their cells.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label or id, link with
nothing; vectors of different lengths never link; rows that repeat a vector link with one another; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.hashing import mixed
from tidemark.llm.shipping import ship
from tidemark.llm.vectors import comparable, matrix, runs
from tidemark.session import materialize

TABLES, PROBES, CELL = 4, 4, 1.1
TILE = 1024
LIMIT = 0.98


def shortest() -> np.ndarray:
    """The 240 shortest vectors of the E8 lattice."""
    units = np.eye(8)
    whole = [s * units[i] + t * units[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    halves = np.array([[(m >> k & 1) - 0.5 for k in range(8)] for m in range(256)])
    return np.vstack([np.array(whole), halves[(halves < 0).sum(1) % 2 == 0]])


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    odd = near.sum(1) % 2 != 0
    off = x - near
    worst, every = np.abs(off).argmax(1), np.arange(len(x))
    other = near.copy()
    other[every, worst] += np.where(off[every, worst] >= 0, 1, -1)
    return np.where(odd[:, None], other, near)


def decoded(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, which is the even points and their translate by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


class Lattice:
    """Cells of vectors of one length."""

    def __init__(self, width: int) -> None:
        source = np.random.default_rng([width, 8, 240])
        self.tables = [(source.normal(size=(width, 8)) / CELL, source.random(8)) for _ in range(TABLES)]
        self.steps = shortest()
        self.code = source.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Home and probes in each table: vectors x TABLES x (1 + PROBES), as 64-bit numbers."""
        out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
        for t, (directions, shift) in enumerate(self.tables):
            x = unit @ directions + shift
            home = decoded(x)
            pull = (x - home) @ self.steps.T
            best = np.argsort(-pull, 1, kind="stable")[:, :PROBES]
            points = np.concatenate([home[:, None, :], home[:, None, :] + self.steps[best]], 1)
            code = ((2 * points).astype(np.int64).astype(np.uint64) * self.code).sum(2, dtype=np.uint64)
            out[:, t] = mixed(code, 17 * t + unit.shape[1]).view(np.int64)
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # very large and very small components
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[int, Lattice] = {}
    for batch in batches:
        widths = np.array([len(v) for v in batch.column("vector")])
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            cells = made.setdefault(int(width), Lattice(int(width))).cells(unit_rows(matrix(part.column("vector"))))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * cells[0].size, pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("rep"), flat], ["rep", "cells"])


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of these links, enough to connect what they connect."""
    parent: dict[int, int] = {}
    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = x, y
        while (n := parent.get(p, p)) != p:
            parent[p] = p = parent.get(n, n)
        while (n := parent.get(q, q)) != q:
            parent[q] = q = parent.get(n, n)
        if p != q:
            parent[p] = q
            kept.append((x, y))
    return kept


def _compared(limit: float):
    """Links within tiles: (rep, other or null, links)."""

    def tile(cell: int, base: pa.Table, members: pa.Table) -> Iterator[pa.RecordBatch]:
        sides = []
        for side in (base, members):
            side = side.combine_chunks()
            cells = side["cells"].chunk(0).flatten().to_numpy().reshape(len(side), TABLES, 1 + PROBES)
            sides.append((side["rep"].to_numpy(), side["n"].to_numpy(), unit_rows(matrix(side["vector"].chunk(0))), cells))
        (rx, nx, ux, cx), (ry, ny, uy, cy) = sides
        counts, links = {}, []
        for at in range(0, len(rx), 128):
            x, y = np.nonzero(ux[at : at + 128] @ uy.T >= limit - 1e-9)
            x = x + at
            keep = (rx[x] != ry[y]) & ((ux[x] * uy[y]).sum(1) >= limit)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            low = rx[x] < ry[y]
            here = 2 * (cx[x, :, 0] == cell).argmax(1) + ~low
            by_x = (cx[x, :, 0][:, :, None] == cy[y]).any(2)  # meetings in the home of x
            by_y = (cy[y, :, 0][:, :, None] == cx[x]).any(2)
            of_low, of_high = np.where(low[:, None], by_x, by_y), np.where(low[:, None], by_y, by_x)
            first = np.stack([of_low, of_high], 2).reshape(len(x), -1).argmax(1)
            x, y = x[first == here], y[first == here]
            for r, n in ((rx[x], ny[y]), (ry[y], nx[x])):
                rows, place = np.unique(r, return_inverse=True)
                for k, v in zip(rows.tolist(), np.bincount(place, n).astype(np.int64).tolist() if len(rows) else []):
                    counts[k] = counts.get(k, 0) + v
            links += _spanning(rx[x], ry[y])
        if counts:
            links = _spanning(*np.array(links, np.int64).T)
            a, b = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([list(counts), a]).astype(np.int64)), pa.array([None] * len(counts) + b.tolist(), pa.int64()), pa.array([*counts.values(), *[0] * len(a)], pa.int64())],
                ["rep", "other", "links"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["label", "cell", "i", "j"]):
            is_base = table["base"].to_numpy()
            base, members = table.filter(pa.array(is_base)), table.filter(pa.array(~is_base))
            if len(base) and len(members):
                widths = np.array([len(v) for c in members["vector"].chunks for v in c])
                width = len(base["vector"][0])  # a cell's number depends on the length
                yield from tile(table["cell"][0].as_py(), base, members.filter(pa.array(widths == width)))

    return run


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. Only vectors with equal labels are compared."""
    ship(vectors.sparkSession)
    rows = vectors.select(
        vectors[vec_id].cast("long").alias("vec_id"), vectors[label].alias("label"), vectors[vector].alias("vector"),
        (comparable(vectors[vector]) & vectors[label].isNotNull() & vectors[vec_id].isNotNull()).alias("fit"),
    )
    fit = rows.where("fit")
    distinct = fit.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    reps = materialize(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    coded = materialize(reps.select("rep", "vector").mapInArrow(_coded, "rep long, cells array<long>"), "cells")

    spread = coded.join(reps.select("rep", "label"), "rep").select("rep", "label", F.posexplode("cells").alias("place", "cell"))
    spread = materialize(spread.select("rep", "label", "cell", (F.col("place") % (1 + PROBES) == 0).alias("home")), "spread")
    full = spread.groupBy("label", "cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    size = F.lit(float(TILE))
    full = full.where("homes > 0 AND all > 1").select("label", "cell", F.ceil(F.col("homes") / size).cast("int").alias("is"), F.ceil(F.col("all") / size).cast("int").alias("js"))
    active = spread.join(full, ["label", "cell"])
    part = F.xxhash64("rep")
    base = active.where("home").select("rep", "label", "cell", F.lit(True).alias("base"), F.pmod(part, F.col("is")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"))
    members = active.select("rep", "label", "cell", F.lit(False).alias("base"), F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), F.pmod(part, F.col("js")).cast("int").alias("j"))
    tiles = base.union(members).join(reps.select("rep", "vector", "n").join(coded, "rep"), "rep")
    order = ["label", "cell", "i", "j"]
    compared = tiles.repartition(*order).sortWithinPartitions(*order).select(*order, "rep", "base", "vector", "n", "cells")
    found = materialize(compared.mapInArrow(_compared(limit), "rep long, other long, links long"), "links")

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    placed = reps.join(linked, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("label", "vector", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    placed = materialize(placed, "placed")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(least, "component").select("label", "vector", "links", "component_id")
    out = fit.join(placed, ["label", "vector"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE fit AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {LIMIT}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least AS component_id, e.vec_id = least AS kept FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
