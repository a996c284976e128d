"""Spreading hot keys.

A key, project or group of copies may hold a third of all rows. These helpers
keep joins and ordered totals parallel for such keys without dropping a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

ROWS_PER_TASK = 1_000_000
MAX_HOT_KEYS = 1_000
TRACKED_KEYS = 10_000
MOST_TARGETS = 100_000  # wanted ranks that may be broadcast


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Hashes of the heaviest keys and the number of slices each needs.

    One mergeable frequency sketch, no shuffle of the data. It lists at most
    ``MAX_HOT_KEYS`` hashes whatever the input size, so broadcasting it is safe;
    every key left out holds less than about a thousandth of the rows. A wrong
    estimate only changes how rows are spread, never the result.
    """
    sketch = F.expr(f"approx_top_k(__key, {MAX_HOT_KEYS}, {TRACKED_KEYS})")
    return (
        df.select(F.xxhash64(*keys).alias("__key"))
        .agg(sketch.alias("__top"))
        .select(F.explode("__top").alias("__t"))
        .select(
            F.col("__t.item").alias("__hot"),
            F.ceil(F.col("__t.count") / F.lit(rows_per_task)).cast("int").alias("__slices"),
        )
        .where("__slices > 1")
    )


def found_hot(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """The hot keys written once for several joins, or None when there are none (then joins stay plain)."""
    hot = materialize(hot_keys(df, keys, rows_per_task), "hot")
    return None if hot.isEmpty() else hot


def split_hot(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    hot: DataFrame | None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join with a ``__slice`` key that divides hot keys of ``big``.

    ``small`` has few rows per key; a hot key's rows are repeated once per slice,
    which adds at most ``rows(big) / rows_per_task`` rows per row of such a key.
    """
    if hot is None:
        return big, small, list(keys)
    hot = F.broadcast(hot)

    def tagged(side: DataFrame) -> DataFrame:
        return side.join(hot, F.xxhash64(*[side[k] for k in keys]) == F.col("__hot"), "left").drop("__hot")

    slice_of = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__slices")), F.lit(0)).cast("int")
    spread = tagged(big).withColumn("__slice", slice_of).drop("__slices")
    slices = F.sequence(F.lit(0), F.coalesce(F.col("__slices"), F.lit(1)) - 1)
    repeated = tagged(small).withColumn("__slice", F.explode(slices)).drop("__slices")
    return spread, repeated, [*keys, "__slice"]


def lookup(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    hot: DataFrame | None,
    how: str = "left",
) -> DataFrame:
    """``big`` joined to at most one row per key of ``small``, hot keys divided."""
    left, right, on = split_hot(big, small, keys, spread_by, hot)
    return left.join(right, on, how).drop("__slice")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``cum_<value>``: the inclusive running sum per key in the given order.

    A plain window would bring a whole key into one task. Here rows are range
    partitioned by key and order (a hot key spans many ranges), each range is
    summed, and the ranges before it are added: the only window over a whole key
    sees one row per range.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(slices, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges"
    )
    sums = placed.groupBy(*keys, "__range").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "__range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__before_{v}") for v in values]
    )
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, [*keys, "__range"])
        .select(
            *df.columns,
            *[(F.sum(v).over(within) + F.col(f"__before_{v}")).alias(f"cum_{v}") for v in values],
        )
    )


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: dict[str, float],
    interpolate: bool,
) -> DataFrame:
    """Exact percentiles of a BIGINT column by two-level counting.

    The built-in exact percentile keeps a group's distinct values in one task.
    Here the first level counts coarse buckets (2^20 wide) per key and finds the
    bucket of each wanted rank; the second level counts values inside those
    buckets only. Both levels are map-side combined, and a window never sees more
    than the number of buckets, or 2^20 values, of one key.
    """
    coarse = F.shiftright(F.col(value), 20)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    level1 = rows.withColumn("__b", coarse).groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    by_key = Window.partitionBy(*keys)
    up_to = by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counted = level1.select(
        *keys,
        "__b",
        (F.sum("__n").over(up_to) - F.col("__n")).alias("__from"),
        F.sum("__n").over(up_to).alias("__to"),
        F.sum("__n").over(by_key).alias("__total"),
    )
    wanted = []
    for name, p in fractions.items():
        if interpolate:
            position = (F.col("__total") - 1) * F.lit(float(p))
            ends = [(F.floor(position), 1 - (position - F.floor(position))), (F.floor(position) + 1, position - F.floor(position))]
        else:
            # Nearest rank, computed in decimals so that 0.95 * 100 is 95.
            exact = F.col("__total").cast("decimal(20,0)") * F.lit(str(p)).cast("decimal(6,5)")
            ends = [(F.greatest(F.ceil(exact) - 1, F.lit(0)), F.lit(1.0))]
        wanted += [
            F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"), weight.cast("double").alias("weight"))
            for rank, weight in ends
        ]
    targets = (
        counted.withColumn("__w", F.explode(F.array(*wanted)))
        .where("__w.rank >= __from AND __w.rank < __to AND __w.weight > 0")
        .select(*keys, "__b", "__from", F.col("__w.name").alias("__name"), F.col("__w.rank").alias("__rank"), F.col("__w.weight").alias("__weight"))
    )
    targets = materialize(targets, "ranks")
    buckets = targets.select(*keys, "__b", "__from").distinct()
    small = targets.count() <= MOST_TARGETS
    # Only rows of the few wanted buckets (one for each key and fraction) are counted by value.
    level2 = (
        rows.withColumn("__b", coarse)
        .join(F.broadcast(buckets) if small else buckets, [*keys, "__b"])
        .groupBy(*keys, "__b", "__from", value)
        .agg(F.count("*").alias("__n"))
    )
    upto2 = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = level2.select(
        *keys, "__b", value,
        (F.col("__from") + F.sum("__n").over(upto2) - F.col("__n")).alias("__lo"),
        (F.col("__from") + F.sum("__n").over(upto2)).alias("__hi"),
    )
    hit = placed.join(targets.drop("__from"), [*keys, "__b"]).where("__rank >= __lo AND __rank < __hi")
    return hit.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("__name") == n, F.col(value) * F.col("__weight"))).alias(n) for n in fractions
        ]
    )
