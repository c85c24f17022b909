"""Exact ranks without sorting a frame, or a group, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

FAN = 4096


def sums_before(rows: DataFrame, pos: str, value: str, out: str, fan: int = FAN, below: int | None = None) -> DataFrame:
    """``rows`` plus ``out``, the sum of ``value`` over all rows of smaller
    ``pos`` (unique, from 0 on; ``below`` bounds it, if known).  Sums of ``fan``
    neighbours are summed likewise, so no task orders more than ``fan`` rows."""
    group = F.floor(F.col(pos) / F.lit(fan)).cast("long")
    before = Window.partitionBy("__group").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__group", group).withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
    if below is None:
        most = rows.agg(F.max(pos)).first()[0]
        below = 0 if most is None else most + 1
    if below <= fan:
        return inside.drop("__group")
    path = scratch_path(rows.sparkSession, "sums")
    rows.groupBy(group.alias("__g")).agg(F.sum(value).alias("__total")).write.parquet(path)
    totals = rows.sparkSession.read.parquet(path)
    earlier = sums_before(totals, "__g", "__total", "__before", fan, -(-below // fan))
    earlier = earlier.select(F.col("__g").alias("__earlier"), F.col("__before").alias("__sum"))
    joined = inside.join(earlier, F.col("__group") == F.col("__earlier"))
    return joined.withColumn(out, F.col(out) + F.col("__sum")).drop("__group", "__earlier", "__sum")


def global_positions(df: DataFrame, key, partitions: int | None = None, group=None) -> DataFrame:
    """Adds ``pos``: the 0-based rank of each row in ``key`` order (a column
    name or a list of them) over the whole frame -- or, with ``group``
    (columns), within its group; a null group is a group like any other.

    The rows are range-partitioned by (group, key), sorted within partitions
    and written once to the shared folder, so both passes below see the same
    layout, also after an executor loss.  A row's rank is its index among its
    group's rows inside the partition (``monotonically_increasing_id`` counts
    them in its low 33 bits) plus the number of rows of its group in earlier
    partitions.  Range partitioning makes a group a contiguous run of
    partitions, so a group that holds a third of all rows is spread over a
    third of the partitions.  The offsets (at most partitions + groups rows)
    are joined as a table; the optimizer sees its real size, and without a
    group they are summed ``FAN`` at a time.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [key] if isinstance(key, str) else list(key)
    groups = [] if group is None else ([group] if isinstance(group, str) else list(group))
    path = scratch_path(spark, "ranked")
    (
        df.repartitionByRange(partitions, *groups, *keys)
        .sortWithinPartitions(*groups, *keys)
        .withColumn("__id", F.monotonically_increasing_id())
        .write.mode("overwrite")
        .parquet(path)
    )
    staged = spark.read.parquet(path).withColumn("__part", F.shiftright("__id", 33))
    local = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    counts = staged.groupBy("__part", *groups).agg(F.count(F.lit(1)).alias("__n"), F.min(local).alias("__first"))
    if groups:
        before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    else:
        summed = sums_before(counts, "__part", "__n", "__off", below=partitions)
    offsets = summed.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in groups], "__first", "__off")
    match = F.col("__part") == F.col("__p")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return (
        staged.join(offsets, match)
        .withColumn("pos", F.col("__off") + local - F.col("__first"))
        .drop("__id", "__part", "__p", "__first", "__off", *[f"__g_{g}" for g in groups])
    )
