"""Dense global numbering, tops of groups and exact quantiles without pulling rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.session import checkpointed


def dense_index(
    df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order``.

    A range-partitioned sort is materialised once, so partition numbers and row numbers inside
    partitions stay fixed; only one row count per partition is combined globally.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select(
        *df.columns,
        F.shiftright("_at", 33).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(parts), F.lit(0)).alias("_offset"))
    )
    # one row per sort partition
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_row") + F.lit(start)).alias(name)
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """First ``k`` rows per group with a 0-based rank.

    Filtering on the row number lets Spark cut every group to ``k`` rows before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(w))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.col(rank).cast("long") - 1)
    )


def look_up(rows: DataFrame, few: DataFrame, key: str, item: str, names: Sequence[str]) -> DataFrame:
    """``rows`` plus the columns ``names`` of ``few``, which is unique per (key, item); nulls where it has no row.

    ``few`` has few rows per key and is folded to a map, so ``rows`` are exchanged by ``key`` alone, once for all steps by that key.
    """
    entry = F.struct(F.col(item), F.struct(*names))
    folded = few.where(F.col(item).isNotNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_few"))
    found = rows.join(folded, key, "left").withColumn("_own", F.col("_few")[F.col(item)])
    return found.select(*rows.columns, *(F.col("_own")[n].alias(n) for n in names))


def exact_quantiles(df: DataFrame, group: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """(group, q, quantile): interpolated quantiles per group, nulls of ``value`` left out.

    Distinct values are counted, range-sorted by (group, value) and written; a group may span any number of partitions.
    Row counts per (partition, group) tell which partitions hold the ranks that are asked for, and only their rows are
    counted through, one partition's share of a group at a time.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = checkpointed(
        counted.repartitionByRange("_g", "_v").sortWithinPartitions("_g", "_v").withColumn("_part", F.spark_partition_id())
    )
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition that a group touches
    shares = placed.groupBy("_g", "_part").agg(F.sum("_n").alias("_own")).withColumns(
        {"_before": F.coalesce(F.sum("_own").over(earlier), F.lit(0)), "_all": F.sum("_own").over(Window.partitionBy("_g"))}
    )
    asked = shares.select("*", F.explode(F.array(*map(F.lit, quantiles))).alias("q")).withColumn("_at", F.col("q") * (F.col("_all") - 1))
    ends = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    ranks = asked.select("_g", "_part", "_before", "_own", "q", "_at", F.explode(ends).alias("_rank")).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_own"))
    )
    there = ranks.select(F.col("_g").alias("_h"), F.col("_part").alias("_in")).distinct()
    same = F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_in"))
    upto = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    through = placed.join(there, same, "left_semi").withColumn("_upto", F.sum("_n").over(upto))
    wanted = ranks.select(F.col("_g").alias("_h"), F.col("_part").alias("_in"), "_before", "q", "_at", "_rank")
    found = through.join(wanted, same).where(
        (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_before") + F.col("_upto"))
    )
    low, high = F.min(F.col("_v").cast("double")), F.max(F.col("_v").cast("double"))
    return found.groupBy(F.col("_g").alias(group), "q").agg(
        (low + (high - low) * F.max(F.col("_at") - F.floor("_at"))).alias("quantile")
    )
