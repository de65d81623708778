"""Positions in a total order, without sorting a whole table or group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.session import durable

_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row of a partition in 33 bits


def _placed(df: DataFrame, order: list, group: tuple[str, ...], parts: int | None) -> DataFrame:
    """The rows range-partitioned by group and order and written once, with their partition and place in it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    return durable(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__id", 33))
        .withColumn("__row", F.col("__id").bitwiseAND(F.lit(_MASK)))
        .drop("__id")
    )


def _with_earlier(placed: DataFrame, group: tuple[str, ...], value) -> DataFrame:
    """Adds ``__before``: the sum of ``value`` over the group's rows in earlier partitions, and ``__first``, its first place in this one."""
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part", *group)
        .agg(F.sum(value).alias("__n"), F.min("__row").alias("__first"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .select(F.col("__part").alias("__p"), "__first", "__before", *[F.col(g).alias(f"__g_{g}") for g in group])
    )
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return placed.join(offsets, same).drop("__p", *[f"__g_{g}" for g in group])


def with_position(
    df: DataFrame, order: list, group: tuple[str, ...] = (), name: str = "position", parts: int | None = None
) -> DataFrame:
    """1-based position of each row in the order, per group.

    The rows are range-partitioned by group and order, so a hot group spreads over
    partitions. Each row knows its place in its partition; the rows of a group in
    earlier partitions are added from a table with one row per (partition, group).
    The partitioned rows are written once, because both sides must see the same cut.
    Order columns should make a total order.
    """
    counted = _with_earlier(_placed(df, order, group, parts), group, F.lit(1))
    return counted.withColumn(name, F.col("__before") + F.col("__row") - F.col("__first") + 1).drop(
        "__part", "__row", "__first", "__before"
    )


def with_running_sum(
    df: DataFrame, order: list, value, group: tuple[str, ...] = (), name: str = "running", parts: int | None = None
) -> DataFrame:
    """Sum of ``value`` over each row and those before it in the order, per group.

    As :func:`with_position`: a window runs inside a partition only, and what
    stands in earlier ones is added from one row per (partition, group).
    """
    placed = _placed(df.withColumn("__value", value), order, group, parts)
    inside = W.partitionBy("__part", *group).orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    summed = _with_earlier(placed, group, F.col("__value")).withColumn(name, F.col("__before") + F.sum("__value").over(inside))
    return summed.drop("__part", "__row", "__first", "__before", "__value")


def batch_ids(df: DataFrame, order: list, size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows."""
    return with_position(df, order).withColumn("batch_no", F.floor((F.col("position") - 1) / size)).drop("position")


def round_robin(df: DataFrame, order: list, n_servers: int = 25, n_shells: int = 20) -> DataFrame:
    """Deal rows in order over servers x shells; names are three digits from 1."""
    slot = F.pmod(F.col("position") - 1, F.lit(n_servers * n_shells))
    return (
        with_position(df, order)
        .withColumn("server", F.lpad((F.floor(slot / n_shells) + 1).cast("string"), 3, "0"))
        .withColumn("shell", F.lpad((slot % n_shells + 1).cast("string"), 3, "0"))
    )


def conflict_suffix(df: DataFrame, name: str, order: list, out: str = "unique_name") -> DataFrame:
    """Give repeated names ``_1``, ``_2`` ... before the extension; the first keeps its own.

    Where names of the suffixed form are there already, the numbers go on behind the
    largest of them, so no new name can meet an old one.
    """
    ext = tx.extension(name)
    stem = F.left(name, F.length(name) - F.length(ext))
    pattern = r"(?s)^(.*)_(\d{1,9})(\.[^.]*)?$"
    taken = (
        df.where(F.col(name).rlike(pattern))
        .select(
            F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 3)).alias("_base"),
            F.regexp_extract(name, pattern, 2).cast("bigint").alias("_number"),
        )
        .groupBy("_base")
        .agg(F.max("_number").alias("_number"))
    )
    ranked = with_position(df, order, (name,), "_k").join(taken, F.col(name) == F.col("_base"), "left")
    number = F.col("_k") - 1 + F.coalesce("_number", F.lit(0))
    return ranked.withColumn(
        out, F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), number.cast("string"), ext))
    ).drop("_k", "_base", "_number")
