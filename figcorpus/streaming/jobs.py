"""Incremental runs with Structured Streaming.

Each job reads files as they arrive, keeps its place in a checkpoint and, with the
available-now trigger, ends once everything there has been read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Files below a folder, or a single file where ``path`` is a glob, with names that match ``glob``."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(path)
    )


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write a stream to files until its input is used up."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start(out).awaitTermination()


def curate(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run a batch operator on every arrival. A batch that is repeated after a failure
    overwrites its own folder, so no row comes twice."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def dedupe(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_results(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, however late it comes again: the state keeps every key and forgets none.

    The state holds keys only; a session whose keys outgrow memory sets the RocksDB state store.
    """
    return stream.dropDuplicates(keys)


def _latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    kept = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(kept, F.struct(*version)).alias("_v")).select(*keys, "_v.*")


def run_latest(stream: DataFrame, keys: list[str], version: list[str], out: str, checkpoint: str) -> None:
    """Keep the latest result of each key, over all runs on one checkpoint and without a time limit.

    The state holds one row a key, the largest by ``version``; a late or repeated older one
    changes nothing. Every batch writes the keys whose row it looked at to a folder of
    its own, overwritten if the batch is repeated; :func:`read_latest` reads them back.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _latest(stream, keys, version).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, out: str, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key: the latest that any batch of :func:`run_latest` wrote."""
    return _latest(spark.read.parquet(out).drop("batch"), keys, version)


def daily_bars(ticks: DataFrame, symbol: str, time: str, price: str, delay: str = "1 day", order: str | None = None) -> DataFrame:
    """Daily open, high, low, close and count; ticks of one instant are ordered by ``order``."""
    rank = F.struct(time, order) if order else F.col(time)
    return (
        ticks.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day").alias("_w"), F.col(symbol).alias("symbol"))
        .agg(
            F.min_by(price, rank).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, rank).alias("close"),
            F.count("*").cast("double").alias("vol"),
        )
        .select("symbol", F.col("_w.start").cast("date").alias("trade_date"), "open", "high", "low", "close", "vol")
    )


def error_rate(results: DataFrame, group: str, time: str, failed, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Results and failures per group and tumbling window."""
    return (
        results.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("_w"), F.col(group).alias("group"))
        .agg(F.count("*").alias("processed"), F.count_if(failed).alias("errors"))
        .select(F.col("_w.start").cast("date").alias("day"), "group", "processed", "errors")
    )
