"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.session import checkpoint_dir, durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result for DuckDB."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """crc32 of a key written as text, modulo the number of folds; a null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A function of one Arrow batch, as mapInArrow wants it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return run


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null reads as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, for the edges (a, b) of one chunk."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's smallest node.

    Alternates large stars (a node's larger neighbours move to its smallest one)
    and small stars (its smaller ones do), which needs a logarithmic number of
    rounds. A round is an aggregate and a join; nothing is collected, and each
    round is written to the checkpoint folder.
    """
    edges = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == known:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(moved.union(least.select("a", F.col("m").alias("b"))).distinct())



__all__ = [
    "ORACLES", "QUERIES", "WORD", "checkpoint_dir", "components", "durable", "fold_of", "local_components", "per_batch",
    "query", "table", "text_buffer", "texts",
]
