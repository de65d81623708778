"""Sinks: partitioned records, tables, index lists, reports, error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import screening as sc
from figcorpus.session import durable


def write_partitioned(df: DataFrame, path: str, keys: list[str], fmt: str = "json", mode: str = "overwrite", salts: int = 8) -> None:
    """One folder per key. ``salts`` lets that many tasks write the folder of a hot key.

    With ``overwrite`` only the folders of keys in ``df`` are replaced, so a
    resumed run keeps what earlier ones wrote.
    """
    spread = [F.col(k) for k in keys]
    if salts > 1:
        others = [c for c in df.columns if c not in keys]
        spread.append(F.pmod(F.xxhash64(*others), F.lit(salts)))
    writer = df.repartition(*spread).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).format(fmt).save(path)


def write_tree(df: DataFrame, path: str, keys: list[str], fmt: str = "json") -> None:
    """One file per combination of ``keys``, in a new folder, for trees of very many small files.

    A file costs much more than its rows, so combinations are dealt over four tasks a core, which are
    not merged by size.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    df.repartition(parts, *keys).write.partitionBy(*keys).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, path: str, line: Column, mode: str = "overwrite") -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_index(df: DataFrame, path: str, book: str = "book_id", image: str = "image_id") -> None:
    """Index list of ``book-image`` lines."""
    write_text(df, path, tx.index_key(book, image))


def write_report(histogram: DataFrame, path: str, title: str) -> None:
    """Readable lines of a histogram."""
    line = F.format_string(title + " %s: %d entries (%.2f%%)", F.col("value").cast("string"), F.col("n"), F.col("pct"))
    write_text(histogram, path, line)


def write_with_errors(df: DataFrame, failed: Column, good_path: str, error_path: str, fmt: str = "parquet") -> None:
    """Good rows replace the output, failed rows are added to the error table.

    The rows are computed once, so a model behind them is asked once and no row
    can land in both tables.
    """
    good, bad = sc.quarantine(durable(df), failed)
    good.write.mode("overwrite").format(fmt).save(good_path)
    bad.write.mode("append").format(fmt).save(error_path)
