"""Sources: document trees, image listings, JSON trees, index lists."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.operators import corpus as cp
from figcorpus.operators import longbooks as lb

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")


def _ending(exts) -> str:
    return r"(?i)\.(" + "|".join(exts) + ")$"


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks a core, many folders each; by default each is a task, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scan_images(spark: SparkSession, root: str, exts=IMAGE_EXTENSIONS) -> DataFrame:
    """Path, size and ids of the images below a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = files.select("path", "length").where(F.col("path").rlike(_ending(exts)))
    return listed.withColumn("book_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn(
        "image_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    )


def load_images(spark: SparkSession, root: str, exts=IMAGE_EXTENSIONS) -> DataFrame:
    """As ``scan_images`` with the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.col("path").rlike(_ending(exts))).select("path", "length", "content")


def payload_guard(images: DataFrame, content: str = "content", max_mb: float = 10.0) -> DataFrame:
    """Size in MB, length when sent as base64, and whether that stays below the limit."""
    size = F.octet_length(content)
    encoded = F.ceil(size / 3) * 4
    return (
        images.withColumn("size_mb", size / 1048576.0)
        .withColumn("base64_length", encoded)
        .withColumn("error", F.when(F.col("base64_length") >= max_mb * 1048576, F.lit("payload too large")))
    )


def scan_json_tree(
    spark: SparkSession, root: str, schema: str, pattern: str = r"([^/]+)/([^/]+)\.json$"
) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable files) of one JSON object per file, ids taken from the path."""
    reader = (
        spark.read.schema(f"{schema}, _bad STRING")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    with _listing(spark):
        rows = reader.json(root).withColumn("path", F.col("_metadata.file_path"))
    tagged = rows.withColumn("book_id", F.regexp_extract("path", pattern, 1)).withColumn(
        "image_id", F.regexp_extract("path", pattern, 2)
    )
    good = tagged.where("_bad IS NULL").drop("_bad", "path")
    return good, tagged.where("_bad IS NOT NULL").withColumnRenamed("_bad", "raw")


def scan_json_variants(
    spark: SparkSession, root: str, pattern: str = r"([^/]+)/([^/]+)\.json$", glob: str = "*.json"
) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable files) of one JSON value per file, whatever its shape.

    No schema is asked for or inferred: ``record`` is a VARIANT, and ``operators.variants`` lists
    its leaves. Unreadable files keep their path and text, with what is wrong in ``error``.
    """
    with _listing(spark):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    tagged = files.select(
        F.regexp_extract("_metadata.file_path", pattern, 1).alias("book_id"),
        F.regexp_extract("_metadata.file_path", pattern, 2).alias("image_id"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("raw"),
        F.try_parse_json("value").alias("record"),
    )
    empty = F.trim(F.regexp_replace("raw", r"\s+", " ")) == ""
    bad = tagged.where("record IS NULL").drop("record").withColumn("error", F.when(empty, "empty file").otherwise("no JSON"))
    return tagged.where("record IS NOT NULL").drop("path", "raw"), bad


def scan_json_files(spark: SparkSession, paths: list[str] | str, schema: str | None = None) -> DataFrame:
    """Files that hold one object or a list of objects; list items become rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(paths)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(book, image) pairs of an index list ``book-image``, and the lines that are none.
    Blank lines are skipped."""
    lines = spark.read.text(path).select(F.btrim("value").alias("line")).where("line <> ''")
    parts = F.split("line", "-")
    good = lines.where(F.size(parts) == 2).select(parts[0].alias("book_id"), parts[1].alias("image_id"))
    return good, lines.where(F.size(parts) != 2)


def scan_books(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a corpus folder (markdown/, images/<book>/, pdf/) that have images."""
    docs = (
        spark.read.option("pathGlobFilter", "*.md")
        .text(f"{root}/markdown", wholetext=True)
        .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    )
    dirs = scan_images(spark, f"{root}/images").select("book_id")
    pdfs = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path")
        .where(F.col("path").rlike(r"/pdf/\d{6}\.pdf$"))
        .select(F.regexp_extract("path", r"(\d{6})\.pdf$", 1).alias("book_id"))
    )
    return cp.scan_books(docs, dirs, pdfs)


def scan_lines(spark: SparkSession, root: str, pattern: str = r"([^/]+)\.md$", glob: str = "*.md") -> DataFrame:
    """Lines of text files of any length: ``book_id`` from the path, ``line_no`` from 1, ``content``.

    Files are read in splits, so a long book is many tasks; lines are numbered over the splits in
    the order of their place in the file. A line break at a file's end ends its last line.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(root)
    rows = files.select(
        F.regexp_extract("_metadata.file_path", pattern, 1).alias("book_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        # rows of a split lie in one partition, in their order
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("content"),
    )
    return lb.number_lines(rows, ["_file", "_split", "_row"]).select("book_id", "line_no", "content")


def profile_source(df: DataFrame, key: str | None = None) -> DataFrame:
    """One sample record as JSON beside the list of fields: the record of the smallest ``key``, or any."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    first = df.limit(1) if key is None else df.orderBy(key, *[c for c in df.columns if c != key]).limit(1)
    return first.select(F.lit(fields).alias("fields"), F.to_json(F.struct("*")).alias("sample"))
