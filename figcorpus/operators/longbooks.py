"""Books of any length from line tables: no book is one row or one task.

The array forms of ``paragraphs`` and ``proximity`` keep a document in its own row, which is
cheapest as long as it fits there. Here a book is its lines. Paragraphs are runs of lines numbered over range
partitions, and the searches around images run in blocks of lines that overlap by the search's reach. Both
forms give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import proximity as px
from figcorpus.operators.ranking import with_position, with_running_sum
from figcorpus.session import durable


def number_lines(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Line numbers from 1 within each book, for lines whose order is given by columns."""
    return with_position(rows, order, keys, "line_no")


def gap_lines(lines: DataFrame, keys: tuple[str, ...] = ("book_id",), content: str = "content") -> DataFrame:
    """Lines with ``gap_no``, the number of empty lines up to them: lines between two empty ones share it."""
    return with_running_sum(lines, ["line_no"], (F.length(content) == 0).cast("bigint"), keys, "gap_no")


def _spans(kept: DataFrame, keys: tuple[str, ...], *more) -> DataFrame:
    """Paragraphs of lines that are not blank: number, first and last line."""
    found = kept.groupBy(*keys, "gap_no").agg(
        F.min("line_no").alias("para_start"), F.max("line_no").alias("para_end"), *more
    )
    return with_position(found, ["para_start"], keys, "para_no")


def line_paragraphs(lines: DataFrame, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """As ``paragraphs.split_paragraphs``, from lines(``keys``, line_no, content): one row per paragraph.

    Only a single paragraph's lines are gathered in one value. Books without a paragraph
    have no rows. Null lines count as blank ones that part nothing.
    """
    told = durable(gap_lines(lines.select(*keys, "line_no", F.coalesce("content", F.lit(" ")).alias("content")), keys))
    spans = _spans(told.where(tx.strip("content") != ""), keys)
    # blank lines inside a paragraph belong to it, those at its ends do not
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x["content"]), "\n")
    texts = (
        told.join(spans.select(*keys, "gap_no", "para_start", "para_end"), [*keys, "gap_no"])
        .where("line_no BETWEEN para_start AND para_end")
        .groupBy(*keys, "gap_no")
        .agg(tx.strip(text).alias("content"))
    )
    return (
        spans.join(texts, [*keys, "gap_no"])
        .select(*keys, "para_no", F.col("para_start").alias("start_line"), F.col("para_end").alias("end_line"), "content")
        .withColumn("lines", F.split("content", "\n"))
    )


def line_marks(lines: DataFrame, keys: tuple[str, ...] = ("book_id",)) -> tuple[DataFrame, DataFrame]:
    """(marks, books): the lines with an image tag or a figure label beside their paragraph, and every book's number of lines.

    Of the other lines only their number and three flags are shuffled, no text.
    """
    c = F.coalesce("content", F.lit(" "))
    is_image, is_label = c.rlike(tx.IMAGE_TAG), tx.matches_caption(c)
    # as long as its text is there, a line tells whether it starts like a figure: as it stands, and stripped as a paragraph's first line
    narrow = lines.select(
        *keys,
        "line_no",
        (F.length(c) == 0).alias("is_gap"),
        (tx.strip(c) != "").alias("is_kept"),
        c.rlike(tx.FIGURE_START).alias("starts"),
        tx.lstrip(c).rlike(tx.FIGURE_START).alias("opens"),
        is_image.alias("is_image"),
        is_label.alias("is_label"),
        F.when(is_image | is_label, tx.strip(c)).alias("content"),
    )
    numbered = with_running_sum(narrow, ["line_no"], F.col("is_gap").cast("bigint"), keys, "gap_no")
    numbered = durable(numbered.where("is_kept").drop("is_gap", "is_kept"))
    spans = _spans(numbered, keys, F.min_by("opens", "line_no").alias("first_opens"))
    marks = numbered.where("is_image OR is_label").join(spans, [*keys, "gap_no"])
    starts = F.col("is_label") & (F.col("starts") | F.col("first_opens"))
    shown = marks.select(
        *keys, "line_no", "content", F.col("para_no").cast("int").alias("para_no"), "para_start", "para_end", "is_image", "is_label", starts.alias("is_start")
    )
    return shown, lines.groupBy(*keys).agg(F.max("line_no").alias("n_lines"))


def halo_blocks(marks: DataFrame, halo: int, block: int = 10_000, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Marks in blocks of ``block`` lines, each with the marks of ``halo`` lines on both sides.

    A mark goes to its own block and, near an edge, to the neighbours whose halo it lies in
    (more than one where blocks are shorter than the halo). A block's list has at most
    ``block + 2 * halo`` marks, whatever the book.
    """
    at = F.col("line_no") - 1
    first = F.greatest(F.floor((at - halo) / block), F.lit(0))
    spread = marks.withColumn("block", F.explode(F.sequence(first, F.floor((at + halo) / block))))
    values = [c for c in marks.columns if c not in keys and c != "line_no"]
    rows = spread.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("line_no", *values))).alias("marks"))
    own = lambda m: F.floor((m["line_no"] - 1) / block) == F.col("block")
    # a block without an image of its own has nothing to search around
    return rows.where(F.exists("marks", lambda m: m["is_image"] & own(m)))


def image_records(
    lines: DataFrame, keys: tuple[str, ...] = ("book_id",), block: int = 10_000, max_range: int = 5, center_offset: int = 0
) -> DataFrame:
    """As ``proximity.image_records``, from lines(``keys``, line_no, content) of books of any length.

    Blocks hold the marks of all lines that a search from inside can reach, so every
    image is settled in its own block; the halo's images are settled in theirs.
    """
    marks, books = line_marks(lines, keys)
    halo = 2 * max_range + abs(center_offset)
    blocks = halo_blocks(marks, halo, block, keys).join(books, list(keys))
    found = px.nearby(blocks, max_range, center_offset, keys=(*keys, "block"))
    return px.classify(found.where(F.floor((F.col("line_no") - 1) / block) == F.col("block")).drop("block"))
