"""Books as line tables give what they give as whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from figcorpus.operators import longbooks as lb
from figcorpus.operators import paragraphs as pg
from figcorpus.operators import proximity as px
from figcorpus.sources import readers as rd

PIECES = [
    "", "", "", " ", "\t", "　", "plain words", "  led by blanks", "ends in blanks  ", "Figure 3 shows", "  Fig. 4 too", "see Figure 5-1 there",
    "图 2 说明", "\x1cFigure 9 behind a mark", "![](../images/000001/000007.jpg)", "![a](../images/1/x.png) ![b](../images/1/y.png)",
]


def _text(seed, n):
    rng = random.Random(seed)
    return "\n".join(rng.choice(PIECES) for _ in range(n))


@pytest.fixture(scope="module")
def books(spark):
    rows = [(f"{i:06d}", _text(i, n)) for i, n in enumerate([1, 2, 3, 7, 15, 40, 90, 400, 1500] * 3)]
    rows += [("blank", "\n \n\n"), ("none", ""), ("tag", "![](../images/1/z.png)"), ("ends", "\n\nFigure 1 a\n \n![](../images/1/z.png)\n\n")]
    return spark.createDataFrame(rows, "book_id string, text string").cache()


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize(("block", "search"), [(10_000, {}), (13, {}), (3, {"max_range": 4}), (50, {"center_offset": -1}), (64, {"max_range": 1})])
def test_blocks_give_the_whole_books_images(books, block, search):
    whole = px.image_records(books, **search)
    cut = lb.image_records(pg.explode_lines(books), block=block, **search)
    assert set(cut.columns) == set(whole.columns)
    assert whole.count() > 300 and _rows(cut) == _rows(whole)


def test_paragraphs_of_lines(books):
    whole, cut = pg.split_paragraphs(books), lb.line_paragraphs(pg.explode_lines(books))
    assert _rows(cut.select(*whole.columns)) == _rows(whole)


def test_long_book_is_spread(spark):
    n = 1_000_000
    line = F.when(F.col("id") % 10 == 4, "![](../images/1/p.png)").when(F.col("id") % 10 == 5, "Figure 1 text").when(F.col("id") % 10 == 8, "").otherwise("words")
    lines = spark.range(n).select(F.lit("b").alias("book_id"), (F.col("id") + 1).alias("line_no"), line.alias("content"))
    marks, _ = lb.line_marks(lines)
    blocks = lb.halo_blocks(marks, 10)
    sizes = blocks.select("block", F.size("marks").alias("n")).collect()
    assert len(sizes) == 100 and max(r["n"] for r in sizes) <= 2010
    found = lb.image_records(lines)
    got = found.groupBy("classification", "caption_count", "other_count").agg(F.count("*").alias("n"), F.max("para_no").alias("p")).collect()
    assert sum(r["n"] for r in got) == n // 10 and max(r["p"] for r in got) == n // 10
    # images in the middle all see the same
    assert max(r["n"] for r in got) >= n // 10 - 4


def test_lines_of_split_files(spark, tmp_path):
    wanted = set()
    for book, n in (("a", 4000), ("b", 1), ("c", 700)):
        lines = [f"{book} line {i}\r" if i % 50 == 0 else "" if i % 9 == 0 else f"{book} {i}" for i in range(1, n + 1)]
        (tmp_path / f"{book}.md").write_bytes("\n".join(lines).encode() + (b"\n" if book == "c" else b""))
        wanted |= {(book, i, x) for i, x in enumerate(lines, 1)}
    (tmp_path / "empty.md").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = rd.scan_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == len(wanted) and set(map(tuple, rows)) == wanted


def test_no_lines(spark):
    none = spark.createDataFrame([], "book_id string, line_no long, content string")
    assert lb.image_records(none).count() == 0 and lb.line_paragraphs(none).count() == 0
    nulls = spark.createDataFrame([("b", 1, None), ("b", 2, "![](../images/1/z.png)"), ("b", 3, None)], none.schema)
    assert lb.image_records(nulls).first()["classification"] == "extreme abnormal" and lb.line_paragraphs(nulls).count() == 1
