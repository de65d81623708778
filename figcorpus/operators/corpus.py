"""Corpus upkeep: page plans, links, complete books, parts, splits, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import paragraphs as pg
from figcorpus.operators.ranking import with_position

# fixed values
REPORT_PREFIXES = ["/aboutboc/bi1/"] + [f"./{year}" for year in range(2008, 2026)]
PART_JOIN = "\n\n---\n\n"
PART_NAME = r"^(.*)_part_(\d+)$"


def page_plan(sources: DataFrame, total: str, page_size: int, base: str | None = None) -> DataFrame:
    """Offsets 0, n, 2n ... below each source's total; with ``base`` also the page's address."""
    starts = F.when(F.col(total) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(total).cast("bigint") - 1, F.lit(page_size).cast("bigint")))
    pages = sources.select("*", F.posexplode(starts).alias("page_no", "offset"))
    if base is None:
        return pages
    root = F.col(base)
    return pages.withColumn(
        "page_url",
        F.when(F.col("page_no") == 0, root).otherwise(
            F.concat(root, F.lit("/index_"), F.col("page_no").cast("string"), F.lit(".html"))
        ),
    )


def extract_links(pages: DataFrame, html: str, base: str, keep: Column | None = None, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Title and absolute address of the anchors of list items.

    ``keep`` is a condition on the raw ``href``, such as ``pdf_links()`` or ``report_links()``.
    """
    anchor = r'(?is)<li[^>]*>\s*(<a\s[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>)'
    found = pages.where(F.col(html).rlike(r"(?i)<li")).select(
        *keys, F.col(base).alias("_base"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1))).alias("_pos", "_a")
    )
    links = found.select(
        *keys,
        (F.col("_pos") + 1).alias("link_no"),
        "_base",
        F.regexp_extract("_a", r'(?is)href\s*=\s*"([^"]*)"', 1).alias("href"),
        tx.strip(F.regexp_replace(F.regexp_extract("_a", r"(?is)<a[^>]*>(.*)</a>", 1), "<[^>]*>", "")).alias("title"),
    )
    if keep is not None:
        links = links.where(keep)
    return links.where("href <> ''").withColumn("link_url", tx.resolve_url("_base", "href")).drop("_base")


def pdf_links() -> Column:
    return F.lower("href").endswith(".pdf")


def report_links(prefixes: list[str] = REPORT_PREFIXES) -> Column:
    """Addresses that start with one of the prefixes."""
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.col("href").startswith(p)
    return cond


def scan_books(files: DataFrame, image_dirs: DataFrame, pdfs: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Documents named by six digits whose image folder exists; with a flag for their pdf."""
    books = files.where(F.col(name).rlike(r"^\d{6}\.md$")).withColumn("book_id", F.left(name, F.lit(6)))
    books = books.join(image_dirs.select("book_id").distinct(), "book_id", "left_semi")
    if pdfs is None:
        return books
    have = pdfs.select("book_id").distinct().withColumn("has_pdf", F.lit(True))
    return books.join(have, "book_id", "left").withColumn("has_pdf", F.coalesce("has_pdf", F.lit(False)))


def complete_books(files: DataFrame) -> DataFrame:
    """Books that have images, a pdf and the full document. files(book_id, name)."""
    low = F.lower("name")
    return (
        files.groupBy("book_id")
        .agg(
            F.bool_or(low.rlike(r"\.(png|jpe?g)$")).alias("images"),
            F.bool_or(low.endswith(".pdf")).alias("pdf"),
            F.bool_or(F.col("name") == "full.md").alias("document"),
        )
        .where("images AND pdf AND document")
        .select("book_id")
    )


def file_counts(files: DataFrame, kind: Column) -> DataFrame:
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def merge_parts(parts: DataFrame, name: str = "name", text: str = "text", numeric: bool = True) -> DataFrame:
    """Documents put together from their parts ``<name>_part_<n>``, where there are several.

    A document's parts are together once they are one row; ``numeric=False`` orders part 10
    before part 2.
    """
    split = parts.where(F.col(name).rlike(PART_NAME)).select(
        F.regexp_extract(name, PART_NAME, 1).alias("document"),
        F.regexp_extract(name, PART_NAME, 2).alias("_part"),
        F.col(text).alias("_text"),
    )
    order = F.col("_part").cast("bigint") if numeric else F.col("_part")
    rows = F.array_sort(F.collect_list(F.struct(order.alias("p"), F.col("_part").alias("q"), F.col("_text").alias("t"))))
    return (
        split.groupBy("document")
        .agg(rows.alias("_rows"))
        .where(F.size("_rows") > 1)
        .select(
            "document",
            F.size("_rows").alias("n_parts"),
            F.array_join(F.transform("_rows", lambda r: r["t"]), PART_JOIN).alias("text"),
        )
    )


def page_splits(docs: DataFrame, pages: str, size: int = 600, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Page ranges of at most ``size`` pages for documents with more than that."""
    starts = F.sequence(F.lit(0), F.col(pages).cast("int") - 1, F.lit(size))
    return docs.where(F.col(pages) > size).select(
        *keys, F.col(pages).alias("_n"), F.posexplode(starts).alias("_k", "_s")
    ).select(
        *keys,
        (F.col("_k") + 1).alias("part_no"),
        (F.col("_s") + 1).alias("first_page"),
        F.least(F.col("_s") + size, F.col("_n")).cast("bigint").alias("last_page"),
    )


def renumber(docs: DataFrame, images: DataFrame, name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with new ids and rewritten image references, image id table).

    Documents in name order that show at least one existing image get 1..n; a document's
    images get 1..m as they first appear. images(name, rel_path) lists the files.
    Book numbers come from the documents' names alone. References are rewritten inside
    the document's row from its own short list of images.
    """
    refs = pg.raw_image_refs(docs, text, (name,))
    first = refs.groupBy(name, "rel_path").agg(F.min("ref_no").alias("ref_no"))
    have = first.join(images.select(name, "rel_path").distinct(), [name, "rel_path"], "left_semi")
    # one list per document; it holds what the document's text holds
    lists = have.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("ref_no", "rel_path"))).alias("_refs"))
    books = with_position(lists.select(name), [name], (), "book_no").withColumn(
        "book_id", tx.zero_fill("book_no")
    )
    named = lists.join(books, name)
    new_names = F.transform(
        "_refs",
        lambda r, i: F.struct(
            r["rel_path"].alias("rel_path"),
            F.concat(tx.zero_fill(i + 1), tx.extension(r["rel_path"])).alias("image_file"),
        ),
    )
    named = named.select(name, "book_id", new_names.alias("_new"))
    table = named.select(name, "book_id", F.inline("_new"))
    as_map = F.map_from_entries(F.transform("_new", lambda r: F.struct(r["rel_path"], r["image_file"])))
    with_map = docs.join(named.select(name, "book_id", as_map.alias("_map")), name)
    t = F.col(text)
    tags = F.regexp_extract_all(t, F.lit(f"({tx.RAW_IMAGE_TAG})"), F.lit(1))
    gaps = F.split(t, tx.RAW_IMAGE_TAG)
    rewritten = F.transform(
        tags,
        lambda tag: F.transform(
            F.array(F.try_element_at(F.col("_map"), F.regexp_extract(tag, tx.RAW_IMAGE_TAG, 1))),
            lambda new: F.when(
                new.isNotNull(), F.concat(F.lit("![](../images/"), F.col("book_id"), F.lit("/"), new, F.lit(")"))
            ).otherwise(tag),
        )[0],
    )
    both = with_map.select(name, "book_id", gaps.alias("_gaps"), rewritten.alias("_tags"))
    out = both.select(
        name,
        "book_id",
        F.array_join(
            F.zip_with("_gaps", "_tags", lambda g, new: F.concat(g, F.coalesce(new, F.lit("")))), ""
        ).alias("text"),
    )
    return out, table
