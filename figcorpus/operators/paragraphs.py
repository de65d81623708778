"""Documents to lines, paragraphs, image tags and figure labels.

A document is one row, so its paragraphs, line numbers and context windows are
computed inside that row. No text is shuffled; only the sparse rows that come
out (image tags, captions, labels) travel to later joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import text as tx


def explode_lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """One row per line, empty lines included, numbered from 1."""
    return docs.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "content")).select(
        *keys, (F.col("_pos") + 1).alias("line_no"), "content"
    )


def paragraphs_of(text) -> Column:
    """Array of the paragraphs of one text with true 1-based line numbers.

    Paragraphs are the pieces between empty lines, stripped, empty ones dropped.
    ``before`` is the running size (content + 2) of the paragraphs in front, ``size`` the characters of
    the content, which turn every "at least k characters" search into a comparison of two numbers.
    """
    def measure(piece):
        return F.struct(
            tx.newline_count(piece).alias("nl"),
            F.when(tx.is_blank(F.left(piece, F.lit(1))), tx.newline_count(piece) - tx.newline_count(tx.lstrip(piece))).otherwise(0).alias("lead"),
            tx.strip_ends(piece).alias("content"),
        )

    def extend(x):
        return F.struct(
            x["nl"].alias("nl"),
            x["lead"].alias("lead"),
            x["content"].alias("content"),
            tx.newline_count(x["content"]).alias("inner"),
            F.length(x["content"]).alias("size"),
        )

    def number(pieces):
        lines = tx.running_sums(F.transform(pieces, lambda x: x["nl"] + 2))
        sizes = tx.running_sums(F.transform(pieces, lambda x: F.when(x["size"] > 0, x["size"] + 2).otherwise(0)))
        return tx.bind(F.struct(lines.alias("lines"), sizes.alias("sizes")), lambda sums: place(pieces, sums))

    def place(pieces, sums):
        def para(x, i):
            first = F.get(sums["lines"], i) + 1 + x["lead"]
            return F.struct(
                x["content"].alias("content"),
                first.alias("start_line"),
                (first + x["inner"]).alias("end_line"),
                F.substring_index(x["content"], "\n", 1).alias("first_line"),
                F.get(sums["sizes"], i).alias("before"),
                x["size"].alias("size"),
            )

        return F.filter(F.transform(pieces, para), lambda p: p["content"] != "")

    return tx.bind(F.transform(F.transform(F.split(tx._c(text), "\n\n"), measure), extend), number)


def split_paragraphs(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """One row per paragraph: number, line range, content, lines."""
    return (
        docs.select(*keys, F.posexplode(paragraphs_of(text)).alias("_pos", "_p"))
        .select(*keys, (F.col("_pos") + 1).alias("para_no"), "_p.start_line", "_p.end_line", "_p.content")
        .withColumn("lines", F.split("content", "\n"))
    )


def paragraph_lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Lines that lie in a paragraph, with the paragraph's number, range, first line and
    the line's offset in it. This is where the interval joins line -> paragraph end up:
    a line is exploded out of its paragraph, so nothing is looked up."""
    paras = docs.select(
        *keys,
        (tx.newline_count(text) + 1).alias("n_lines"),
        F.posexplode(paragraphs_of(text)).alias("_pos", "_p"),
    )
    lines = paras.select(
        *keys,
        "n_lines",
        (F.col("_pos") + 1).alias("para_no"),
        F.col("_p.start_line").alias("para_start"),
        F.col("_p.end_line").alias("para_end"),
        F.col("_p.first_line").alias("para_first_line"),
        F.posexplode(F.split("_p.content", "\n")).alias("_i", "content"),
    )
    return lines.withColumn("line_no", F.col("para_start") + F.col("_i")).drop("_i")


def image_tags(lines: DataFrame, pattern: str = tx.IMAGE_TAG) -> DataFrame:
    """One row per image tag of a line table, with its place among the tags of the line."""
    keep = [c for c in lines.columns]
    return lines.where(F.col("content").rlike(pattern)).select(
        *keep,
        F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("tag_no", "image_filename"),
    )


def raw_image_refs(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Tags of freshly parsed documents, ``![](images/...)``, in order of appearance."""
    refs = F.regexp_extract_all(F.col(text), F.lit(tx.RAW_IMAGE_TAG), F.lit(1))
    return docs.select(*keys, F.posexplode(refs).alias("_pos", "rel_path")).select(
        *keys, (F.col("_pos") + 1).alias("ref_no"), "rel_path"
    )


def image_char_windows(docs: DataFrame, n: int = 2000, text: str = "text", keys: tuple[str, ...] = ("book_id",)):
    """n characters on both sides of each image tag, taken at the tag's own position."""
    tag = r"!\[.*?\]\((.*?)\)"
    t = F.col(text)
    # Text between tags gives each tag's position without searching for it again.
    gaps = F.split(t, tag)
    whole = F.regexp_extract_all(t, F.lit(f"({tag})"), F.lit(1))
    paths = F.regexp_extract_all(t, F.lit(tag), F.lit(1))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, w: F.length(g) + F.length(w))
    positions = F.zip_with(tx.running_sums(sizes), gaps, lambda n, g: n + F.length(g) + 1)
    positions = F.slice(positions, F.lit(1), F.size(whole))
    rows = F.transform(
        F.arrays_zip(paths.alias("path"), positions.alias("at")),
        lambda x, i: F.struct(
            (i + 1).alias("image_no"), x["path"].alias("path"), tx.char_window(t, x["at"], n).alias("context")
        ),
    )
    return docs.where(F.col(text).rlike(tag)).select(*keys, F.inline(rows))


def window_around(paras: Column, at: Column, k: int) -> Column:
    """First and last paragraph (0-based) of the context of k characters around paragraph ``at``:
    whole paragraphs before it until k/2 characters are reached, and after it likewise."""
    half = k // 2
    here = F.get(paras, at)
    size = F.size(paras)
    # Each paragraph adds at least 3 characters, so no more than this many are ever needed.
    reach = half // 3 + 1
    lo_bound = F.greatest(F.lit(0), at - reach)
    hi_bound = F.least(size - 1, at + reach)
    base = here["before"]
    tail = base + here["size"] + 2
    lo = F.coalesce(
        F.array_max(
            F.filter(F.sequence(lo_bound, at), lambda i: base - F.get(paras, i)["before"] >= half)
        ),
        F.lit(0),
    )
    hi = F.coalesce(
        F.array_min(
            F.filter(
                F.sequence(at, hi_bound),
                lambda i: F.get(paras, i)["before"] + F.get(paras, i)["size"] + 2 - tail >= half,
            )
        ),
        size - 1,
    )
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def _joined(paras: Column, window: Column) -> Column:
    within = F.slice(paras, window["lo"] + 1, window["hi"] - window["lo"] + 1)
    return F.array_join(F.transform(within, lambda p: p["content"]), "\n\n")


def context_around(paras: Column, at: Column, k: int) -> Column:
    """The paragraphs of :func:`window_around`, joined by blank lines."""
    return tx.bind(window_around(paras, at, k), lambda w: _joined(paras, w))


def nested_contexts(paras: Column, at: Column, widest: Column, **sizes: int) -> Column:
    """One text around a paragraph that all its contexts are slices of.

    ``widest`` is the largest context in characters, given as a window. Every name of
    ``sizes`` becomes struct(at, n): where that context lies in ``text``; ``own`` is the
    paragraph itself. So contexts of several sizes cost their text once.
    """

    def place(w):
        start = F.get(paras, w["widest"]["lo"])["before"]

        def part(lo, hi):
            last = F.get(paras, hi)
            first = F.get(paras, lo)["before"]
            return F.struct(
                (first - start).cast("int").alias("at"),
                (last["before"] + last["size"] - first).cast("int").alias("n"),
            )

        return F.struct(
            _joined(paras, w["widest"]).alias("text"),
            part(at, at).alias("own"),
            *[part(w[name]["lo"], w[name]["hi"]).alias(name) for name in sizes],
        )

    windows = F.struct(widest.alias("widest"), *[window_around(paras, at, k).alias(name) for name, k in sizes.items()])
    return tx.bind(windows, place)


def paragraph_contexts(
    docs: DataFrame, wanted: str, k: int, text: str = "text", keys: tuple[str, ...] = ("book_id",)
) -> DataFrame:
    """Context of at least k characters for each paragraph that matches a pattern."""
    rows = docs.where(F.col(text).rlike(wanted)).select(*keys, paragraphs_of(text).alias("_ps"))
    picked = F.filter(
        F.transform("_ps", lambda p, i: F.when(p["content"].rlike(wanted), i)), lambda i: i.isNotNull()
    )
    made = F.transform(
        picked,
        lambda i: F.struct(
            (i + 1).alias("para_no"),
            F.get("_ps", i)["start_line"].alias("start_line"),
            F.get("_ps", i)["end_line"].alias("end_line"),
            context_around(F.col("_ps"), i, k).alias("context"),
        ),
    )
    return rows.select(*keys, F.inline(made))
