"""Captions and other images near each image tag, and the class that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import paragraphs as pg

CLASSES = ("normal", "abnormal", "extreme abnormal")


def figure_marks(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",), texts: bool = False, labels: bool = False
) -> DataFrame:
    """One row per document with images, and the sparse lines that the searches look at.

    ``marks`` lists the lines that hold an image tag or a figure label, in order, each
    with its paragraph and its offset there. It is made inside the document's own row,
    so the text itself is never shuffled. ``labels`` lists in each mark its figure labels and where
    they stand in the paragraph. ``texts`` adds a second list, one entry for each
    paragraph with marks (however many it has): a text around it, and where in that text the paragraph and
    the contexts lie that nested records show, 500 characters around captions, 1000 around
    references. Around a paragraph with an image the text is the image's own context of 4000
    characters. Marks point to it by ``para_no``, so it is fetched only where it is wanted.
    """
    wanted = f"(?:{tx.IMAGE_TAG})|(?:{tx.CAPTION})"

    def labels_of(h, offset):
        found = F.transform(tx.bind(tx.strip(h["raw"]), tx.placed_labels), lambda x: F.struct(x["label"].alias("label"), (x["at"] + offset).alias("at")))
        return F.when(h["is_label"], found).alias("labels")

    def lines_of(p, i):
        hits = F.filter(
            F.transform(
                F.split(p["content"], "\n"),
                lambda x, j: F.struct(
                    x.alias("raw"),
                    j.alias("j"),
                    x.rlike(tx.IMAGE_TAG).alias("is_image"),
                    tx.matches_caption(x).alias("is_label"),
                ),
            ),
            lambda h: h["is_image"] | h["is_label"],
        )
        def mark(h, offset):
            return F.struct(
                (p["start_line"] + h["j"]).alias("line_no"),
                tx.strip(h["raw"]).alias("content"),
                (i + 1).alias("para_no"),
                p["start_line"].alias("para_start"),
                p["end_line"].alias("para_end"),
                offset.alias("offset"),
                h["is_image"].alias("is_image"),
                h["is_label"].alias("is_label"),
                (h["is_label"] & tx.starts_figure(h["raw"], p["first_line"])).alias("is_start"),
                *([labels_of(h, offset)] if labels else []),
            )

        def placed(h):
            # characters of the paragraph in front of the stripped line
            above = F.when(h["j"] > 0, F.length(F.call_function("substring_index", p["content"], F.lit("\n"), h["j"])) + 1).otherwise(0)
            return tx.bind(above + F.length(h["raw"]) - F.length(tx.lstrip(h["raw"])), lambda offset: mark(h, offset))

        return F.transform(hits, placed)

    def text_of(ps, p, i):
        widest = F.when(p["content"].rlike(tx.IMAGE_TAG), pg.window_around(ps, i, 4000)).otherwise(pg.window_around(ps, i, 1000))
        return F.struct((i + 1).alias("para_no"), pg.nested_contexts(ps, i, widest, near=500, wide=1000).alias("told"))

    def lists(t, ps):
        # the places of the paragraphs with marks, looked for once
        picked = F.filter(F.transform(ps, lambda p, i: F.when(p["content"].rlike(wanted), i)), lambda i: i.isNotNull())

        def made(at):
            marks = F.flatten(F.transform(at, lambda i: tx.bind(F.get(ps, i), lambda p: lines_of(p, i))))
            told = F.transform(at, lambda i: tx.bind(F.get(ps, i), lambda p: text_of(ps, p, i)))
            return F.struct((tx.newline_count(t) + 1).alias("n_lines"), marks.alias("marks"), *([told.alias("texts")] if texts else []))

        return tx.bind(picked, made)

    # a filter in front would work out a derived text a second time
    some = F.filter(F.array(F.col(text)), lambda t: t.rlike(tx.IMAGE_TAG))
    return docs.select(*keys, F.inline(F.transform(some, lambda t: tx.bind(pg.paragraphs_of(t), lambda ps: lists(t, ps)))))


def _limit(searched: Column, n_lines: Column, max_range: int) -> Column:
    """Farthest distance of an expanding search: it goes on line by line while every distance
    has a hit; at the first empty distance it looks ``max_range`` lines further at once."""
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(max_range)), searched))
    far = F.greatest(F.least(gap + max_range, F.floor(n_lines / 2).cast("int")), F.lit(max_range))
    return F.when(gap.isNull(), F.lit(max_range)).otherwise(far)


def nearby(marked: DataFrame, max_range: int = 5, center_offset: int = 0, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Captions and other images around every image tag of the marked documents.

    Marks are ordered by line, so all lines within reach of an image lie among the few
    marks before and behind it: the band join is a slice of the document's own list.
    ``center_offset=-1`` searches around the line above the tag.
    """
    reach = 2 * max_range
    span = reach + abs(center_offset)
    marks = F.col("marks")

    def around(m, i):
        center = m["line_no"] + center_offset
        band = F.slice(marks, F.greatest(i - span, F.lit(0)) + 1, F.lit(2 * span + 1))

        def hits(flag):
            return F.array_sort(
                F.transform(
                    F.filter(band, lambda h: h[flag] & F.abs(h["line_no"] - center).between(1, reach)),
                    lambda h: F.struct(
                        F.abs(h["line_no"] - center).alias("search"),
                        h["line_no"].alias("line_no"),
                        h["content"].alias("content"),
                        F.abs(h["line_no"] - m["line_no"]).alias("distance"),
                        h["is_start"].alias("is_start"),
                        h["para_no"].alias("para_no"),
                    ),
                )
            )

        return F.struct(m.alias("m"), hits("is_label").alias("labels"), hits("is_image").alias("images"))

    def kept(hits, also):
        limit = _limit(F.transform(hits, lambda h: h["search"]), F.col("n_lines"), max_range)
        # the one-element array binds the limit once for all hits
        return F.transform(F.array(limit), lambda top: F.filter(hits, lambda h: (h["search"] <= top) & also(h)))[0]

    def settle(x):
        return F.struct(
            x["m"].alias("m"),
            kept(x["labels"], lambda h: h["is_start"]).alias("captions"),
            kept(x["images"], lambda h: h["line_no"] != x["m"]["line_no"]).alias("others"),
        )

    found = F.filter(F.transform(marks, lambda m, i: F.when(m["is_image"], around(m, i))), lambda x: x.isNotNull())
    rows = marked.select(*keys, F.explode(F.transform(found, settle)).alias("x"))
    m = F.col("x.m")
    return rows.select(
        *keys,
        m["line_no"].alias("line_no"),
        m["para_no"].alias("para_no"),
        m["para_start"].alias("para_start"),
        m["para_end"].alias("para_end"),
        F.col("x.captions").alias("captions"),
        F.col("x.others").alias("other_images"),
        F.posexplode(F.regexp_extract_all(m["content"], F.lit(tx.IMAGE_TAG), F.lit(1))).alias("tag_no", "image_filename"),
    )


def classify(images: DataFrame) -> DataFrame:
    """No caption: extreme abnormal; one caption and no other image: normal; else abnormal.
    The nearest caption is the first one, the upper of two at the same distance."""
    n = F.size("captions")
    return (
        images.withColumn("caption_count", n)
        .withColumn("other_count", F.size("other_images"))
        .withColumn(
            "classification",
            F.when(n == 0, CLASSES[2])
            .when((n == 1) & (F.size("other_images") == 0), CLASSES[0])
            .otherwise(CLASSES[1]),
        )
        .withColumn("nearest_caption", F.coalesce(F.get("captions", F.lit(0))["content"], F.lit("")))
    )


def near_rows(images: DataFrame, which: str, key: str = "book_id") -> DataFrame:
    """One row per hit of ``captions`` or ``other_images``, nearest first."""
    return images.select(
        key,
        F.col("line_no").alias("image_line"),
        "tag_no",
        "image_filename",
        F.posexplode(which).alias("_pos", "_h"),
    ).select(
        key,
        "image_line",
        "tag_no",
        "image_filename",
        (F.col("_pos") + 1).alias("nearest_no"),
        F.col("_h.line_no").alias("hit_line"),
        F.col("_h.content").alias("hit_content"),
        F.col("_h.distance").alias("distance"),
    )


def image_records(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",), **search) -> DataFrame:
    """Documents to classified images, without a shuffle."""
    return classify(nearby(figure_marks(docs, text, keys), keys=keys, **search))


def classification_counts(images: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Images per class, case-insensitively; unknown classes are not counted, empty ones show 0."""
    label = F.lower(F.regexp_replace("classification", "_", " "))
    return images.groupBy(*by).agg(
        *[F.count_if(label == c).alias(c.replace(" ", "_")) for c in CLASSES]
    )


def books_with_abnormal(images: DataFrame, key: str = "book_id") -> DataFrame:
    label = F.lower(F.col("classification"))
    return (
        images.groupBy(key)
        .agg(F.count_if(label == "abnormal").alias("n_abnormal"))
        .where("n_abnormal > 0")
    )
