"""In-text references to a figure's caption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import proximity as px
from figcorpus.session import durable, scratch_dir

IMAGE_KEY = ("line_no", "tag_no")


def distinct_captions(captions: Column) -> Column:
    """Captions of one image without repeated texts, then without repeated figure numbers;
    the first of each stays, captions without a number go."""
    numbered = F.transform(
        captions,
        lambda c: F.struct(
            c["content"].alias("content"),
            c["line_no"].alias("line_no"),
            c["distance"].alias("distance"),
            tx.figure_identifier(c["content"]).alias("figure_number"),
        ),
    )

    def first_of(rows, field):
        values = F.transform(rows, lambda r: r[field])
        return F.filter(rows, lambda r, i: r[field].isNotNull() & (F.array_position(values, r[field]) == i + 1))

    once = F.transform(F.array(numbered), lambda r: first_of(r, "content"))
    return F.transform(once, lambda r: first_of(r, "figure_number"))[0]


def placed_labels(marked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per label in the text, with its line and its place in the paragraph."""
    m = F.col("m")
    return (
        marked.select(*keys, F.explode(F.filter("marks", lambda k: k["is_label"])).alias("m"))
        .select(
            *keys,
            m["line_no"].alias("ref_line"),
            m["para_no"].alias("ref_para"),
            (m["para_end"] - m["para_start"] + 1).alias("para_lines"),
            m["content"].alias("ref_content"),
            F.transform(m["labels"], lambda x: x["label"]).alias("labels"),
            F.posexplode(m["labels"]).alias("label_no", "z"),
        )
        .withColumn("char_pos", F.col("z.at"))
        .withColumn("label", F.col("z.label"))
        .drop("z")
    )


def label_prefixes(marked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per label in the text and per prefix of it that could be a figure number.

    A number that occurs in a line is a prefix of a label there, so listing the prefixes
    turns "paragraph contains number" into an equality. A label has few prefixes.
    """
    rows = placed_labels(marked, keys)
    low = F.lower("label")
    prefixes = F.filter(
        F.transform(F.sequence(F.lit(1), F.length("label")), lambda n: F.left(low, n)), lambda p: p.rlike(r"\d$")
    )
    return rows.withColumn("prefix", F.explode(prefixes))


def _captions(marked: DataFrame, keys, search) -> DataFrame:
    images = px.nearby(marked, keys=keys, **search)
    return images.select(
        *keys,
        *IMAGE_KEY,
        "image_filename",
        F.col("para_no").alias("image_para"),
        F.posexplode(distinct_captions(F.col("captions"))).alias("caption_no", "c"),
    ).select(
        *keys,
        *IMAGE_KEY,
        "image_filename",
        "image_para",
        "caption_no",
        F.col("c.content").alias("caption"),
        F.col("c.line_no").alias("caption_line"),
        F.col("c.figure_number").alias("figure_number"),
    )


def take_until(hits: DataFrame, group: tuple[str, ...], order: tuple[str, ...], exact: str = "is_exact") -> DataFrame:
    """Hits in order up to the one that completes at least one exact and two other matches."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        hits.withColumn("_exact", F.coalesce(F.sum(F.col(exact).cast("int")).over(before), F.lit(0)))
        .withColumn("_other", F.coalesce(F.sum((~F.col(exact)).cast("int")).over(before), F.lit(0)))
        .where(~((F.col("_exact") >= 1) & (F.col("_other") >= 2)))
        .drop("_exact", "_other")
    )


def marked_documents(
    docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",), texts: bool = False
) -> DataFrame:
    """The sparse marks, written once: captions and labels are both read from them, so the
    documents are scanned a single time. ``texts`` are a column of their own in the file,
    read by those alone who ask for it."""
    marked = px.figure_marks(docs, text, keys, texts, labels=True)
    if not texts:
        return durable(marked)
    out = scratch_dir(docs.sparkSession, "marks")
    marked.write.parquet(out)
    return docs.sparkSession.read.schema(marked.schema).parquet(out)


def _exact(prefix: str) -> Column:
    return F.exists("labels", lambda x: F.lower(x) == F.col(prefix))


def _rankings(captions: DataFrame, listed: DataFrame, list_key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(captions with _out_para and _out_line, slices with both): which slice of its number's list each caption takes.

    ``listed`` holds each number's labels; its list in order is cut where it is complete.
    A caption takes that slice unless its image's paragraph is in it. For each such
    paragraph there is a slice of the list without it, and likewise one without
    each caption line that is in the caption's slice. A slice is short once an
    exact label came, so few paragraphs and lines have lists of their own, however many captions
    share the number; what is not in a slice changes nothing by being left out.
    """
    order, none = ("ref_para", "char_pos"), F.lit(-1).cast("bigint")
    whole = take_until(listed, tuple(list_key), order).withColumn("_out_para", none)
    touched = whole.select(*list_key, F.col("ref_para").cast("bigint").alias("_out_para")).distinct()
    near = captions.join(
        touched.withColumns({"image_para": F.col("_out_para"), "_hit": F.lit(True)}).drop("_out_para"), [*list_key, "image_para"], "left"
    ).withColumn("_out_para", F.when(F.col("_hit"), F.col("image_para").cast("bigint")).otherwise(none))
    near = durable(near.drop("_hit"))
    own = near.where("_out_para >= 0").select(*list_key, "_out_para").distinct()
    apart = take_until(listed.join(own, list_key).where("ref_para <> _out_para"), (*list_key, "_out_para"), order)
    slices = durable(whole.unionByName(apart)).withColumn("_out_line", none)
    key = [*list_key, "_out_para"]
    lines = slices.select(*key, F.col("ref_line").alias("caption_line"), F.lit(True).alias("_hit")).distinct()
    near = near.join(lines, [*key, "caption_line"], "left")
    near = near.withColumn("_out_line", F.when(F.col("_hit"), F.col("caption_line").cast("bigint")).otherwise(none)).drop("_hit")
    own = near.where("_out_line >= 0").select(*key, "_out_line").distinct()
    without = listed.join(own, list_key).where("ref_para <> _out_para and ref_line <> _out_line")
    return near, slices.unionByName(take_until(without, (*key, "_out_line"), order))


def find_references(marked: DataFrame, keys: tuple[str, ...] = ("book_id",), **search) -> DataFrame:
    """Every caption of every image with its references; captions without any keep one row
    with NULL reference columns.

    Labels are ranked once per (book, number prefix), and a caption takes a slice of
    its number's list (:func:`_rankings`), so captions that share a number don't meet
    all its labels. Both sides are sparse, and the key spreads a large book over its
    figure numbers. Paragraphs with the image and the caption's own line do not count.
    """
    book = keys[0]
    list_key = [book, "prefix"]
    captions = _captions(marked, keys, search).withColumn("prefix", F.lower("figure_number"))
    labels = label_prefixes(marked.select(book, "marks"), (book,)).withColumn("is_exact", _exact("prefix"))
    wanted = captions.select(*list_key).distinct()
    listed = durable(labels.join(wanted, list_key, "left_semi").select(*list_key, "ref_para", "char_pos", "ref_line", "is_exact"))
    near, slices = _rankings(captions, listed, list_key)
    placed = near.join(
        slices.select(*list_key, "_out_para", "_out_line", "ref_para", "char_pos"), [*list_key, "_out_para", "_out_line"], "left"
    ).drop("_out_para", "_out_line")
    # what a reference says is fetched once the slices are known, from one row per label
    place = {f"_{c}": c for c in (book, "ref_para", "char_pos")}
    told = placed_labels(marked.select(book, "marks"), (book,)).drop("label_no").withColumnsRenamed({c: k for k, c in place.items()})
    here = [F.col(k) == F.col(c) for k, c in place.items()]
    is_prefix = (F.length("prefix") <= F.length("label")) & (F.left(F.lower("label"), F.length("prefix")) == F.col("prefix"))
    return placed.join(told, [*here, is_prefix], "left").withColumn("is_exact", _exact("prefix")).drop("prefix", "label", *place)


def reference_counts(refs: DataFrame, keys: tuple[str, ...] = ("book_id",), keep_unreferenced: bool = True) -> DataFrame:
    """References per caption."""
    counted = refs.groupBy(*keys, *IMAGE_KEY, "image_filename", "image_para", "caption_no", "caption", "caption_line", "figure_number").agg(
        F.count("ref_line").alias("reference_count"), F.count_if("is_exact").alias("exact_count")
    )
    return counted if keep_unreferenced else counted.where("reference_count > 0")


def reference_totals(counts: DataFrame, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """References per image."""
    return counts.groupBy(*keys, *IMAGE_KEY).agg(
        F.sum("reference_count").alias("total_reference_count"), F.count("*").alias("caption_count")
    )


def _digits(col: Column) -> Column:
    d = F.regexp_replace(col, r"\D", "")
    return F.coalesce(F.nullif(d, F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def repair_figure_numbers(marked: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """Captions without references whose number ran into the text behind it (图22015-2016).

    Shorter numbers are tried from the right; of those with references the one closest
    to the digits of the image's file name wins, the longest on a tie.
    """
    book = keys[0]
    lost = counts.where((F.col("reference_count") == 0) & tx.has_digit_run("figure_number", 3))
    sizes = F.sequence(F.lit(2), F.greatest(F.length("figure_number") - 1, F.lit(2)))
    tried = lost.withColumn(
        "candidate",
        F.explode(
            F.filter(
                F.transform(sizes, lambda n: F.left("figure_number", n)),
                lambda c: c.rlike(r"\d$") & (F.length(c) < F.length("figure_number")),
            )
        ),
    )
    # a candidate's references are its number's, without those in the image's paragraph
    full = F.when(F.lower("label") == F.col("prefix"), F.col("label"))
    labels = label_prefixes(marked.select(book, "marks"), (book,)).groupBy(book, "prefix", full.alias("full"), "ref_para").agg(F.count("*").alias("n"))
    labels = durable(labels)
    tried = tried.withColumn("prefix", F.lower("candidate"))
    named = [*keys, *IMAGE_KEY, "image_filename", "caption_no", "figure_number", "candidate"]
    counted = labels.groupBy(book, "prefix", "full").agg(F.sum("n").alias("n"))
    everywhere = tried.join(counted, [book, "prefix"]).select(*named, "full", "n")
    beside = tried.join(labels.withColumnRenamed("ref_para", "image_para"), [book, "prefix", "image_para"]).select(*named, "full", (-F.col("n")).alias("n"))
    per_candidate = (
        everywhere.unionByName(beside)
        .groupBy(*named)
        .agg(
            F.sum("n").alias("reference_count"),
            F.coalesce(F.sum(F.when(F.col("full") == F.col("candidate"), F.col("n"))), F.lit(0)).alias("exact_count"),
        )
        .where("reference_count > 0")
    )
    off = F.abs(_digits(F.col("candidate")) - _digits(F.col("image_filename")))
    best = F.min_by(
        F.struct("candidate", "reference_count", "exact_count"), F.struct(off, -F.length("candidate"))
    )
    return (
        per_candidate.groupBy(*keys, *IMAGE_KEY, "caption_no", "figure_number")
        .agg(best.alias("b"))
        .select(
            *keys,
            *IMAGE_KEY,
            "caption_no",
            "figure_number",
            F.col("b.candidate").alias("repaired_number"),
            F.col("b.reference_count").alias("reference_count"),
            F.col("b.exact_count").alias("exact_count"),
        )
    )


def _fetched(marked: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The texts that each image wants, as a map from the paragraph's number.

    ``wanted`` holds keys only (``key``, image, ``para_no``). Each marked paragraph travels
    once, from the written table to the images that want it; a text that an image wants
    several times is one entry.
    """
    texts = marked.select(key, F.explode("texts").alias("t")).select(key, "t.para_no", "t.told").dropDuplicates([key, "para_no"])
    return (
        wanted.join(texts, [key, "para_no"])
        .groupBy(key, *IMAGE_KEY)
        .agg(F.map_from_entries(F.collect_set(F.struct("para_no", "told"))).alias("texts"))
    )


def _part(texts: Column, para_no: Column, name: str) -> Column:
    told = F.try_element_at(texts, para_no)
    return F.substring(told["text"], told[name]["at"] + 1, told[name]["n"])


def context_records(docs: DataFrame, text: str = "text", key: str = "book_id", every: bool = True, **search) -> DataFrame:
    """The nested record of each image: class, surroundings, neighbours, captions, references.

    One scan of the documents. Searches, joins and nesting carry keys and single lines; what
    paragraphs say is fetched at the end, once for each (image, paragraph). ``every=False``
    fetches only what contexts and prompts show: the image's own surroundings and, for
    ``normal`` images, the first exact reference and the first one of all; the other texts are null.
    """
    keys = (key,)
    image = [key, *IMAGE_KEY]
    marked = marked_documents(docs, text, keys, texts=True)
    lean = marked.drop("texts")
    images = px.classify(px.nearby(lean, keys=keys, **search))
    refs = find_references(lean, keys, **search)
    reference = F.when(
        F.col("ref_line").isNotNull(),
        F.struct("ref_para", "char_pos", "labels", "is_exact", "ref_line", "ref_content", "para_lines"),
    )
    per_caption = refs.groupBy(*image, "caption_no", "caption", "figure_number").agg(
        F.array_sort(F.collect_list(reference)).alias("references")
    )
    listed = F.struct("caption_no", "caption", "figure_number", "references")
    per_image = per_caption.groupBy(*image).agg(F.array_sort(F.collect_list(listed)).alias("cited"))
    records = durable(images.join(per_image, image, "left"))

    told = F.flatten(F.transform("cited", lambda c: c["references"]))
    nos = F.transform(told, lambda r: r["ref_para"])
    if every:
        wanted = F.array_union(F.transform("captions", lambda c: c["para_no"]), F.coalesce(nos, F.array().cast("array<int>")))
    else:
        firsts = F.array(F.get(nos, F.lit(0)), F.get(F.filter(told, lambda r: r["is_exact"]), F.lit(0))["ref_para"])
        wanted = F.when(F.col("classification") == px.CLASSES[0], firsts).otherwise(F.array().cast("array<int>"))
    needs = records.select(*image, F.explode(F.array_union(F.array("para_no"), wanted)).alias("para_no")).where("para_no IS NOT NULL")
    full = records.join(_fetched(marked, needs, key), image, "left")

    texts = F.col("texts")
    neighbours = F.transform(
        "other_images",
        lambda o: F.struct(o["line_no"].alias("line_number"), o["content"].alias("content"), o["distance"].alias("distance")),
    )
    captions = F.transform(
        "captions",
        lambda c: F.struct(
            c["content"].alias("content"),
            _part(texts, c["para_no"], "near").alias("content_paragraph"),
            c["line_no"].alias("line_number"),
            c["distance"].alias("distance"),
        ),
    )

    def shown(r):
        return F.struct(
            r["labels"].alias("reference_text"),
            r["is_exact"].alias("is_exact_match"),
            F.struct(
                r["ref_line"].alias("line_number"),
                r["ref_content"].alias("content"),
                r["char_pos"].alias("char_position_in_paragraph"),
            ).alias("match_line_info"),
            _part(texts, r["ref_para"], "own").alias("reference_paragraph"),
            _part(texts, r["ref_para"], "wide").alias("reference_paragraph_extension"),
            r["para_lines"].alias("total_lines_in_paragraph"),
        )

    cited = F.transform(
        "cited",
        lambda c: F.struct(
            c["caption"].alias("caption"),
            c["figure_number"].alias("figure_number"),
            F.size(c["references"]).alias("reference_count"),
            F.transform(c["references"], shown).alias("references"),
        ),
    )
    return full.select(
        key,
        "image_filename",
        F.col("line_no").alias("image_tag_line_number"),
        "tag_no",
        F.try_element_at(texts, F.col("para_no"))["text"].alias("image_surround_text"),
        "classification",
        F.struct(F.size("other_images").alias("count"), neighbours.alias("images")).alias("other_images_nearby"),
        "caption_count",
        captions.alias("captions_found"),
        "nearest_caption",
        cited.alias("caption_references"),
        F.coalesce(F.size(told), F.lit(0)).alias("total_reference_count"),
    )
