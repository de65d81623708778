"""Queries of the figure layer: neighbours, classes, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.operators import longbooks as lb
from figcorpus.operators import paragraphs as pg
from figcorpus.operators import proximity as px
from figcorpus.operators import references as rf
from figcorpus.plans import fixtures as fx
from figcorpus.plans.registry import query

# The expanding search written as plain joins.
NEAR = f"""{fx.MD_PARAS},
pl AS (SELECT l.*, p.para_no, p.start_line, p.end_line, p.first_line FROM lines l
       JOIN paras p ON l.book_id=p.book_id AND l.line_no BETWEEN p.start_line AND p.end_line),
img AS (SELECT book_id, source, line_no, n_lines, content, start_line, end_line FROM pl WHERE content LIKE '![](../images/%'),
lab AS (SELECT book_id, line_no, trim(content) content,
          (regexp_matches(content,'(?i)^\\s*fig') OR regexp_matches(first_line,'(?i)^\\s*fig')) is_start
        FROM pl WHERE regexp_matches(content,'(?i)fig(ure|\\.?)\\s*\\d')),
lh AS (SELECT i.book_id, i.line_no, i.n_lines, c.line_no hit_line, c.content, c.is_start, abs(c.line_no-i.line_no) d
       FROM img i JOIN lab c ON c.book_id=i.book_id AND abs(c.line_no-i.line_no) BETWEEN 1 AND 10),
ih AS (SELECT i.book_id, i.line_no, i.n_lines, c.line_no hit_line, trim(c.content) content, abs(c.line_no-i.line_no) d
       FROM img i JOIN img c ON c.book_id=i.book_id AND abs(c.line_no-i.line_no) BETWEEN 1 AND 10),
steps AS (SELECT unnest(range(1,6)) x),
lgap AS (SELECT i.book_id, i.line_no, i.n_lines, min(s.x) gap FROM img i CROSS JOIN steps s
         WHERE NOT EXISTS (SELECT 1 FROM lh WHERE lh.book_id=i.book_id AND lh.line_no=i.line_no AND lh.d=s.x) GROUP BY ALL),
igap AS (SELECT i.book_id, i.line_no, i.n_lines, min(s.x) gap FROM img i CROSS JOIN steps s
         WHERE NOT EXISTS (SELECT 1 FROM ih WHERE ih.book_id=i.book_id AND ih.line_no=i.line_no AND ih.d=s.x) GROUP BY ALL),
caps AS (SELECT h.* FROM lh h LEFT JOIN lgap g USING (book_id, line_no)
         WHERE h.is_start AND h.d <= CASE WHEN g.gap IS NULL THEN 5 ELSE greatest(least(g.gap+5, h.n_lines//2),5) END),
others AS (SELECT h.* FROM ih h LEFT JOIN igap g USING (book_id, line_no)
         WHERE h.d <= CASE WHEN g.gap IS NULL THEN 5 ELSE greatest(least(g.gap+5, h.n_lines//2),5) END),
ncap AS (SELECT book_id, line_no, count(*) n, arg_min(content, d*1000000+hit_line) nearest FROM caps GROUP BY ALL),
noth AS (SELECT book_id, line_no, count(*) n FROM others GROUP BY ALL),
classed AS (SELECT i.book_id, i.source, i.line_no, coalesce(c.n,0) caption_count, coalesce(o.n,0) other_count,
         CASE WHEN coalesce(c.n,0)=0 THEN 'extreme abnormal' WHEN c.n=1 AND coalesce(o.n,0)=0 THEN 'normal' ELSE 'abnormal' END classification,
         coalesce(c.nearest,'') nearest_caption
       FROM img i LEFT JOIN ncap c USING (book_id, line_no) LEFT JOIN noth o USING (book_id, line_no))"""


def _images(spark, sf):
    return px.image_records(fx.markdown(spark, sf), keys=("book_id", "source"))


@query(
    "d05_classify_image",
    f"""WITH {NEAR} SELECT book_id, line_no::BIGINT line_no, caption_count::BIGINT caption_count, other_count::BIGINT other_count,
    classification, nearest_caption FROM classed""",
)
def d05(spark, sf):
    return _images(spark, sf).select(
        "book_id", "line_no", "caption_count", "other_count", "classification", "nearest_caption"
    )


def _lines(spark, sf):
    return pg.explode_lines(fx.markdown(spark, sf))


@query(
    "d05_classify_by_lines",
    f"""WITH {NEAR} SELECT book_id, line_no::BIGINT line_no, caption_count::BIGINT caption_count, other_count::BIGINT other_count,
    classification, nearest_caption FROM classed""",
)
def d05_lines(spark, sf):
    """The same classes from line tables, as long books are searched."""
    found = lb.image_records(_lines(spark, sf))
    return found.select("book_id", "line_no", "caption_count", "other_count", "classification", "nearest_caption")


@query(
    "b04_line_paragraphs",
    f"""WITH {fx.MD_PARAS} SELECT book_id, para_no::BIGINT para_no, start_line::BIGINT start_line, end_line::BIGINT end_line,
    md5(trim(content, chr(32)||chr(9)||chr(10)||chr(13))) content FROM paras""",
)
def b04_lines(spark, sf):
    return lb.line_paragraphs(_lines(spark, sf)).select("book_id", "para_no", "start_line", "end_line", F.md5("content").alias("content"))


@query(
    "c01_near_captions",
    f"""WITH {NEAR} SELECT book_id, line_no::BIGINT image_line, hit_line::BIGINT hit_line, content hit_content, d::BIGINT distance FROM caps""",
)
def c01(spark, sf):
    return px.near_rows(_images(spark, sf), "captions").select(
        "book_id", "image_line", "hit_line", "hit_content", "distance"
    )


@query(
    "c02_near_images",
    f"""WITH {NEAR} SELECT book_id, line_no::BIGINT image_line, hit_line::BIGINT hit_line, content hit_content, d::BIGINT distance FROM others""",
)
def c02(spark, sf):
    return px.near_rows(_images(spark, sf), "other_images").select(
        "book_id", "image_line", "hit_line", "hit_content", "distance"
    )


@query(
    "f06_nearest_first",
    f"""WITH {NEAR} SELECT book_id, line_no::BIGINT image_line, hit_line::BIGINT hit_line,
    row_number() OVER (PARTITION BY book_id, line_no ORDER BY d, hit_line)::BIGINT nearest_no FROM caps""",
)
def f06(spark, sf):
    return px.near_rows(_images(spark, sf), "captions").select("book_id", "image_line", "hit_line", "nearest_no")


@query(
    "d03_classification_counts",
    f"""WITH {NEAR} SELECT source, count(*) FILTER (classification='normal') AS "normal",
    count(*) FILTER (classification='abnormal') AS abnormal,
    count(*) FILTER (classification='extreme abnormal') AS extreme_abnormal FROM classed GROUP BY source""",
)
def d03(spark, sf):
    return px.classification_counts(_images(spark, sf), by=("source",))


@query(
    "d04_books_with_abnormal",
    f"""WITH {NEAR} SELECT book_id, count(*) n_abnormal FROM classed WHERE classification='abnormal' GROUP BY book_id""",
)
def d04(spark, sf):
    return px.books_with_abnormal(_images(spark, sf))


# Captions of each image without repeats, the labels of the text, and their matches.
REFS = f"""{NEAR},
capn AS (SELECT c.book_id, c.line_no, c.hit_line, c.content, c.d,
    regexp_extract(c.content,'(?i)(Figure\\s*\\d+(?:[.-]\\d+)*|Fig\\.?\\s*\\d+(?:[.-]\\d+)*)',1) fig FROM caps c),
c1 AS (SELECT *, row_number() OVER (PARTITION BY book_id, line_no, content ORDER BY d, hit_line) k1 FROM capn),
c2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, line_no, fig ORDER BY d, hit_line) k2 FROM c1 WHERE k1=1 AND fig<>''),
c3 AS (SELECT *, row_number() OVER (PARTITION BY book_id, line_no ORDER BY d, hit_line)-1 caption_no FROM c2 WHERE k2=1),
labs AS (SELECT book_id, line_no, start_line, labels, unnest(labels) label, unnest(range(1,len(labels)+1)) k FROM (
   SELECT book_id, line_no, start_line, regexp_extract_all(trim(content),'(?i)(Figure\\s*\\d+(?:[.-]\\d+)*|Fig\\.?\\s*\\d+(?:[.-]\\d+)*)',1) labels FROM pl)),
hits AS (SELECT c.book_id, c.line_no, c.caption_no, c.fig, c.content caption, l.line_no ref_line, l.k, l.labels,
    len(list_filter(l.labels, lambda x: lower(x)=lower(c.fig)))>0 is_exact
  FROM c3 c JOIN img i ON i.book_id=c.book_id AND i.line_no=c.line_no
  JOIN labs l ON l.book_id=c.book_id AND starts_with(lower(l.label), lower(c.fig)) AND l.start_line<>i.start_line AND l.line_no<>c.hit_line),
counted AS (SELECT *, coalesce(sum(CASE WHEN is_exact THEN 1 ELSE 0 END) OVER w,0) e, coalesce(sum(CASE WHEN is_exact THEN 0 ELSE 1 END) OVER w,0) o
  FROM hits WINDOW w AS (PARTITION BY book_id, line_no, caption_no ORDER BY ref_line, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
refs AS (SELECT * FROM counted WHERE NOT (e>=1 AND o>=2)),
refcount AS (SELECT c.book_id, c.line_no, c.caption_no, c.content caption, c.fig, count(r.ref_line) n
  FROM c3 c LEFT JOIN refs r ON r.book_id=c.book_id AND r.line_no=c.line_no AND r.caption_no=c.caption_no GROUP BY ALL)"""


def _marked(spark, sf):
    return rf.marked_documents(fx.markdown(spark, sf))


@query(
    "c05_find_references",
    f"""WITH {REFS} SELECT book_id, line_no::BIGINT image_line, fig figure_number, ref_line::BIGINT ref_line, is_exact,
    array_to_string(labels, '|') reference_text FROM refs""",
)
def c05(spark, sf):
    return (
        rf.find_references(_marked(spark, sf))
        .where("ref_line IS NOT NULL")
        .select(
            "book_id",
            F.col("line_no").alias("image_line"),
            "figure_number",
            "ref_line",
            "is_exact",
            F.array_join("labels", "|").alias("reference_text"),
        )
    )


@query(
    "e09_take_until",
    f"""WITH {REFS} SELECT book_id, line_no::BIGINT image_line, caption_no::BIGINT caption_no, count(*) AS n_kept,
    count(*) FILTER (is_exact) AS n_exact FROM refs GROUP BY ALL""",
)
def e09(spark, sf):
    refs = rf.find_references(_marked(spark, sf)).where("ref_line IS NOT NULL")
    return refs.groupBy("book_id", F.col("line_no").alias("image_line"), "caption_no").agg(
        F.count("*").alias("n_kept"), F.count_if("is_exact").alias("n_exact")
    )


@query(
    "d25_distinct_captions",
    f"""WITH {REFS} SELECT book_id, line_no::BIGINT image_line, caption_no::BIGINT caption_no, content caption, fig figure_number FROM c3""",
)
def d25(spark, sf):
    images = _images(spark, sf)
    return images.select(
        "book_id",
        F.col("line_no").alias("image_line"),
        F.posexplode(rf.distinct_captions(F.col("captions"))).alias("caption_no", "c"),
    ).select("book_id", "image_line", "caption_no", F.col("c.content").alias("caption"), "c.figure_number")


@query(
    "d06_reference_totals",
    f"""WITH {REFS} SELECT book_id, line_no::BIGINT image_line, sum(n)::BIGINT total_reference_count, count(*) AS caption_count
    FROM refcount GROUP BY book_id, line_no""",
)
def d06(spark, sf):
    counts = rf.reference_counts(rf.find_references(_marked(spark, sf)))
    return rf.reference_totals(counts).select(
        "book_id", F.col("line_no").alias("image_line"), "total_reference_count", "caption_count"
    )


# Captions whose number ran into a year range behind it.
RUN_ON = REFS.replace("md AS (", "md0 AS (", 1).replace(
    ", lines AS (",
    ", md AS (SELECT doc_id, source, lang, book_id, regexp_replace(text, '(?m)^Figure (\\d+) ', 'Figure \\12015-2016 ', 'g') AS text FROM md0), lines AS (",
    1,
)


@query(
    "h05_repair_figure_number",
    f"""WITH {RUN_ON},
    lost AS (SELECT r.*, i.start_line, regexp_extract(i.content, '([^/]+)\\)', 1) file FROM refcount r JOIN img i USING (book_id, line_no)
             WHERE r.n=0 AND regexp_matches(r.fig, '\\d\\d\\d')),
    tried AS (SELECT *, unnest(list_filter(list_transform(range(2, length(fig)), lambda k: left(fig, k)), lambda c: regexp_matches(c, '\\d$'))) cand FROM lost),
    found AS (SELECT t.book_id, t.line_no, t.caption_no, t.fig, t.file, t.cand, count(*) n, count(*) FILTER (l.label=t.cand) n_exact
              FROM tried t JOIN labs l ON l.book_id=t.book_id AND starts_with(lower(l.label), lower(t.cand)) AND l.start_line<>t.start_line GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id, line_no, caption_no
        ORDER BY abs(CAST(regexp_replace(cand,'\\D','','g') AS HUGEINT)-CAST(regexp_replace(file,'\\D','','g') AS HUGEINT)), length(cand) DESC) k FROM found)
    SELECT book_id, line_no::BIGINT image_line, fig figure_number, cand repaired_number, n::BIGINT reference_count, n_exact::BIGINT exact_count FROM ranked WHERE k=1""",
)
def h05(spark, sf):
    docs = fx.markdown(spark, sf).withColumn(
        "text", F.regexp_replace("text", r"(?m)^Figure (\d+) ", "Figure $12015-2016 ")
    )
    marked = rf.marked_documents(docs)
    counts = rf.reference_counts(rf.find_references(marked))
    return rf.repair_figure_numbers(marked, counts).select(
        "book_id", F.col("line_no").alias("image_line"), "figure_number", "repaired_number", "reference_count", "exact_count"
    )
