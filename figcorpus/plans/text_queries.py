"""Queries of the text layer: lines, paragraphs, tags, labels, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import paragraphs as pg
from figcorpus.plans import fixtures as fx
from figcorpus.plans.registry import query, table

TAG_RE2 = r"!\[.*?\]\(\.\./images/[^/]+/([^)]+)\)"


@query(
    "b05_explode_lines",
    f"WITH {fx.MD_LINES} SELECT book_id, line_no::BIGINT AS line_no, content FROM lines",
)
def b05(spark, sf):
    return pg.explode_lines(fx.markdown(spark, sf))


@query(
    "b04_split_paragraphs",
    f"""WITH {fx.MD_PARAS} SELECT book_id, para_no::BIGINT para_no, start_line::BIGINT start_line, end_line::BIGINT end_line,
    trim(content) AS content, (end_line-start_line+1)::BIGINT n_lines FROM paras""",
)
def b04(spark, sf):
    return pg.split_paragraphs(fx.markdown(spark, sf)).withColumn("n_lines", F.size("lines")).drop("lines")


@query(
    "b06_extract_image_refs",
    f"""WITH {fx.MD_LINES} SELECT book_id, line_no::BIGINT line_no,
    unnest(regexp_extract_all(content, '{TAG_RE2}', 1)) image_filename FROM lines WHERE content LIKE '![%'""",
)
def b06(spark, sf):
    return pg.image_tags(pg.explode_lines(fx.markdown(spark, sf))).select("book_id", "line_no", "image_filename")


@query(
    "b07_figure_identifier",
    f"""WITH {fx.MD_LINES} SELECT book_id, line_no::BIGINT line_no,
    regexp_extract(content, '(?i)(Figure\\s*\\d+(?:[.-]\\d+)*|Fig\\.?\\s*\\d+(?:[.-]\\d+)*)', 1) figure_number
    FROM lines WHERE regexp_matches(content, '(?i)fig(ure|\\.?)\\s*\\d')""",
)
def b07(spark, sf):
    lines = pg.explode_lines(fx.markdown(spark, sf))
    return lines.select("book_id", "line_no", tx.figure_identifier("content").alias("figure_number")).where(
        "figure_number IS NOT NULL"
    )


@query(
    "b08_is_caption",
    f"""WITH {fx.MD_PARAS} SELECT l.book_id, l.line_no::BIGINT line_no, trim(l.content) content
    FROM lines l JOIN paras p ON l.book_id=p.book_id AND l.line_no BETWEEN p.start_line AND p.end_line
    WHERE regexp_matches(l.content, '(?i)fig(ure|\\.?)\\s*\\d')
      AND (regexp_matches(l.content, '(?i)^\\s*fig') OR regexp_matches(p.first_line, '(?i)^\\s*fig'))""",
)
def b08(spark, sf):
    lines = pg.paragraph_lines(fx.markdown(spark, sf))
    return lines.where(tx.is_caption("content", "para_first_line")).select(
        "book_id", "line_no", tx.strip("content").alias("content")
    )


@query(
    "b09_min_context",
    f"""WITH {fx.MD_PARAS}, sized AS (SELECT book_id, para_no, start_line, end_line, trim(content) c FROM paras),
    cum AS (SELECT *, coalesce(sum(length(c)+2) OVER (PARTITION BY book_id ORDER BY para_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) before FROM sized),
    target AS (SELECT * FROM cum WHERE c LIKE '%![](../images/%'),
    span AS (SELECT t.book_id, t.para_no, t.start_line, t.end_line,
        coalesce(max(CASE WHEN p.para_no<=t.para_no AND t.before-p.before>=2000 THEN p.para_no END),1) lo,
        coalesce(min(CASE WHEN p.para_no>=t.para_no AND p.before+length(p.c)-t.before-length(t.c)>=2000 THEN p.para_no END),max(p.para_no)) hi
      FROM target t JOIN cum p ON p.book_id=t.book_id GROUP BY ALL)
    SELECT s.book_id, s.para_no::BIGINT para_no, s.start_line::BIGINT start_line, s.end_line::BIGINT end_line,
      string_agg(p.c, chr(10)||chr(10) ORDER BY p.para_no) context
    FROM span s JOIN cum p ON p.book_id=s.book_id AND p.para_no BETWEEN s.lo AND s.hi GROUP BY ALL""",
)
def b09(spark, sf):
    return pg.paragraph_contexts(fx.markdown(spark, sf), tx.IMAGE_TAG, 4000)


@query(
    "b10_char_window",
    f"""WITH {fx.MD}, cut AS (SELECT book_id, text, string_split(text, '![](') ps FROM md),
    pos AS (SELECT book_id, text, ps, unnest(range(1, len(ps))) image_no FROM cut),
    pos2 AS (SELECT book_id, text, image_no, string_split(ps[image_no+1], ')')[1] path,
        (list_sum(list_transform(ps[1:image_no], lambda p: length(p)+4))-3)::BIGINT AS s FROM pos)
    SELECT book_id, image_no::BIGINT image_no, path,
      substring(text, greatest(1, s-2000), s+2000-greatest(1, s-2000)) AS context FROM pos2""",
)
def b10(spark, sf):
    return pg.image_char_windows(fx.markdown(spark, sf))


@query(
    "b11_chunk_text",
    """SELECT doc_id, k::BIGINT chunk_no, substring(text, k*1000+1, 1000) chunk
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text)/1000.0) AS BIGINT))) k FROM documents)""",
)
def b11(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(tx.chunks("text", 1000)).alias("chunk_no", "chunk"))


@query(
    "b31_head_tail",
    "SELECT doc_id, left(text, 200)||right(text, 200) AS snippet FROM documents",
)
def b31(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.head_tail("text", 200).alias("snippet"))


@query(
    "c03_image_paragraph",
    f"""WITH {fx.MD_PARAS} SELECT l.book_id, l.line_no::BIGINT line_no, p.para_no::BIGINT para_no,
    p.start_line::BIGINT para_start, p.end_line::BIGINT para_end
    FROM lines l JOIN paras p ON l.book_id=p.book_id AND l.line_no BETWEEN p.start_line AND p.end_line
    WHERE regexp_matches(l.content, '{TAG_RE2}')""",
)
def c03(spark, sf):
    tags = pg.image_tags(pg.paragraph_lines(fx.markdown(spark, sf)))
    return tags.select("book_id", "line_no", "para_no", "para_start", "para_end")


@query(
    "c04_caption_paragraph",
    f"""WITH {fx.MD_PARAS} SELECT l.book_id, l.line_no::BIGINT line_no, p.para_no::BIGINT para_no, trim(p.first_line) para_first_line
    FROM lines l JOIN paras p ON l.book_id=p.book_id AND l.line_no BETWEEN p.start_line AND p.end_line
    WHERE regexp_matches(l.content, '(?i)fig(ure|\\.?)\\s*\\d')""",
)
def c04(spark, sf):
    lines = pg.paragraph_lines(fx.markdown(spark, sf)).where(tx.matches_caption("content"))
    return lines.select("book_id", "line_no", "para_no", tx.strip("para_first_line").alias("para_first_line"))
