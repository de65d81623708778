"""Queries of abbreviations, context strings, prompts and document cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import prompts as pr
from figcorpus.functions import text as tx
from figcorpus.operators import abbreviations as ab
from figcorpus.operators import references as rf
from figcorpus.plans import fixtures as fx
from figcorpus.plans.figure_queries import NEAR, REFS
from figcorpus.plans.registry import query, table
from figcorpus.session import spread

ABBR = f"""ab AS ({fx.ABBR_SQL}),
tab AS (SELECT book_id, ini abbreviation, arg_min(full_form||' Index', p_partkey) full_form, min(p_partkey) first_key FROM ab GROUP BY ALL)"""


def _table(spark, sf):
    return ab.build_table(fx.abbr_texts(spark, sf), "txt", order=("p_partkey",))


@query("d16_build_abbr_table", f"WITH {ABBR} SELECT book_id, abbreviation, full_form, first_key FROM tab")
def d16(spark, sf):
    return _table(spark, sf).select(
        "book_id", "abbreviation", "full_form", F.col("first_pos.p_partkey").alias("first_key")
    )


@query(
    "b14_expand_abbr",
    f"""WITH {ABBR} SELECT a.p_partkey, a.full_form||' Index ('||a.ini||' ('||t.full_form||')) rose; '||a.ini||' ('||t.full_form||') of the '||a.book_id||' fell' expanded
    FROM ab a JOIN tab t ON t.book_id=a.book_id AND t.abbreviation=a.ini""",
)
def b14(spark, sf):
    texts = fx.abbr_texts(spark, sf).select("p_partkey", "book_id", "txt")
    return ab.expand_texts(texts, _table(spark, sf), "txt", ["p_partkey"]).select("p_partkey", "expanded")


# Texts of suppliers' nations and of brands: only the brands have tables.
TEXTS = """txts AS (SELECT p_partkey AS id, book_id, txt FROM ab UNION ALL
  SELECT -1-s_suppkey, 'Nation#'||CAST(s_nationkey AS VARCHAR), 'ABC of '||s_name FROM supplier)"""


@query(
    "c08_join_abbr_text",
    f"""WITH {ABBR}, {TEXTS} SELECT x.id, x.book_id, CASE WHEN t.full_form IS NULL THEN x.txt
      ELSE regexp_replace(x.txt, '\\b'||t.abbreviation||'\\b', t.abbreviation||' ('||t.full_form||')', 'g') END expanded
    FROM txts x LEFT JOIN ab a ON a.p_partkey=x.id LEFT JOIN tab t ON t.book_id=a.book_id AND t.abbreviation=a.ini""",
)
def c08(spark, sf):
    brands = fx.abbr_texts(spark, sf).select(F.col("p_partkey").alias("id"), "book_id", "txt")
    nations = table(spark, sf, "supplier").selectExpr(
        "-1-s_suppkey AS id", "concat('Nation#', CAST(s_nationkey AS STRING)) AS book_id", "concat('ABC of ', s_name) AS txt"
    )
    texts = brands.unionByName(nations)
    return ab.expand_texts(texts, _table(spark, sf), "txt", ["id"]).select("id", "book_id", "expanded")


def _acronyms(spark, sf):
    """Acronyms seen in images: the part's own initials and one that no table holds."""
    images = fx.abbr_texts(spark, sf).select(
        F.col("p_partkey").alias("id"), "book_id", F.array("ini", F.lit("ZZZZ"), "ini").alias("acronyms")
    )
    nations = table(spark, sf, "supplier").selectExpr(
        "-1-s_suppkey AS id", "concat('Nation#', CAST(s_nationkey AS STRING)) AS book_id", "array('ABC') AS acronyms"
    )
    return images.unionByName(nations)


@query(
    "c09_match_acronyms",
    f"WITH {ABBR} SELECT a.p_partkey id, a.book_id, a.ini||'='||t.full_form matched FROM ab a JOIN tab t ON t.book_id=a.book_id AND t.abbreviation=a.ini",
)
def c09(spark, sf):
    out = ab.match_acronyms(_acronyms(spark, sf), _table(spark, sf), ["id"])
    pairs = F.transform(F.map_entries("matched_expansions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("id", "book_id", F.array_join(pairs, ";").alias("matched"))


def _summaries(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(
            F.col("p_size") % 3 == 0,
            F.concat(F.lit("The path of this image is: [x].\n\nAbout "), "p_name"),
        )
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("The path of this image is: [x]. About "), "p_name"))
        .otherwise(F.col("p_name"))
        .alias("contextual_information"),
    )


SUMMARIES = """sums AS (SELECT p_partkey id, p_size, p_name, chr(10)||'Acronyms found in the image and their expansions:'||chr(10)||'- '||a.ini||': '||t.full_form||chr(10) block
  FROM part JOIN ab a USING (p_partkey) JOIN tab t ON t.book_id=a.book_id AND t.abbreviation=a.ini)"""


@query(
    "b15_insert_block",
    f"""WITH {ABBR}, {SUMMARIES} SELECT id, CASE p_size%3 WHEN 0 THEN 'The path of this image is: [x].'||chr(10)||block||chr(10)||'About '||p_name
      WHEN 1 THEN 'The path of this image is: [x]. About '||p_name||block ELSE p_name||block END contextual_information FROM sums""",
)
def b15(spark, sf):
    matched = ab.match_acronyms(_acronyms(spark, sf), _table(spark, sf), ["id"])
    good, _ = ab.join_expansions(_summaries(spark, sf), matched, ["id"])
    return good.select("id", "contextual_information")


@query(
    "c10_join_expansions_context",
    """SELECT p_partkey id, 'context missing' error FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)""",
)
def c10(spark, sf):
    """Images whose context is missing: only parts numbered like a document have one."""
    contexts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("contextual_information")
    )
    matched = ab.match_acronyms(_acronyms(spark, sf), _table(spark, sf), ["id"])
    _, lost = ab.join_expansions(contexts, matched, ["id"])
    return lost.select("id", "error")


# ---- cleaning --------------------------------------------------------------------------

# Headed documents: a directory between two parts of the text, with and without a heading behind it.
HEADED_SQL = """SELECT doc_id, CASE doc_id%4 WHEN 0 THEN text WHEN 1 THEN text||chr(10)||'# List of Figures'||chr(10)||'Figure 1 ... 3'||chr(10)||'# Next part'||chr(10)||'Fig. 1o and 2一3 by '||lang
  WHEN 2 THEN 'Front matter'||chr(10)||'## 图目录'||chr(10)||text ELSE '# SUMMARY'||chr(10)||'short'||chr(10)||'# Index of Charts'||chr(10)||text END AS text FROM documents"""


def _headed(spark, sf):
    return spark.sql(
        HEADED_SQL.replace("chr(10)", "'\\n'").replace("FROM documents", "FROM {t}"), t=spread(table(spark, sf, "documents"))
    )


@query(
    "b02_drop_section",
    f"""WITH h AS ({HEADED_SQL}), x AS (SELECT doc_id, text, CASE doc_id%4 WHEN 1 THEN strpos(text, '# List of Figures') WHEN 2 THEN strpos(text,'# 图目录')
        WHEN 3 THEN strpos(text,'# Index of Charts') ELSE 0 END s FROM h),
      y AS (SELECT *, strpos(substring(text, s+1), chr(10)||'#') k FROM x)
    SELECT doc_id, CASE WHEN s=0 THEN text ELSE trim(CASE WHEN k>0 THEN left(text, s-1)||substring(text, s+k) ELSE left(text, s-1) END, ' '||chr(9)||chr(10)||chr(13)) END AS text FROM y""",
)
def b02(spark, sf):
    return _headed(spark, sf).select("doc_id", tx.drop_section("text").alias("text"))


@query(
    "b01_clean_html_tables",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?i)<(t[dh])([0-9. ])', '<\1>\2', 'g') h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(td|th)[^>]*>', chr(10), 'g'), '(?i)</?(table|tr|tbody|thead|tfoot)[^>]*>', '', 'g') h FROM a),
    c AS (SELECT page_id, regexp_replace(h, '(?i)\s*(rowspan|colspan|style|class|width|height|align|valign|border|cellpadding|cellspacing)\s*=\s*"[^"]*"', '', 'g') h FROM b),
    d AS (SELECT page_id, regexp_replace(h, '(?i)\s*(rowspan|colspan|style|class|width|height|align|valign|border|cellpadding|cellspacing)\s*=\s*''[^'']*''', '', 'g') h FROM c)
    SELECT page_id, trim(regexp_replace(regexp_replace(h, '[ \t]+', ' ', 'g'), '\n\s*\n', chr(10)||chr(10), 'g'), ' '||chr(9)||chr(10)||chr(13)) AS text FROM d""",
)
def b01(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.clean_html_tables("html").alias("text"))


@query(
    "b03_fix_ocr_digits",
    r"""SELECT doc_id, 'Figure '||doc_id||'0 and fig. '||doc_id||'0, 图'||doc_id||'0 of '||doc_id||'-'||doc_id||'; '||regexp_replace(text, '([Ff]ig(ure|\.?)\s*\d+)[oO]', '\10', 'g') AS text FROM documents""",
)
def b03(spark, sf):
    t = F.expr(
        "concat('Figure ', doc_id, 'o and fig. ', doc_id, 'O, 图', doc_id, 'o of ', doc_id, '一', doc_id, '; ', text)"
    )
    return table(spark, sf, "documents").select("doc_id", tx.fix_ocr_digits(t).alias("text"))


# The cleaning that stands in front of the figure queries, over headed documents with a table behind: directory, markup, digits.
CLEAN_SQL = r"""x AS (SELECT doc_id, text, CASE doc_id%4 WHEN 1 THEN strpos(text, '# List of Figures') WHEN 2 THEN strpos(text,'# 图目录') WHEN 3 THEN strpos(text,'# Index of Charts') ELSE 0 END s FROM tabled),
y AS (SELECT *, strpos(substring(text, s+1), chr(10)||'#') k FROM x),
kept AS (SELECT doc_id, CASE WHEN s=0 THEN text ELSE trim(CASE WHEN k>0 THEN left(text, s-1)||substring(text, s+k) ELSE left(text, s-1) END, ' '||chr(9)||chr(10)||chr(13)) END t FROM y),
t1 AS (SELECT doc_id, regexp_replace(t, '(?i)<(t[dh])([0-9. ])', '<\1>\2', 'g') t FROM kept),
t2 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)</?(td|th)[^>]*>', chr(10), 'g'), '(?i)</?(table|tr|tbody|thead|tfoot)[^>]*>', '', 'g') t FROM t1),
t3 AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n', chr(10)||chr(10), 'g'), ' '||chr(9)||chr(10)||chr(13)) t FROM t2),
t4 AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([Ff]ig(ure|\.?)\s*\d+)[oO]', '\10', 'g'), '(图\s*\d+)[oO]', '\10', 'g') t FROM t3),
cleaned AS (SELECT doc_id, regexp_replace(t, '(\d)一(\d)', '\1-\2', 'g') AS text FROM t4)"""


def _tabled(spark, sf):
    table_ = "<table><tr><td>Figure 1o</td><td 2>图2O or 图3一4</td></tr></table>"
    return _headed(spark, sf).withColumn("text", F.concat("text", F.lit("\n\n" + table_)))


TABLED_SQL = f"tabled AS (SELECT doc_id, text||chr(10)||chr(10)||'<table><tr><td>Figure 1o</td><td 2>图2O or 图3一4</td></tr></table>' AS text FROM ({HEADED_SQL}))"


@query("b02_clean_document", f"WITH {TABLED_SQL}, {CLEAN_SQL} SELECT doc_id, text FROM cleaned")
def b02_clean(spark, sf):
    return _tabled(spark, sf).select("doc_id", tx.clean_document("text").alias("text"))


@query(
    "b07_cleaned_labels",
    f"""WITH {TABLED_SQL}, {CLEAN_SQL} SELECT doc_id, label, count(*) n FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(图\\s*[a-zA-Z]?\\s*\\d+(?:[.-]\\d+)*|Figure\\s*\\d+(?:[.-]\\d+)*|Fig\\.?\\s*\\d+(?:[.-]\\d+)*)', 1)) label FROM cleaned) GROUP BY ALL""",
)
def b07_cleaned(spark, sf):
    """Figure labels, in both scripts, as they read once the documents are cleaned."""
    labels = _tabled(spark, sf).select("doc_id", F.explode(tx.figure_labels(tx.clean_document("text"))).alias("label"))
    return labels.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


TRIM_ENDS = "['.','?','!','。','？','！']"


def _trim_sql(n: int, source: str = "documents", ids: str = "doc_id") -> str:
    """The trimming rule in plain SQL, one CTE per step, ending in ``trimmed``."""
    before = f"list_max(list_transform({TRIM_ENDS}, lambda e: CASE WHEN strpos(reverse(left(text, {{a}})), e)>0 THEN {{a}}-strpos(reverse(left(text, {{a}})), e) ELSE -1 END))"
    after = f"list_min(list_filter(list_transform({TRIM_ENDS}, lambda e: CASE WHEN strpos(substring(text, {{b}}+1), e)>0 THEN {{b}}+strpos(substring(text, {{b}}+1), e)-1 END), lambda p: p IS NOT NULL))"

    def snap(a, b):
        lo = before.format(a=a)
        hi = after.format(b=b)
        return (
            f"CASE WHEN {lo}<>-1 AND {a}-({lo})<200 THEN ({lo})+1 ELSE {a} END",
            f"CASE WHEN ({hi}) IS NOT NULL AND ({hi})-{b}<200 THEN ({hi})+1 ELSE {b} END",
        )

    lo1, hi1 = snap("a0", "b0")
    lo2, hi2 = snap("a2", "b2")
    return f"""s0 AS (SELECT {ids}, text, length(text) n, length(text)//2 m, greatest(0, length(text)//2-{n // 2}-200) a0, least(length(text), length(text)//2+{n // 2}+200) b0 FROM {source}),
    s1 AS (SELECT *, {lo1} a1, {hi1} b1 FROM s0),
    s2 AS (SELECT *, list_filter(list_transform({TRIM_ENDS}, lambda e: CASE WHEN strpos(substring(text, greatest(0,m-100)+1, m+100-greatest(0,m-100)), e)>0
        THEN greatest(0,m-100)+strpos(substring(text, greatest(0,m-100)+1, m+100-greatest(0,m-100)), e)-1 END), lambda p: p IS NOT NULL) near FROM s1),
    s3 AS (SELECT *, list_filter(near, lambda p: abs(p-m)=list_min(list_transform(near, lambda q: abs(q-m))))[1] anchor FROM s2),
    s4 AS (SELECT *, greatest(0, anchor-{n // 2}) a2, least(n, anchor+{n // 2}) b2 FROM s3),
    s5 AS (SELECT {ids}, text, n, CASE WHEN b1-a1>{n} AND anchor IS NOT NULL THEN {lo2} ELSE a1 END lo, CASE WHEN b1-a1>{n} AND anchor IS NOT NULL THEN {hi2} ELSE b1 END hi FROM s4),
    trimmed AS (SELECT {ids}, CASE WHEN n<={n} THEN text ELSE trim(substring(text, lo+1, hi-lo), ' '||chr(9)||chr(10)||chr(13)) END AS trimmed FROM s5)"""


@query("b12_trim_to_sentences", "WITH " + _trim_sql(1000) + " SELECT * FROM trimmed")
def b12(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", tx.trim_to_sentences("text", 1000).alias("trimmed"))


@query(
    "b13_is_chinese",
    """SELECT doc_id, (length(regexp_replace(t, '\\s', '', 'g'))>0 AND len(regexp_extract_all(t, '[一-鿿]'))::DOUBLE/greatest(length(regexp_replace(t, '\\s', '', 'g')),1) >= 0.3) is_chinese
    FROM (SELECT doc_id, CASE WHEN doc_id%3=0 THEN repeat('图表显示收入增长', 1+CAST(length(text)//8 AS INT))||text ELSE text END t FROM documents)""",
)
def b13(spark, sf):
    t = F.expr(
        "CASE WHEN doc_id%3=0 THEN concat(repeat('图表显示收入增长', 1+CAST(length(text) div 8 AS INT)), text) ELSE text END"
    )
    return table(spark, sf, "documents").select("doc_id", tx.is_chinese(t).alias("is_chinese"))


# ---- context strings and prompts -----------------------------------------------------------


def _image_rows(spark, sf):
    """One row per image with the texts of its first references, from the nested records."""
    r = rf.context_records(fx.markdown(spark, sf), every=False)
    return r.withColumn(
        "references",
        F.flatten(F.transform("caption_references", lambda c: c["references"])),
    )


def _around_sql(name: str, target: str, k: int) -> str:
    """Context of k characters around the paragraphs of a target table, as CTEs."""
    return f"""{name}_t AS (SELECT t.*, p.para_no, p.before, p.c FROM {target} t JOIN cum p ON p.book_id=t.book_id AND t.at BETWEEN p.start_line AND p.end_line),
    {name}_s AS (SELECT t.book_id, t.line_no, coalesce(max(CASE WHEN p.para_no<=t.para_no AND t.before-p.before>={k // 2} THEN p.para_no END),1) lo,
        coalesce(min(CASE WHEN p.para_no>=t.para_no AND p.before+length(p.c)-t.before-length(t.c)>={k // 2} THEN p.para_no END),max(p.para_no)) hi
      FROM {name}_t t JOIN cum p ON p.book_id=t.book_id GROUP BY t.book_id, t.line_no, t.para_no, t.before, t.c),
    {name} AS (SELECT s.book_id, s.line_no, '{name}' kind, string_agg(p.c, chr(10)||chr(10) ORDER BY p.para_no) AS text
      FROM {name}_s s JOIN cum p ON p.book_id=s.book_id AND p.para_no BETWEEN s.lo AND s.hi GROUP BY s.book_id, s.line_no)"""


SIZED = """sized AS (SELECT book_id, para_no, start_line, end_line, trim(content) c FROM paras),
cum AS (SELECT *, coalesce(sum(length(c)+2) OVER (PARTITION BY book_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) before FROM sized),
shown AS (SELECT book_id, line_no, line_no AS at FROM img)"""

# Nested records, one row per reference of a caption; captions and images without any keep a row.
RECORDS = f"""WITH {REFS}, {SIZED},
cited AS (SELECT DISTINCT book_id, ref_line AS line_no, ref_line AS at FROM refs),
{_around_sql('surround', 'shown', 4000)}, {_around_sql('wide', 'cited', 1000)},
totals AS (SELECT book_id, line_no, sum(n) total FROM refcount GROUP BY ALL)
SELECT c.book_id, c.line_no::BIGINT line_no, c.classification, c.caption_count::BIGINT caption_count, c.other_count::BIGINT other_count,
  md5(s.text) surround, k.caption, k.fig figure_number, k.n::BIGINT reference_count, coalesce(t.total,0)::BIGINT total_reference_count,
  r.ref_line::BIGINT ref_line, r.is_exact, array_to_string(r.labels, '|') reference_text, md5(p.c) paragraph, md5(w.text) extension
FROM classed c JOIN surround s USING (book_id, line_no) LEFT JOIN totals t USING (book_id, line_no)
LEFT JOIN refcount k ON k.book_id=c.book_id AND k.line_no=c.line_no
LEFT JOIN refs r ON r.book_id=k.book_id AND r.line_no=k.line_no AND r.caption_no=k.caption_no
LEFT JOIN wide w ON w.book_id=r.book_id AND w.line_no=r.ref_line
LEFT JOIN cum p ON p.book_id=r.book_id AND r.ref_line BETWEEN p.start_line AND p.end_line"""


@query("a06_context_records", RECORDS)
def a06(spark, sf):
    """The nested records, their captions and references laid out in rows, long texts as digests."""
    r = rf.context_records(fx.markdown(spark, sf))
    image = ["book_id", F.col("image_tag_line_number").alias("line_no"), "classification", "caption_count", "total_reference_count"]
    captions = r.select(
        *image,
        F.col("other_images_nearby.count").alias("other_count"),
        F.md5("image_surround_text").alias("surround"),
        F.explode_outer("caption_references").alias("k"),
    )
    return captions.withColumn("r", F.explode_outer("k.references")).select(
        *[c for c in captions.columns if c != "k"],
        "k.caption",
        "k.figure_number",
        "k.reference_count",
        F.col("r.match_line_info.line_number").alias("ref_line"),
        F.col("r.is_exact_match").alias("is_exact"),
        F.array_join("r.reference_text", "|").alias("reference_text"),
        F.md5("r.reference_paragraph").alias("paragraph"),
        F.md5("r.reference_paragraph_extension").alias("extension"),
    )


@query(
    "a06_context_captions",
    f"""WITH {NEAR}, {SIZED}, capt AS (SELECT DISTINCT book_id, hit_line AS line_no, hit_line AS at FROM caps), {_around_sql('near', 'capt', 500)}
    SELECT c.book_id, c.line_no::BIGINT line_no, c.hit_line::BIGINT caption_line, c.content, c.d::BIGINT distance, md5(n.text) content_paragraph
    FROM caps c JOIN near n ON n.book_id=c.book_id AND n.line_no=c.hit_line""",
)
def a06_captions(spark, sf):
    """The captions that nested records list, with what stands around them."""
    r = rf.context_records(fx.markdown(spark, sf))
    found = r.select("book_id", F.col("image_tag_line_number").alias("line_no"), F.explode("captions_found").alias("c"))
    return found.select(
        "book_id", "line_no", F.col("c.line_number").alias("caption_line"), "c.content", "c.distance", F.md5("c.content_paragraph").alias("content_paragraph")
    )


ASSEMBLE = f"""WITH {REFS}, {SIZED},
exact AS (SELECT book_id, line_no, min(ref_line) AS at FROM refs WHERE is_exact GROUP BY ALL),
{_around_sql('surround', 'shown', 4000)}, {_around_sql('wide', 'exact', 1000)},
ctx AS (SELECT * FROM surround UNION ALL SELECT * FROM wide),
{_trim_sql(4000, 'ctx', 'book_id, line_no, kind')},
files AS (SELECT book_id, line_no, regexp_extract(content, '([^/]+)\\)', 1) file FROM img),
parts AS (SELECT c.book_id, c.line_no, c.classification, c.nearest_caption, 'The path of this image is: [images/'||c.book_id||'/'||f.file||'].' head,
    chr(10)||chr(10)||'The context surrounding this image is as follows: '||s.trimmed around, w.trimmed wide
  FROM classed c JOIN files f USING (book_id, line_no) JOIN trimmed s ON s.book_id=c.book_id AND s.line_no=c.line_no AND s.kind='surround'
  LEFT JOIN trimmed w ON w.book_id=c.book_id AND w.line_no=c.line_no AND w.kind='wide'),
built AS (SELECT *, CASE WHEN classification='normal' THEN head||chr(10)||chr(10)||'The caption for this image is: '||nearest_caption||
      CASE WHEN wide IS NOT NULL THEN chr(10)||chr(10)||'This image is referenced in the following content:- '||wide ELSE around END
    ELSE head||' Refer to the context below to locate where this image appears in the document.'||around END t FROM parts)
SELECT book_id, line_no::BIGINT line_no, CASE WHEN length(t)<500 AND t NOT LIKE '%The context surrounding this image is as follows: %' THEN t||around ELSE t END contextual_information FROM built"""


@query("b16_assemble_context", ASSEMBLE)
def b16(spark, sf):
    rows = _image_rows(spark, sf)
    path = F.concat(F.lit("images/"), "book_id", F.lit("/"), "image_filename")
    return rows.select(
        "book_id",
        F.col("image_tag_line_number").alias("line_no"),
        pr.assemble_context("classification", path, "nearest_caption", "references", "image_surround_text").alias(
            "contextual_information"
        ),
    )


PROMPT_CONTEXT = ASSEMBLE[: ASSEMBLE.index("ctx AS (SELECT * FROM surround")] + """
first AS (SELECT book_id, line_no, arg_min(is_exact, (caption_no, ref_line, k)) is_exact, arg_min(ref_line, (caption_no, ref_line, k)) ref_line FROM refs GROUP BY ALL)
SELECT c.book_id, c.line_no::BIGINT line_no, CASE
    WHEN c.classification='normal' AND f.is_exact THEN 'Context Information:'||chr(10)||'Caption: '||c.nearest_caption||chr(10)||'Reference Text: '||trim(p.content)||chr(10)||chr(10)
    WHEN c.classification='normal' AND f.is_exact IS NOT NULL THEN ''
    ELSE 'Context Information:'||chr(10)||'Surrounding Text: '||s.text||chr(10)||chr(10) END prompt_context
FROM classed c JOIN surround s USING (book_id, line_no) LEFT JOIN first f USING (book_id, line_no)
LEFT JOIN paras p ON p.book_id=c.book_id AND f.ref_line BETWEEN p.start_line AND p.end_line"""


@query("b17_select_prompt_context", PROMPT_CONTEXT)
def b17(spark, sf):
    return _image_rows(spark, sf).select(
        "book_id",
        F.col("image_tag_line_number").alias("line_no"),
        pr.select_prompt_context("classification", "nearest_caption", "caption_references", "image_surround_text").alias(
            "prompt_context"
        ),
    )


ASK = "select the correct option. Output ONLY the single letter corresponding to your choice (A, B) with no additional text, explanations, or formatting. For example, if the answer is ''A'', you must only output: A."


@query(
    "b18_build_prompt",
    f"""WITH g AS (SELECT unnest(['image_background_only','analysis_information_only','both_contexts','no_context']) grp)
    SELECT p_partkey, grp AS "group",
      CASE WHEN grp IN ('image_background_only','both_contexts') THEN 'image_background: '||p_type||repeat(chr(10),5) ELSE '' END ||
      CASE WHEN grp IN ('analysis_information_only','both_contexts') THEN 'analysis_information: '||p_brand||repeat(chr(10),5) ELSE '' END ||
      'question: '||p_name||repeat(chr(10),5)||'options: {{"A": "'||p_brand||'", "B": "'||p_type||'"}}'||repeat(chr(10),5)||
      CASE WHEN grp='no_context' THEN 'Based on the image, ' ELSE 'Based on the image and the provided information, ' END||'{ASK}' prompt
    FROM part, g""",
)
def b18(spark, sf):
    parts = table(spark, sf, "part").withColumn("group", F.explode(F.array(*[F.lit(g) for g in pr.GROUPS])))
    options = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"))
    return parts.select(
        "p_partkey", "group", pr.build_prompt("group", "p_type", "p_brand", "p_name", options).alias("prompt")
    )


@query(
    "b33_default_fields",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR),'None') image_background, coalesce(CAST(l.toxic AS VARCHAR),'None') analysis_information FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def b33(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels").select(
            "doc_id",
            F.col("quality").cast("string").alias("image_background"),
            F.col("toxic").cast("string").alias("analysis_information"),
        ),
        "doc_id",
        "left",
    )
    return rows.select("doc_id", *pr.default_fields("image_background", "analysis_information"))
