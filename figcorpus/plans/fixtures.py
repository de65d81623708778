"""Inputs of the curation operators, derived from the given tables; each has a SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.plans.registry import table
from figcorpus.session import spread


def _line_rule(i: str, nl: str) -> str:
    """How line x with 0-based index i of a document becomes a line of the marked-up one."""
    return f"""
    CASE WHEN {i}=0 THEN '' WHEN ({i}+doc_id)%8=2 AND doc_id%4<>3 THEN {nl} ELSE {nl}||{nl} END ||
    CASE WHEN ({i}+doc_id)%8=1 OR (({i}+doc_id)%8=3 AND doc_id%4=2)
           THEN '![](../images/'||lpad(CAST(doc_id AS VARCHAR(20)),6,'0')||'/'||lpad(CAST({i}+1 AS VARCHAR(20)),6,'0')||'.jpg)'
         WHEN ({i}+doc_id)%8=2 AND doc_id%4<>3 THEN 'Figure '||CAST({i} AS VARCHAR(20))||' '||x
         WHEN ({i}+doc_id)%8=5 THEN x||' (see Figure '||CAST({i}-3 AS VARCHAR(20))||')'
         WHEN ({i}+doc_id)%8=6 THEN x||' unlike Figure '||CAST({i}-4 AS VARCHAR(20))||'9'
         ELSE x END"""


MARKDOWN_SQL = f"""
SELECT doc_id, source, lang, lpad(CAST(doc_id AS VARCHAR(20)),6,'0') book_id,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: {_line_rule('(j-1)', 'chr(10)')}), '') AS text
FROM documents"""


def mark_up(docs: DataFrame) -> DataFrame:
    """Documents with image tags, captions and references planted between their lines."""
    rule = _line_rule("i", "'\\n'").replace("VARCHAR(20)", "STRING")
    return docs.selectExpr(
        "doc_id",
        "source",
        "lang",
        "lpad(CAST(doc_id AS STRING),6,'0') AS book_id",
        f"array_join(transform(split(text,'\\n'),(x,i)->{rule}),'') AS text",
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_up(spread(table(spark, sf_dir, "documents")))


# Lines and paragraphs of the marked-up documents, for the SQL side.
LINES_SQL = """
SELECT doc_id, source, book_id, n_lines, line_no, content,
  sum(CASE WHEN content = '' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY line_no) AS gap_no
FROM (
  SELECT doc_id, source, book_id, len(string_split(text, chr(10))) AS n_lines,
    unnest(string_split(text, chr(10))) AS content,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
  FROM md)"""

PARAS_SQL = """
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY gap_no) AS para_no, gap_no,
  min(line_no) AS start_line, max(line_no) AS end_line,
  string_agg(content, chr(10) ORDER BY line_no) AS content,
  arg_min(content, line_no) AS first_line
FROM lines WHERE trim(content, chr(32)||chr(9)||chr(13)) <> '' GROUP BY book_id, gap_no"""

MD = f"md AS ({MARKDOWN_SQL})"
MD_LINES = f"{MD}, lines AS ({LINES_SQL})"
MD_PARAS = f"{MD_LINES}, paras AS ({PARAS_SQL})"

_SCREEN_SQL = """
SELECT lpad(CAST(CAST(FLOOR(p_partkey/50) AS INT) AS {s}),6,'0') book_id, lpad(CAST(p_partkey%50+1 AS {s}),6,'0') image_id,
  CASE WHEN p_partkey%97=0 THEN 'null' WHEN (p_partkey*7919+p_size*31)%10>=5 THEN 'yes' ELSE 'no' END is_compliant,
  CASE WHEN p_partkey%97=0 THEN '-1' WHEN p_partkey%89=0 THEN 'n/a' ELSE CAST((p_partkey*7919+p_size*31)%10+1 AS {s}) END compliance_level,
  CASE WHEN p_partkey%83=0 THEN NULL ELSE CAST((p_partkey*104729+p_size)%10 AS {s}) END complexity_level,
  {open}CAST((p_partkey*13+p_size)%17+1 AS INT), CAST((p_partkey*29+p_size*5)%17+1 AS INT){close} content_theme,
  {open}CAST(p_size%11+1 AS INT){close} chart_type
FROM part"""
SCREEN_SQL = _SCREEN_SQL.format(s="VARCHAR", open="[", close="]")

_EVAL_SQL = """
SELECT o_orderkey sample_id, o_orderpriority model, CAST(o_custkey%6 AS INT) cap, chr(CAST(65+o_orderkey%4 AS INT)) gold,
  CASE WHEN (o_orderkey*7)%11=0 THEN 'error: timeout' WHEN (o_orderkey*7)%11=1 THEN 'The answer is B' WHEN (o_orderkey*7)%11=2 THEN NULL
       WHEN (o_orderkey*7)%11<6 THEN ' '||lower(chr(CAST(65+o_orderkey%4 AS INT)))||' '
       ELSE chr(CAST(65+(o_orderkey*5+o_custkey)%4 AS INT)) END raw_answer
FROM orders"""
EVAL_SQL = _EVAL_SQL

TREE_SQL = """
SELECT CAST(p_partkey%40 AS INT) fq_no, CAST(FLOOR(p_partkey/40) AS INT) question_node_no,
  CASE WHEN p_partkey<40 THEN -1 ELSE CAST(FLOOR((FLOOR(p_partkey/40)-1)/3) AS INT) END parent_node_no,
  p_size+1 visit_count, CAST(p_partkey%(p_size+2) AS INT) victory_count
FROM part"""

_ABBR_SQL = """
SELECT p_partkey, p_brand book_id, full_form, ini, full_form||' Index ('||ini||') rose; '||ini||' of the '||p_brand||' fell' txt FROM (
  SELECT p_partkey, p_brand,
    upper(left(p_name,1))||substring(split_part(p_name,' ',1),2)||' '||upper(left(split_part(p_name,' ',2),1))||substring(split_part(p_name,' ',2),2) full_form,
    upper(left(p_name,1))||upper(left(split_part(p_name,' ',2),1))||'I' ini FROM part) q"""
ABBR_SQL = _ABBR_SQL

BARS_SQL = """
SELECT o_orderpriority symbol, CAST(o_orderdate AS DATE) trade_date, min_by(o_totalprice,o_orderkey) open, max(o_totalprice) high,
       min(o_totalprice) low, max_by(o_totalprice,o_orderkey) close, CAST(count(*) AS DOUBLE) vol
FROM orders GROUP BY 1,2"""


def _run(spark, sf_dir, name, sql):
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=spread(table(spark, sf_dir, name)))


def screen(spark, sf_dir):
    return _run(spark, sf_dir, "part", _SCREEN_SQL.format(s="STRING", open="array(", close=")"))


def evals(spark, sf_dir):
    return _run(spark, sf_dir, "orders", _EVAL_SQL)


def tree(spark, sf_dir):
    return _run(spark, sf_dir, "part", TREE_SQL)


def abbr_texts(spark, sf_dir):
    return _run(spark, sf_dir, "part", _ABBR_SQL)


def bars(spark, sf_dir):
    return _run(spark, sf_dir, "orders", BARS_SQL)




def with_options(df: DataFrame) -> DataFrame:
    """The four options of the evaluation questions."""
    return df.withColumn(
        "options",
        F.create_map(
            *[F.lit(v) for kv in (("A", "rises"), ("B", "falls"), ("C", "stays flat"), ("D", "cannot be told")) for v in kv]
        ),
    )
