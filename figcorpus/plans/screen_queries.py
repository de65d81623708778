"""Queries of screening, routing, statistics and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import parsing as ps
from figcorpus.functions import text as tx
from figcorpus.functions.draws import draw_sql
from figcorpus.operators import proximity as px
from figcorpus.operators import ranking as rk
from figcorpus.operators import screening as sc
from figcorpus.plans import fixtures as fx
from figcorpus.plans.figure_queries import NEAR
from figcorpus.plans.registry import query, table

SCREEN = f"""scr AS ({fx.SCREEN_SQL}),
lev AS (SELECT book_id, image_id, is_compliant, TRY_CAST(compliance_level AS INT) compliance_level,
  TRY_CAST(complexity_level AS INT) complexity_level, content_theme, chart_type FROM scr)"""


def screened(spark, sf):
    df = fx.screen(spark, sf)
    return df.withColumn("compliance_level", tx.to_int("compliance_level")).withColumn(
        "complexity_level", tx.to_int("complexity_level")
    )


# ---- resume, routing, joins ------------------------------------------------------------


@query("a11_pending", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a11(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return sc.pending(docs, table(spark, sf, "labels"), ["doc_id"])


@query("a11_pending_by_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def a11_filter(spark, sf):
    """Few orders are done: those with a line of a large quantity."""
    done = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return sc.pending_by_filter(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query(
    "a12_pending_groups",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN
    (SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""",
)
def a12(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sc.pending_groups(orders, done, "o_custkey", ["o_orderkey"])


@query(
    "a10_quarantine",
    f"WITH ev AS ({fx.EVAL_SQL}) SELECT sample_id, model, raw_answer, 'api_error' AS error_type FROM ev WHERE raw_answer LIKE 'error%'",
)
def a10(spark, sf):
    _, bad = sc.quarantine(fx.evals(spark, sf), F.col("raw_answer").startswith("error"))
    return bad.select("sample_id", "model", "raw_answer", F.lit("api_error").alias("error_type"))


@query(
    "c06_pair_images_contexts",
    "SELECT d.doc_id, d.source, l.quality::BIGINT quality FROM documents d JOIN labels l USING (doc_id)",
)
def c06(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sc.matched(docs, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query(
    "c20_missing_report",
    "SELECT source, count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
)
def c20(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sc.missing(docs, table(spark, sf, "labels"), ["doc_id"]).groupBy("source").agg(
        F.count("*").alias("n_missing")
    )


@query(
    "c07_join_screen_class",
    f"""WITH {SCREEN}, top AS (SELECT * FROM lev WHERE compliance_level IN (9,10) AND complexity_level IS NOT NULL)
    SELECT t.book_id, t.image_id, t.complexity_level::BIGINT complexity_level, array_to_string(c.content_theme, ',') themes,
      array_to_string(c.chart_type, ',') charts FROM top t JOIN scr c USING (book_id, image_id)""",
)
def c07(spark, sf):
    levels = screened(spark, sf).drop("content_theme", "chart_type")
    classes = fx.screen(spark, sf).select("book_id", "image_id", "content_theme", "chart_type")
    top = levels.where(F.col("compliance_level").isin(9, 10) & F.col("complexity_level").isNotNull())
    return sc.matched(top, classes, ["book_id", "image_id"]).select(
        "book_id",
        "image_id",
        "complexity_level",
        F.array_join(F.col("content_theme").cast("array<string>"), ",").alias("themes"),
        F.array_join(F.col("chart_type").cast("array<string>"), ",").alias("charts"),
    )


CUST = """files AS (SELECT lpad(CAST(c_nationkey AS VARCHAR),6,'0') book_id, lpad(CAST(c_custkey AS VARCHAR),6,'0') image_id, c_name FROM customer),
idx AS (SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR),6,'0') book_id, lpad(CAST(o_custkey AS VARCHAR),6,'0') image_id
  FROM orders LEFT JOIN customer ON c_custkey=o_custkey WHERE c_nationkey IS NOT NULL)"""


def _files(spark, sf):
    return table(spark, sf, "customer").select(
        tx.zero_fill("c_nationkey").alias("book_id"), tx.zero_fill("c_custkey").alias("image_id"), "c_name"
    )


def _index(spark, sf):
    orders = table(spark, sf, "orders").select(tx.zero_fill("o_custkey").alias("image_id")).distinct()
    return orders.join(_files(spark, sf).select("book_id", "image_id"), "image_id").select("book_id", "image_id")


@query(
    "c11_select_by_index",
    f"WITH {CUST} SELECT f.book_id, f.image_id, f.c_name FROM files f WHERE EXISTS (SELECT 1 FROM idx i WHERE i.book_id=f.book_id AND i.image_id=f.image_id)",
)
def c11(spark, sf):
    return sc.select_by_index(_files(spark, sf), _index(spark, sf))


@query(
    "c12_compliant_images",
    f"""WITH {SCREEN}, disk AS (SELECT DISTINCT l_partkey FROM lineitem)
    SELECT s.book_id, s.image_id, s.complexity_level::BIGINT complexity_level FROM (SELECT lev.*, p_partkey FROM part
      JOIN lev ON lev.book_id=lpad(CAST(p_partkey//50 AS VARCHAR),6,'0') AND lev.image_id=lpad(CAST(p_partkey%50+1 AS VARCHAR),6,'0')) s
    JOIN disk ON l_partkey=p_partkey WHERE is_compliant='yes'""",
)
def c12(spark, sf):
    disk = table(spark, sf, "lineitem").select(
        tx.zero_fill(F.floor(F.col("l_partkey") / 50)).alias("book_id"),
        tx.zero_fill(F.col("l_partkey") % 50 + 1).alias("image_id"),
    ).distinct()
    yes = screened(spark, sf).where("is_compliant = 'yes'").select("book_id", "image_id", "complexity_level")
    return sc.matched(yes, disk, ["book_id", "image_id"])


@query(
    "d09_copy_stats",
    f"""WITH {CUST}, lines AS (SELECT lpad(CAST(o_custkey AS VARCHAR),6,'0') image_id FROM orders),
    t AS (SELECT count(*) total_processed, count(f.image_id) files_copied FROM lines l LEFT JOIN files f USING (image_id)),
    d AS (SELECT count(DISTINCT book_id) total_subdirs FROM files)
    SELECT total_processed, files_copied, total_subdirs, total_processed-files_copied missing_count,
      files_copied/total_subdirs/total_processed*100 AS success_rate FROM t, d""",
)
def d09(spark, sf):
    files = _files(spark, sf)
    book = files.select("image_id", "book_id")
    lines = (
        table(spark, sf, "orders").select(tx.zero_fill("o_custkey").alias("image_id")).join(book, "image_id", "left")
    )
    return sc.copy_stats(lines, files, F.countDistinct("book_id"))


@query(
    "b24_screen_files",
    """SELECT page_id, url, octet_length(encode(html))::BIGINT AS length,
    CASE WHEN octet_length(encode(html))<2000 THEN 'too small' WHEN lower(url) NOT LIKE '%.pdf' THEN 'not a pdf' END AS reason,
    octet_length(encode(html))>=2000 AND lower(url) LIKE '%.pdf' AS keep FROM pages""",
)
def b24(spark, sf):
    files = table(spark, sf, "pages").select("page_id", "url", F.octet_length("html").alias("length"))
    return sc.screen_files(files, 2000, "url", "length")


VERDICT = """CASE l.quality WHEN 1 THEN 'I would keep it' WHEN 0 THEN 'DELETE: no figures' ELSE 'not sure' END"""


def _verdicts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    reply = F.expr(VERDICT.replace("l.quality", "quality")).alias("reply")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", reply)


@query(
    "b23_map_verdict",
    f"""SELECT doc_id, CASE WHEN upper(r) LIKE '%KEEP%' THEN 'keep' WHEN upper(r) LIKE '%DELETE%' THEN 'delete' ELSE 'uncertain' END verdict
    FROM (SELECT d.doc_id, {VERDICT} r FROM documents d LEFT JOIN labels l USING (doc_id))""",
)
def b23(spark, sf):
    return _verdicts(spark, sf).select("doc_id", ps.map_verdict("reply").alias("verdict"))


@query(
    "g05_restore_kept",
    "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 1) = 1",
)
def g05(spark, sf):
    judged = _verdicts(spark, sf).withColumn("verdict", ps.map_verdict("reply"))
    return sc.restore_kept(judged).select("doc_id", "source")


@query(
    "b29_tag_and_split",
    f"WITH {SCREEN} SELECT book_id, image_id, is_compliant='yes' AS compliant FROM scr",
)
def b29(spark, sf):
    evals = fx.screen(spark, sf).select(
        F.concat(F.lit("eval/"), "book_id", F.lit("/"), "image_id", F.lit(".json")).alias("path"), "is_compliant"
    )
    yes, rest = sc.tag_and_split(evals, "path")
    cols = ["book_id", "image_id"]
    return yes.select(*cols, F.lit(True).alias("compliant")).unionByName(rest.select(*cols, F.lit(False).alias("compliant")))


@query(
    "b28_to_int",
    f"""WITH {SCREEN} SELECT book_id, image_id, compliance_level::BIGINT compliance_level, complexity_level::BIGINT complexity_level FROM lev
    WHERE compliance_level IS NOT NULL""",
)
def b28(spark, sf):
    return screened(spark, sf).where("compliance_level IS NOT NULL").select(
        "book_id", "image_id", "compliance_level", "complexity_level"
    )


REPLY_SQL = """CASE WHEN p_partkey%5=0 THEN 'Sure:'||chr(10)||'```json'||chr(10)||body||chr(10)||'```'
  WHEN p_partkey%5=1 THEN '  '||body||' ' WHEN p_partkey%5=2 THEN '```'||body||'```' WHEN p_partkey%5=3 THEN replace(body,'": ','": : ') ELSE 'no figure in '||p_name END"""
BODY_SQL = """'{"is_compliant": "'||CASE WHEN p_size%2=0 THEN 'yes' ELSE 'no' END||'", "compliance_level": '||CAST(p_size%10+1 AS {s})||', "complexity_level": "'||CAST(p_size%9 AS {s})||'"}'"""
REPLIES = f"rep AS (SELECT p_partkey, p_size, p_name, body, {REPLY_SQL} reply FROM (SELECT p_partkey, p_size, p_name, {BODY_SQL.replace('{s}', 'VARCHAR')} body FROM part))"


def _replies(spark, sf):
    body = BODY_SQL.replace("{s}", "STRING")
    return (
        table(spark, sf, "part")
        .select("p_partkey", "p_size", "p_name", F.expr(body).alias("body"))
        .withColumn("reply", F.expr(REPLY_SQL.replace("chr(10)", "'\\n'")))
    )


@query(
    "b19_extract_json",
    f"WITH {REPLIES} SELECT p_partkey, CASE p_partkey%5 WHEN 3 THEN replace(body,'\": ','\": : ') WHEN 4 THEN reply ELSE body END payload FROM rep",
)
def b19(spark, sf):
    return _replies(spark, sf).select("p_partkey", ps.extract_json("reply").alias("payload"))


@query(
    "b20_parse_or_default",
    f"""WITH {REPLIES} SELECT p_partkey, CASE WHEN p_partkey%5=4 THEN 'null' WHEN p_size%2=0 THEN 'yes' ELSE 'no' END is_compliant,
    CASE WHEN p_partkey%5=4 THEN -1 ELSE p_size%10+1 END::BIGINT compliance_level,
    CASE WHEN p_partkey%5=4 THEN -1 ELSE p_size%9 END::BIGINT complexity_level,
    CASE WHEN p_partkey%5=4 THEN 'default' ELSE 'ok' END status, CASE WHEN p_partkey%5=4 THEN reply END raw_response FROM rep""",
)
def b20(spark, sf):
    return _replies(spark, sf).select("p_partkey", ps.parse_screening("reply").alias("s")).select("p_partkey", "s.*")


_KNOWN = ", ".join(f"'{c}'" for c in ps.CAPABILITIES)


@query(
    "b36_validate_node",
    f"""WITH given AS (SELECT p_partkey, p_name, p_partkey%5<>4 ok, [{_KNOWN}, 'Guessing'][p_size%7+1] capability,
      '{{"instruction":"Read the chart","question":"' || p_name || '","choices":{{"A":"' || p_brand || '","B":"' || p_type
        || '"}},"capability":"' || [{_KNOWN}, 'Guessing'][p_size%7+1] || '"}}' reply FROM part)
    SELECT p_partkey, CASE WHEN ok THEN 'Read the chart' ELSE 'Identify the main trend line in the image' END instruction,
    CASE WHEN ok THEN p_name ELSE 'Is the primary trend line increasing or decreasing?' END question,
    CASE WHEN NOT ok THEN 'visual recognition' WHEN capability<>'Guessing' THEN capability
      ELSE [{_KNOWN}][{draw_sql("reply")}%6+1] END capability, false can_answer_finalq, ok generated FROM given""",
)
def b36(spark, sf):
    """Nodes generated from the parts; one in five replies is no node and falls back."""
    nodes = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 == 4, F.col("p_name"))
        .otherwise(
            F.to_json(
                F.struct(
                    F.lit("Read the chart").alias("instruction"),
                    F.col("p_name").alias("question"),
                    F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type")).alias("choices"),
                    F.element_at(
                        F.array(*[F.lit(c) for c in (*ps.CAPABILITIES, "Guessing")]),
                        (F.col("p_size") % 7 + 1).cast("int"),
                    ).alias("capability"),
                )
            )
        )
        .alias("reply"),
    )
    return nodes.select("p_partkey", ps.validate_node("reply").alias("n")).select(
        "p_partkey", "n.instruction", "n.question", "n.capability", "n.can_answer_finalq", "n.generated"
    )


@query(
    "b37_route_documents",
    """SELECT doc_id, CASE WHEN n_chars//40=0 THEN 'skip' WHEN n_chars/1000.0>200 OR n_chars//40>600 THEN 'split' ELSE 'pass' END route FROM documents""",
)
def b37(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") / 1000.0).alias("mb"), F.expr("n_chars div 40").alias("pages")
    )
    return sc.route_documents(docs, "mb", "pages").select("doc_id", "route")


# ---- statistics ------------------------------------------------------------------------


@query(
    "d01_histogram_pct",
    f"""WITH {SCREEN}, v AS (SELECT unnest(content_theme) AS "value" FROM scr), c AS (SELECT "value", count(*) n FROM v GROUP BY 1)
    SELECT "value"::BIGINT AS "value", n, round(100.0*n/sum(n) OVER (),6)::DOUBLE AS pct FROM c""",
)
def d01(spark, sf):
    return sc.histogram_pct(fx.screen(spark, sf), "content_theme", multi=True).withColumn("pct", F.round("pct", 6))


@query(
    "d02_describe_levels",
    f"""WITH {SCREEN}, v AS (SELECT 'compliance_level' metric, compliance_level v FROM lev UNION ALL SELECT 'complexity_level', complexity_level FROM lev)
    SELECT metric, count(v) n, round(avg(v),6) mean, median(v)::DOUBLE median, min(v)::BIGINT AS min, max(v)::BIGINT AS max,
    round(coalesce(stddev_samp(v),0),6) stdev FROM v WHERE v IS NOT NULL GROUP BY metric""",
)
def d02(spark, sf):
    out = sc.describe_levels(screened(spark, sf), ["compliance_level", "complexity_level"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


@query(
    "d07_level_summary",
    f"WITH {SCREEN} SELECT complexity_level::BIGINT complexity_level, count(*) n FROM lev GROUP BY 1",
)
def d07(spark, sf):
    return sc.level_summary(screened(spark, sf), "complexity_level")


@query(
    "d08_state_counts",
    """SELECT user_id, count(*) FILTER (s='done') done, count(*) FILTER (s='processing') processing, count(*) FILTER (s='failed') failed,
    count(*) FILTER (s='pending') pending, count(*) FILTER (s='waiting-file') waiting_file,
    count(*) FILTER (s IN ('processing','pending','waiting-file','uploading','queued','initializing')) incomplete
    FROM (SELECT user_id, CASE event_id%6 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'queued' ELSE 'odd' END s FROM events) GROUP BY user_id""",
)
def d08(spark, sf):
    states = table(spark, sf, "events").select(
        "user_id",
        F.expr(
            "CASE event_id%6 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'queued' ELSE 'odd' END"
        ).alias("state"),
    )
    return sc.state_counts(states, "state", ("user_id",))


# One book in ten of those with abnormal images, at least one.
SAMPLED = f"""{NEAR},
per AS (SELECT book_id, count(*) n_abnormal FROM classed WHERE classification='abnormal' GROUP BY book_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY {draw_sql("book_id")}, book_id) <= greatest(1, count(*) OVER ()//10) picked FROM per)"""


@query(
    "d28_abnormal_sample_summary",
    f"""WITH {SAMPLED} SELECT count(*) total_books, coalesce(sum(n_abnormal),0)::BIGINT total_abnormal,
    count(*) FILTER (picked) sampled_books, coalesce(sum(n_abnormal) FILTER (picked),0)::BIGINT sampled_abnormal,
    10.0::DOUBLE percentage FROM ranked""",
)
def d28(spark, sf):
    per_book = px.books_with_abnormal(px.image_records(fx.markdown(spark, sf)))
    return sc.abnormal_sample_summary(per_book, sc.sample_books(per_book, 10), 10)


# ---- selection and sampling --------------------------------------------------------------


@query(
    "f01_top_complex",
    f"""WITH {SCREEN} SELECT book_id, image_id, complexity_level::BIGINT complexity_level FROM lev
    WHERE compliance_level IN (9,10) AND complexity_level IS NOT NULL ORDER BY complexity_level DESC, book_id, image_id LIMIT 200""",
)
def f01(spark, sf):
    return sc.top_complex(screened(spark, sf), 200).select("book_id", "image_id", "complexity_level")


@query(
    "f02_sort_by_complexity",
    f"WITH {SCREEN} SELECT book_id, image_id, complexity_level::BIGINT complexity_level FROM lev ORDER BY complexity_level, book_id, image_id",
)
def f02(spark, sf):
    return sc.sort_by_complexity(screened(spark, sf)).select("book_id", "image_id", "complexity_level")


@query("f03_sample_books", f"WITH {SAMPLED} SELECT book_id, n_abnormal FROM ranked WHERE picked")
def f03(spark, sf):
    return sc.sample_books(px.books_with_abnormal(px.image_records(fx.markdown(spark, sf))), 10)


@query(
    "f04_sample_symbols",
    f"""WITH s AS (SELECT c_custkey symbol, c_name AS name, DATE '2010-01-01' + (c_custkey*7%5000)::INT list_date FROM customer)
    SELECT * FROM s WHERE NOT contains(name, 'ST') AND list_date < DATE '2020-01-01' ORDER BY {draw_sql("symbol")}, symbol LIMIT 50""",
)
def f04(spark, sf):
    symbols = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("symbol"),
        F.col("c_name").alias("name"),
        F.date_add(F.lit("2010-01-01").cast("date"), F.col("c_custkey").cast("int") * 7 % 5000).alias("list_date"),
    )
    return sc.sample_symbols(symbols, 50)


@query(
    "e06_index_within_level",
    f"""WITH {SCREEN} SELECT book_id, image_id, complexity_level::BIGINT complexity_level,
    row_number() OVER (PARTITION BY complexity_level ORDER BY book_id, image_id) level_index FROM lev""",
)
def e06(spark, sf):
    return sc.index_within_level(screened(spark, sf)).select("book_id", "image_id", "complexity_level", "level_index")


@query(
    "e07_balanced_sample",
    f"""WITH RECURSIVE {SCREEN}, cand AS (SELECT book_id, image_id, content_theme t,
        row_number() OVER (ORDER BY complexity_level DESC, book_id, image_id) k FROM lev
        WHERE compliance_level IN (9,10) AND complexity_level IS NOT NULL AND chart_type[1] IN (1,2,6,9,11)),
    walk(k, room, theme) AS (
      SELECT 0::BIGINT, list_transform(range(1,18), lambda x: 5), 0
      UNION ALL
      SELECT c.k,
        list_transform(w.room, lambda r, i: CASE WHEN i = (CASE WHEN w.room[c.t[1]]>0 THEN c.t[1] WHEN w.room[c.t[2]]>0 THEN c.t[2] ELSE 0 END) THEN r-1 ELSE r END),
        CASE WHEN w.room[c.t[1]]>0 THEN c.t[1] WHEN w.room[c.t[2]]>0 THEN c.t[2] ELSE 0 END
      FROM walk w JOIN cand c ON c.k=w.k+1)
    SELECT c.book_id, c.image_id, w.theme::BIGINT theme FROM walk w JOIN cand c USING (k) WHERE w.theme>0""",
)
def e07(spark, sf):
    good = screened(spark, sf).where(F.col("compliance_level").isin(9, 10) & F.col("complexity_level").isNotNull())
    return sc.balanced_sample(good, limit=5).select("book_id", "image_id", "theme")


@query(
    "d20_sampler_summary",
    f"""WITH {SCREEN}, g AS (SELECT * FROM lev WHERE compliance_level IN (9,10) AND complexity_level IS NOT NULL)
    SELECT (SELECT count(*) FROM lev) total_files_processed, (SELECT count(compliance_level) FROM lev) compliance_levels_count,
    (SELECT count(complexity_level) FROM lev) complexity_levels_count, (SELECT count(*) FROM g) filtered_records_count,
    least(200,(SELECT count(*) FROM g)) output_records_count,
    (SELECT count(*) FROM (SELECT * FROM g ORDER BY complexity_level DESC, book_id, image_id LIMIT 200) WHERE chart_type[1] IN (1,2,6,9,11)) filtered_output_records_count""",
)
def d20(spark, sf):
    levels = screened(spark, sf)
    top = sc.top_complex(levels, 200)
    return sc.sampler_summary(levels, top, sc.balanced_sample(top, limit=200))


@query(
    "e10_round_robin",
    """SELECT c_custkey, lpad(CAST((k%500)//20+1 AS VARCHAR),3,'0') "server", lpad(CAST(k%20+1 AS VARCHAR),3,'0') shell
    FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey)-1 k FROM customer)""",
)
def e10(spark, sf):
    pairs = table(spark, sf, "customer").select("c_nationkey", "c_custkey")
    return rk.round_robin(pairs, ["c_nationkey", "c_custkey"]).select("c_custkey", "server", "shell")


@query(
    "d18_batch_ids",
    """SELECT page_id, (row_number() OVER (ORDER BY page_id)-1)//200 AS batch_no,
    left(regexp_replace(regexp_replace(url,'^.*/',''),'(.)\\.[^.]*$','\\1'),16)||'_b'||CAST((row_number() OVER (ORDER BY page_id)-1)//200+1 AS VARCHAR) data_id FROM pages""",
)
def d18(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.substring_index("url", "/", -1).alias("name"))
    return rk.batch_ids(pages, ["page_id"], 200).select(
        "page_id", "batch_no", tx.data_id("name", "batch_no").alias("data_id")
    )


@query(
    "e14_conflict_suffix",
    """SELECT p_partkey, CASE WHEN k=1 THEN p_name||'.pdf' ELSE p_name||'_'||CAST(k-1 AS VARCHAR)||'.pdf' END unique_name
    FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) k FROM part)""",
)
def e14(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(".pdf")).alias("name"))
    return rk.conflict_suffix(names, "name", ["p_partkey"]).select("p_partkey", "unique_name")


# ---- names and ids -----------------------------------------------------------------------


@query(
    "b26_index_key",
    """SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR),6,'0')||'-'||lpad(CAST(c_custkey AS VARCHAR),6,'0') index_key,
    '/review/'||lpad(CAST(c_nationkey AS VARCHAR),6,'0')||'/'||lpad(CAST(c_custkey AS VARCHAR),6,'0')||'.jpg' review_path,
    lpad(CAST(c_nationkey AS VARCHAR),2,'0')||'_'||CASE WHEN length(CAST(c_custkey AS VARCHAR))>4 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR),4,'0') END||'_'||CAST(c_nationkey AS VARCHAR)||'_'||CAST(c_custkey AS VARCHAR)||'.jpg' sort_name FROM customer""",
)
def b26(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        tx.index_key("c_nationkey", "c_custkey").alias("index_key"),
        tx.review_path("/review", "c_nationkey", "c_custkey").alias("review_path"),
        tx.sort_name(
            F.col("c_nationkey"), F.col("c_custkey"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
        ).alias("sort_name"),
    )


@query(
    "b27_ids_from_path",
    """SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR),6,'0') book_id, lpad(CAST(c_custkey AS VARCHAR),6,'0') image_id,
    'context/'||lpad(CAST(c_nationkey AS VARCHAR),6,'0')||'/'||lpad(CAST(c_custkey AS VARCHAR),6,'0')||'.json' context_path FROM customer""",
)
def b27(spark, sf):
    path = F.concat(F.lit("images/"), tx.zero_fill("c_nationkey"), F.lit("/"), tx.zero_fill("c_custkey"), F.lit(".jpg"))
    return (
        table(spark, sf, "customer")
        .select("c_custkey", path.alias("path"))
        .select("c_custkey", tx.ids_from_path("path").alias("i"), tx.context_path("path").alias("context_path"))
        .select("c_custkey", "i.book_id", "i.image_id", "context_path")
    )


@query(
    "b34_has_digit_run",
    "SELECT doc_id, regexp_matches(text, '[0-9]{3}') has_run FROM documents",
)
def b34(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.has_digit_run("text").alias("has_run"))


@query(
    "b25_sanitize_name",
    r"""SELECT doc_id, regexp_replace(text, '[\\/*?:"<>|]', '', 'g') drop_name, trim(regexp_replace(text, '[^\p{L}\p{N} _-]', '_', 'g')) word_name,
    CASE WHEN trim(left(regexp_replace(text, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'),100), '. ')='' THEN 'unnamed_folder'
      ELSE trim(left(regexp_replace(text, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'),100), '. ') END folder_name FROM documents""",
)
def b25(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.sanitize_name("text", "drop").alias("drop_name"),
        tx.sanitize_name("text", "word").alias("word_name"),
        tx.sanitize_name("text", "folder").alias("folder_name"),
    )
