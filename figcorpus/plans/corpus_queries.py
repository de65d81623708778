"""Queries of corpus upkeep and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import corpus as cp
from figcorpus.operators import review as rv
from figcorpus.plans.registry import query, table


@query(
    "a13_page_plan",
    """SELECT c_custkey, page_no, page_no*3 "offset", CASE WHEN page_no=0 THEN 'http://x/'||c_custkey ELSE 'http://x/'||c_custkey||'/index_'||page_no||'.html' END page_url
    FROM (SELECT c_custkey, unnest(range(0, (n+2)//3)) page_no FROM (SELECT c_custkey, count(o_orderkey) n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1))""",
)
def a13(spark, sf):
    totals = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("total"))
        .withColumn("base", F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string")))
    )
    return cp.page_plan(totals, "total", 3, "base").select("c_custkey", "page_no", "offset", "page_url")


LINKS = """raw AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<li[^>]*>\\s*(<a\\s[^>]*?href\\s*=\\s*"[^"]*"[^>]*>.*?</a>)', 1)) a,
   unnest(range(1, len(regexp_extract_all(html, '(?is)<li[^>]*>\\s*(<a\\s[^>]*?href\\s*=\\s*"[^"]*"[^>]*>.*?</a>)', 1))+1)) link_no FROM pg),
links AS (SELECT page_id, url, link_no, regexp_extract(a, '(?is)href\\s*=\\s*"([^"]*)"', 1) href, trim(regexp_replace(regexp_extract(a, '(?is)<a[^>]*>(.*)</a>', 1), '<[^>]*>', '', 'g')) title FROM raw)"""
RESOLVE = """CASE WHEN regexp_matches(href,'^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url,'^([a-z]+:)',1)||href
  WHEN href LIKE '/%' THEN regexp_extract(url,'^([a-z]+://[^/?#]*)',1)||href WHEN href LIKE '#%' THEN regexp_extract(url,'^([^#]*)',1)||href WHEN href LIKE '?%' THEN regexp_extract(url,'^([^?#]*)',1)||href
  ELSE regexp_extract(url,'^([a-z]+://[^?#]*/)',1)||href END"""


@query(
    "a14_extract_links",
    f"""WITH pg AS (SELECT * FROM pages), {LINKS} SELECT page_id, link_no, href, title, {RESOLVE} link_url FROM links WHERE href<>''""",
)
def a14(spark, sf):
    return cp.extract_links(table(spark, sf, "pages"), "html", "url")


@query(
    "a14_pdf_links",
    f"""WITH pg AS (SELECT page_id, url, CASE WHEN page_id%5=0 THEN regexp_replace(html, '(<li[^>]*><a href="[^"]*)"', '\\1/r.PDF"', 'g') ELSE html END html FROM pages), {LINKS}
    SELECT page_id, link_no, href, title, {RESOLVE} link_url FROM links WHERE lower(href) LIKE '%.pdf'""",
)
def a14p(spark, sf):
    planted = table(spark, sf, "pages").withColumn(
        "html",
        F.when(
            F.col("page_id") % 5 == 0, F.regexp_replace("html", r'(<li[^>]*><a href="[^"]*)"', r'$1/r.PDF"')
        ).otherwise(F.col("html")),
    )
    return cp.extract_links(planted, "html", "url", cp.pdf_links())


@query(
    "b32_resolve_url",
    """SELECT page_id, 'http://other.org/x' absolute, regexp_extract(url,'^([a-z]+://[^/?#]*)',1)||'/root/'||page_id rooted,
    CASE WHEN regexp_matches(url,'^[a-z]+://[^/?#]*/') THEN regexp_extract(url,'^([a-z]+://[^?#]*/)',1) ELSE url||'/' END||page_id||'.pdf' relative FROM pages""",
)
def b32(spark, sf):
    number = F.col("page_id").cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        tx.resolve_url("url", F.lit("http://other.org/x")).alias("absolute"),
        tx.resolve_url("url", F.concat(F.lit("/root/"), number)).alias("rooted"),
        tx.resolve_url("url", F.concat(F.lit("./"), number, F.lit(".pdf"))).alias("relative"),
    )


@query(
    "a01_scan_books",
    """SELECT lpad(CAST(doc_id AS VARCHAR),6,'0') book_id, source, quality=1 has_pdf FROM documents JOIN labels USING (doc_id)""",
)
def a01(spark, sf):
    files = table(spark, sf, "documents").select(
        F.concat(tx.zero_fill("doc_id"), F.lit(".md")).alias("name"), "source"
    )
    noise = table(spark, sf, "documents").select(F.concat("lang", F.lit(".md")).alias("name"), "source")
    labels = table(spark, sf, "labels").select(tx.zero_fill("doc_id").alias("book_id"), "quality")
    books = cp.scan_books(files.unionByName(noise), labels, labels.where("quality = 1"))
    return books.select("book_id", "source", "has_pdf")


FILES = """files AS (SELECT CAST(o_custkey AS VARCHAR) book_id, CASE o_orderkey%4 WHEN 0 THEN o_orderkey||'.JPG' WHEN 1 THEN o_orderkey||'.pdf' WHEN 2 THEN 'full.md' ELSE o_orderkey||'.txt' END AS "name" FROM orders)"""


def _files(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("book_id"),
        F.expr(
            "CASE o_orderkey%4 WHEN 0 THEN concat(o_orderkey,'.JPG') WHEN 1 THEN concat(o_orderkey,'.pdf') WHEN 2 THEN 'full.md' ELSE concat(o_orderkey,'.txt') END"
        ).alias("name"),
    )


@query(
    "c15_complete_books",
    f"""WITH {FILES} SELECT book_id FROM files GROUP BY 1 HAVING bool_or("name" LIKE '%.JPG') AND bool_or("name" LIKE '%.pdf') AND bool_or("name"='full.md')""",
)
def c15(spark, sf):
    return cp.complete_books(_files(spark, sf))


@query(
    "d07_file_counts",
    f"""WITH {FILES} SELECT CASE WHEN strpos("name",'.')>0 THEN lower(regexp_extract("name",'\\.([^.]*)$',1)) ELSE '' END kind, count(*) n FROM files GROUP BY 1""",
)
def d07f(spark, sf):
    return cp.file_counts(_files(spark, sf), F.lower(F.ltrim(tx.extension("name"), F.lit("."))))


@query(
    "d17_merge_parts",
    """SELECT CAST(conv_id AS VARCHAR) AS document, count(*) n_parts, string_agg(text, chr(10)||chr(10)||'---'||chr(10)||chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id HAVING count(*)>1""",
)
def d17(spark, sf):
    parts = table(spark, sf, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_part_"), F.col("turn").cast("string")).alias("name"), "text"
    )
    return cp.merge_parts(parts)


@query(
    "d19_page_splits",
    """SELECT doc_id, k+1 part_no, k*600+1 first_page, least((k+1)*600, n) last_page FROM
    (SELECT doc_id, n, unnest(range(0, (n+599)//600)) k FROM (SELECT doc_id, n_chars//20 n FROM documents) WHERE n>600)""",
)
def d19(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.expr("n_chars div 20").alias("pages"))
    return cp.page_splits(docs, "pages")


# Parsed books: the lines of a document with an image behind each but those of every fifth line, whose file is missing.
RAW = """raw AS (SELECT doc_id, source||'-'||lpad(CAST(doc_id AS VARCHAR),8,'0') AS "name", string_split(text, chr(10)) ls FROM documents)"""


def _raw_docs(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat_ws("-", "source", F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"),
        F.expr(
            "array_join(transform(split(text,'\\n'), (x,i) -> concat(x, '![](images/', CAST(i % 3 AS STRING), '.jpg)')), '\\n')"
        ).alias("text"),
        "n_chars",
    )


@query(
    "e08_renumber_books_images",
    f"""WITH {RAW}, imgs AS (SELECT r."name", ls, n.have FROM raw r JOIN (SELECT doc_id, CASE WHEN n_chars%2=0 THEN [0,2] ELSE [1] END have FROM documents) n USING (doc_id)),
    used AS (SELECT "name", ls, list_filter(have, lambda h: h<len(ls)) have FROM imgs),
    books AS (SELECT "name", ls, have, lpad(CAST(row_number() OVER (ORDER BY "name") AS VARCHAR),6,'0') book_id FROM used WHERE len(have)>0)
    SELECT "name", book_id, array_to_string(list_transform(ls, lambda x, i: x||CASE WHEN list_contains(have, (i-1)%3)
      THEN '![](../images/'||book_id||'/'||lpad(CAST(list_position(have, (i-1)%3) AS VARCHAR),6,'0')||'.jpg)' ELSE '![](images/'||CAST((i-1)%3 AS VARCHAR)||'.jpg)' END), chr(10)) AS text FROM books""",
)
def e08(spark, sf):
    docs = _raw_docs(spark, sf)
    images = docs.select(
        "name", F.explode(F.expr("CASE WHEN n_chars % 2 = 0 THEN array('images/0.jpg','images/2.jpg') ELSE array('images/1.jpg') END")).alias("rel_path")
    )
    return cp.renumber(docs.drop("n_chars"), images)[0]


# ---- review ------------------------------------------------------------------------------

LINK_MAIN = """m AS (SELECT o_orderkey id, o_custkey book_id, CASE WHEN o_orderkey%7=0 THEN NULL ELSE o_orderstatus END st, CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderkey%3 END k FROM orders),
o AS (SELECT o_orderkey oid, o_custkey book_id, CASE WHEN o_orderkey%4=0 THEN NULL ELSE o_orderstatus END status, CASE WHEN o_orderkey%6=0 THEN NULL ELSE CAST(o_orderkey%3 AS VARCHAR) END kk FROM orders)"""


@query(
    "c13_link_records",
    f"""WITH {LINK_MAIN} SELECT m.id, o.oid FROM m JOIN o ON m.book_id=o.book_id
    AND (m.st IS NULL OR o.status IS NULL OR m.st=o.status) AND (m.k IS NULL OR o.kk IS NULL OR CAST(m.k AS VARCHAR)=o.kk)""",
)
def c13(spark, sf):
    linked = rv.link_records(*_link_sources(spark, sf), {"st": "status", "k": "kk"}, ["book_id"])
    return linked.select("id", F.col("other_oid").alias("oid"))


def _link_sources(spark, sf):
    orders = table(spark, sf, "orders")
    main = orders.selectExpr(
        "o_orderkey id", "o_custkey book_id", "CASE WHEN o_orderkey%7=0 THEN NULL ELSE o_orderstatus END st", "CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderkey%3 END k"
    )
    other = orders.selectExpr(
        "o_orderkey oid", "o_custkey book_id", "CASE WHEN o_orderkey%4=0 THEN NULL ELSE o_orderstatus END status", "CASE WHEN o_orderkey%6=0 THEN NULL ELSE CAST(o_orderkey%3 AS STRING) END kk"
    )
    return main, other


CLASS_SQL = """'['||coalesce('"'||{a}||'"','null')||','||coalesce('"'||CAST({b} AS VARCHAR)||'"','null')||']'"""


@query(
    "c13_link_classes",
    f"""WITH {LINK_MAIN}, mc AS (SELECT book_id, st, k, count(*) n_main FROM m GROUP BY ALL), oc AS (SELECT book_id, status, kk, count(*) n_other FROM o GROUP BY ALL)
    SELECT m.book_id, {CLASS_SQL.format(a='m.st', b='m.k')} main_class, {CLASS_SQL.format(a='o.status', b='o.kk')} other_class, n_main, n_other FROM mc m JOIN oc o ON m.book_id=o.book_id
    AND (m.st IS NULL OR o.status IS NULL OR m.st=o.status) AND (m.k IS NULL OR o.kk IS NULL OR CAST(m.k AS VARCHAR)=o.kk)""",
)
def c13_classes(spark, sf):
    return rv.link_classes(*_link_sources(spark, sf), {"st": "status", "k": "kk"}, ["book_id"])


@query(
    "c13_link_counts",
    f"""WITH {LINK_MAIN} SELECT m.id, {CLASS_SQL.format(a='m.st', b='m.k')} AS "class", count(o.oid) n_links FROM m LEFT JOIN o ON m.book_id=o.book_id
    AND (m.st IS NULL OR o.status IS NULL OR m.st=o.status) AND (m.k IS NULL OR o.kk IS NULL OR CAST(m.k AS VARCHAR)=o.kk) GROUP BY ALL""",
)
def c13_counts(spark, sf):
    main, other = _link_sources(spark, sf)
    links = rv.link_classes(main, other, {"st": "status", "k": "kk"}, ["book_id"])
    return rv.link_counts(main, links, ["st", "k"], ["book_id"]).select("id", "class", "n_links")


@query(
    "i04_apply_review",
    """WITH main AS (SELECT doc_id id, lang, source FROM documents), ed AS (SELECT doc_id id, 'checked' lang, 'q'||quality source FROM labels
      UNION ALL SELECT 1000000+item_id, 'new', 'benchmark' FROM (SELECT row_number() OVER (ORDER BY item_id) item_id FROM benchmark))
    SELECT coalesce(m.id, e.id) id, CASE WHEN e.id IS NOT NULL THEN e.lang ELSE m.lang END lang, CASE WHEN e.id IS NOT NULL THEN e.source ELSE m.source END source,
      CASE WHEN e.id IS NOT NULL THEN 'ann' END reviewer, e.id original_index FROM main m FULL JOIN ed e ON e.id=m.id""",
)
def i04(spark, sf):
    from figcorpus.operators.ranking import with_position

    main = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    changed = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.lit("checked").alias("lang"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source")
    )
    added = with_position(table(spark, sf, "benchmark").select("item_id"), ["item_id"], (), "n").select(
        (F.col("n") + 1000000).alias("id"), F.lit("new").alias("lang"), F.lit("benchmark").alias("source")
    )
    edits = changed.unionByName(added).withColumns(
        {"reviewer": F.lit("ann"), "timestamp": F.lit("2025-01-01T00:00:00"), "original_index": F.col("id")}
    )
    out = rv.apply_review(main, edits, ["id"], ["lang", "source"])
    return out.select(
        "id", "lang", "source", F.col("review_info.reviewer").alias("reviewer"), F.col("review_info.original_index").alias("original_index")
    )


# Two sources hang on the orders of a customer: reports by status, notes by whatever is given.
LINKED = """m AS (SELECT o_orderkey id, o_custkey book_id, CASE WHEN o_orderkey%7=0 THEN NULL ELSE o_orderstatus END st, CAST(o_orderkey%4 AS VARCHAR) grade FROM orders),
rep AS (SELECT o_orderkey rid, o_custkey book_id, CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderstatus END status FROM orders),
notes AS (SELECT c_custkey nid, c_custkey book_id, CASE WHEN c_custkey%2=0 THEN CAST(c_custkey%4 AS VARCHAR) END mark, c_mktsegment status FROM customer),
ed AS (SELECT id, 'x'||id%3 st, 'g'||id%2 grade, 'ann' reviewer, '2025-01-01' "timestamp", id original_index FROM m WHERE id%3=0
  UNION ALL SELECT id, 'y'||id%3, 'h', 'bob', CASE WHEN id%4=0 THEN '2024-12-31' ELSE '2025-01-02' END, id FROM m WHERE id%2=0)"""


def _linked(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    main = orders.selectExpr(
        "o_orderkey id", "o_custkey book_id", "CASE WHEN o_orderkey%7=0 THEN NULL ELSE o_orderstatus END st", "CAST(o_orderkey%4 AS STRING) grade"
    )
    reports = orders.selectExpr("o_orderkey rid", "o_custkey book_id", "CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderstatus END status")
    notes = customer.selectExpr(
        "c_custkey nid", "c_custkey book_id", "CASE WHEN c_custkey%2=0 THEN CAST(c_custkey%4 AS STRING) END mark", "c_mktsegment status"
    )
    first = main.where("id % 3 = 0").selectExpr(
        "id", "concat('x', id%3) st", "concat('g', id%2) grade", "'ann' reviewer", "'2025-01-01' timestamp", "id original_index"
    )
    second = main.where("id % 2 = 0").selectExpr(
        "id", "concat('y', id%3) st", "'h' grade", "'bob' reviewer", "CASE WHEN id%4=0 THEN '2024-12-31' ELSE '2025-01-02' END timestamp", "id original_index"
    )
    others = {"reports": (reports, "rid", {"st": "status"}), "notes": (notes, "nid", {"grade": "mark"})}
    return rv.apply_linked_review(main, first.unionByName(second), ["id"], ["st", "grade"], others, ["book_id"])


@query(
    "i04_linked_review",
    f"""WITH {LINKED}, v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "timestamp" DESC, original_index DESC, reviewer DESC) k FROM ed), e AS (SELECT * FROM v WHERE k=1),
    t AS (SELECT m.*, e.st new_st, e.grade new_grade, e.reviewer, e."timestamp" ts, e.original_index FROM m JOIN e USING (id)),
    lr AS (SELECT r.rid, t.*, row_number() OVER (PARTITION BY r.rid ORDER BY t.ts DESC, t.original_index DESC, t.reviewer DESC) k
      FROM t JOIN rep r ON r.book_id=t.book_id AND (t.st IS NULL OR r.status IS NULL OR t.st=r.status)),
    ln AS (SELECT n.nid, t.*, row_number() OVER (PARTITION BY n.nid ORDER BY t.ts DESC, t.original_index DESC, t.reviewer DESC) k
      FROM t JOIN notes n ON n.book_id=t.book_id AND (n.mark IS NULL OR t.grade=n.mark))
    SELECT 'main' AS "source", m.id, CASE WHEN e.id IS NOT NULL THEN e.st ELSE m.st END AS "value", e.reviewer, e.original_index FROM m LEFT JOIN e USING (id)
    UNION ALL SELECT 'reports', r.rid, CASE WHEN l.rid IS NOT NULL THEN l.new_st ELSE r.status END, l.reviewer, l.original_index FROM rep r LEFT JOIN lr l ON l.rid=r.rid AND l.k=1
    UNION ALL SELECT 'notes', n.nid, CASE WHEN l.nid IS NOT NULL THEN l.new_grade ELSE n.mark END, l.reviewer, l.original_index FROM notes n LEFT JOIN ln l ON l.nid=n.nid AND l.k=1""",
)
def i04_linked(spark, sf):
    done = _linked(spark, sf)

    def told(name, id_, value):
        return done[name].select(
            F.lit(name).alias("source"), F.col(id_).alias("id"), F.col(value).alias("value"),
            F.col("review_info.reviewer").alias("reviewer"), F.col("review_info.original_index").alias("original_index"),
        )

    return told("main", "id", "st").unionByName(told("reports", "rid", "status")).unionByName(told("notes", "nid", "mark"))


@query(
    "i05_stringify_leaves",
    """SELECT CAST(d.doc_id AS VARCHAR) doc_id, trim(d.lang) lang, coalesce(CAST(l.quality AS VARCHAR),'') quality, coalesce(CAST(l.toxic AS VARCHAR),'') toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def i05(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    nested = rows.select("doc_id", "lang", F.struct("quality", "toxic").alias("scores"))
    return rv.stringify_leaves(nested).select("doc_id", "lang", "scores.quality", "scores.toxic")


@query(
    "i05_restore_types",
    "SELECT d.doc_id, d.lang, l.quality::BIGINT quality, l.toxic::BIGINT toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def i05r(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rv.restore_types(rv.stringify_leaves(rows), rows.schema)
