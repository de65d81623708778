"""Queries of sources, sinks and streams. Files are written to a new shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import proximity as px
from figcorpus.operators import screening as sc
from figcorpus.operators import variants as va
from figcorpus.plans import fixtures as fx
from figcorpus.plans.figure_queries import NEAR
from figcorpus.plans.registry import query, table
from figcorpus.session import scratch_dir
from figcorpus.sources import readers as rd
from figcorpus.sources import writers as wr
from figcorpus.streaming import jobs


@query(
    "a02_scan_images",
    "SELECT 's_nationkey='||CAST(s_nationkey AS VARCHAR) book_id, sum(octet_length(encode(s_name))+1)::BIGINT length FROM supplier GROUP BY s_nationkey",
)
def a02(spark, sf):
    """Listing of one file per supplier's nation."""
    out = scratch_dir(spark, "images")
    rows = table(spark, sf, "supplier").select("s_nationkey", F.col("s_name").alias("value"))
    rows.repartition("s_nationkey").write.partitionBy("s_nationkey").text(out)
    return rd.scan_images(spark, out, ("TXT",)).select("book_id", "length")


@query(
    "a03_scan_json_tree",
    "SELECT CAST(s_nationkey AS VARCHAR) book_id, CAST(s_suppkey AS VARCHAR) image_id, s_name, s_acctbal FROM supplier",
)
def a03(spark, sf):
    out = scratch_dir(spark, "tree")
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    wr.write_tree(rows, out, ["s_nationkey", "s_suppkey"])
    good, _ = rd.scan_json_tree(
        spark, out, "s_name STRING, s_acctbal DOUBLE", r"s_nationkey=([^/]+)/s_suppkey=([^/]+)/[^/]+\.json$"
    )
    return good


@query(
    "b05_scan_lines",
    "SELECT CAST(c_nationkey AS VARCHAR) book_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) line_no, c_name AS content FROM customer",
)
def b05_lines(spark, sf):
    """Customers as the lines of a file per nation, numbered again when read."""
    out = scratch_dir(spark, "lines")
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("value"))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(out)
    return rd.scan_lines(spark, out, r"c_nationkey=([^/]+)/[^/]+$", "*.txt")


# Suppliers as files of three shapes; every eleventh is cut off.
SHAPE_JSON = """CASE WHEN s_suppkey%11=0 THEN '{"name": "'||s_name
  WHEN s_suppkey%3=0 THEN '{"name":"'||s_name||'","nation":'||CAST(s_nationkey AS {s})||'}'
  WHEN s_suppkey%3=1 THEN '{"supplier":{"name":"'||s_name||'","nation":"'||CAST(s_nationkey AS {s})||'"}}'
  ELSE '{"extra":{},"name":"'||s_name||'","notes":['||CAST(s_nationkey AS {s})||',"new",null]}' END"""


def _shape(string):
    return SHAPE_JSON.replace("{s}", string)


GOOD = "FROM supplier WHERE s_suppkey%11<>0"


def _shapes(spark, sf):
    out = scratch_dir(spark, "shapes")
    rows = table(spark, sf, "supplier").selectExpr("s_nationkey", "s_suppkey", f"{_shape('STRING')} AS value")
    wr.write_tree(rows, out, ["s_nationkey", "s_suppkey"], "text")
    return rd.scan_json_variants(spark, out, r"s_nationkey=([^/]+)/s_suppkey=([^/]+)/[^/]+$", "*.txt")


@query(
    "a03_variant_leaves",
    f"""SELECT CAST(s_suppkey AS VARCHAR) image_id, unnest(CASE s_suppkey%3 WHEN 0 THEN ['name','nation'] WHEN 1 THEN ['supplier.name','supplier.nation'] ELSE ['extra','name','notes[0]','notes[1]','notes[2]'] END) AS leaf,
      unnest(CASE s_suppkey%3 WHEN 0 THEN ['STRING','BIGINT'] WHEN 1 THEN ['STRING','STRING'] ELSE ['OBJECT<>','STRING','BIGINT','STRING','VOID'] END) kind,
      unnest(CASE s_suppkey%3 WHEN 2 THEN ['{{}}',s_name,CAST(s_nationkey AS VARCHAR),'new',NULL] ELSE [s_name,CAST(s_nationkey AS VARCHAR)] END) AS "value" {GOOD}
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'no JSON', 'error', '{{"name": "'||s_name||chr(10) FROM supplier WHERE s_suppkey%11=0""",
)
def a03_leaves(spark, sf):
    """Leaves of records of three shapes, and the files that are no JSON with their text."""
    good, bad = _shapes(spark, sf)
    leaves = va.variant_leaves(good, ["image_id"]).select("image_id", va.path_text().alias("leaf"), "kind", "value")
    return leaves.unionByName(bad.select("image_id", F.col("error").alias("leaf"), F.lit("error").alias("kind"), F.col("raw").alias("value")))


@query(
    "i05_variant_round_trip",
    f"SELECT image_id, record, record AS again FROM (SELECT CAST(s_suppkey AS VARCHAR) image_id, {_shape('VARCHAR')} record {GOOD}) q",
)
def i05_variants(spark, sf):
    """Records as read, and put together again from their leaves."""
    good, _ = _shapes(spark, sf)
    again = va.rebuild_variants(va.variant_leaves(good, ["image_id"]), ["image_id"])
    both = good.select("image_id", F.to_json("record").alias("record")).join(again.select("image_id", F.to_json("record").alias("again")), "image_id", "full")
    return both.select("image_id", "record", "again")


@query("a04_scan_json_files", "SELECT n_nationkey, n_name, n_regionkey, s_name FROM nation JOIN supplier ON s_nationkey=n_nationkey")
def a04(spark, sf):
    out = scratch_dir(spark, "json")
    rows = table(spark, sf, "supplier").join(
        table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    # each file holds one list of objects, those of a nation and of at most 20,000 keys
    rows = rows.withColumn("block", F.floor(F.col("s_suppkey") / 20000))
    lists = rows.groupBy("n_nationkey", "block").agg(
        F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey", "s_name"))).alias("value")
    )
    lists.repartition("n_nationkey", "block").write.partitionBy("n_nationkey", "block").text(out)
    return rd.scan_json_files(spark, f"{out}/*/*", "n_nationkey LONG, n_name STRING, n_regionkey LONG, s_name STRING")


@query(
    "a05_read_index",
    "SELECT lpad(CAST(c_nationkey AS VARCHAR),6,'0') book_id, lpad(CAST(c_custkey AS VARCHAR),6,'0') image_id FROM customer",
)
def a05(spark, sf):
    out = scratch_dir(spark, "index")
    keys = table(spark, sf, "customer").select(
        tx.zero_fill("c_nationkey").alias("book_id"), tx.zero_fill("c_custkey").alias("image_id")
    )
    wr.write_index(keys, f"{out}/good")
    wr.write_text(table(spark, sf, "nation"), f"{out}/bad", F.concat_ws("-", "n_nationkey", "n_name", "n_regionkey"))
    good, _ = rd.read_index(spark, f"{out}/*")
    return good


@query("a06_write_partitioned", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def a06(spark, sf):
    out = scratch_dir(spark, "parts")
    wr.write_partitioned(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), out, ["c_nationkey"], "parquet", salts=2)
    return spark.read.parquet(out)


@query("a07_write_csv", "SELECT doc_id, source, lang, n_chars FROM documents")
def a07(spark, sf):
    out = scratch_dir(spark, "csv")
    wr.write_csv(table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), out)
    return spark.read.option("header", True).schema("doc_id LONG, source STRING, lang STRING, n_chars LONG").csv(out)


@query(
    "a08_write_text",
    """WITH scr AS (""" + fx.SCREEN_SQL + """), v AS (SELECT unnest(content_theme) x FROM scr), c AS (SELECT x, count(*) n FROM v GROUP BY 1)
    SELECT 'Theme '||x||': '||n||' entries ('||CAST(round(CAST(100.0*n/(SELECT sum(n) FROM c) AS DECIMAL(18,6)),2) AS DECIMAL(18,2))||'%)' AS "value" FROM c""",
)
def a08(spark, sf):
    out = scratch_dir(spark, "report")
    wr.write_report(sc.histogram_pct(fx.screen(spark, sf), "content_theme", multi=True), out, "Theme")
    return spark.read.text(out)


@query(
    "a10_quarantine_append",
    f"WITH ev AS ({fx.EVAL_SQL}), e AS (SELECT sample_id, raw_answer FROM ev WHERE raw_answer LIKE 'error%') SELECT * FROM e UNION ALL SELECT * FROM e",
)
def a10(spark, sf):
    """Two runs: the error table keeps the failures of both."""
    out = scratch_dir(spark, "errors")
    rows = fx.evals(spark, sf).select("sample_id", "raw_answer")
    for _ in range(2):
        wr.write_with_errors(rows, F.col("raw_answer").startswith("error"), f"{out}/good", f"{out}/bad")
    return spark.read.parquet(f"{out}/bad")


@query(
    "b30_payload_guard",
    """SELECT page_id, round(octet_length(encode(html))/1048576.0,9)::DOUBLE size_mb, (ceil(octet_length(encode(html))/3.0)*4)::BIGINT base64_length,
    CASE WHEN ceil(octet_length(encode(html))/3.0)*4>=0.002*1048576 THEN 'payload too large' END error FROM pages""",
)
def b30(spark, sf):
    rows = rd.payload_guard(table(spark, sf, "pages").select("page_id", "html"), "html", 0.002)
    return rows.select("page_id", F.round("size_mb", 9).alias("size_mb"), "base64_length", "error")


@query(
    "a15_profile_source",
    """SELECT 'doc_id bigint, quality int, toxic int' AS fields, '{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}' AS sample
    FROM labels ORDER BY doc_id, quality, toxic LIMIT 1""",
)
def a15(spark, sf):
    return rd.profile_source(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")


# ---- streams -----------------------------------------------------------------------------


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    # as a glob the path may be one file or a folder of part files
    stream = jobs.read_files(spark, f"{sf}/{name}.parque[t]", schema)
    # watermarks need a point in time, the table holds clock times
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


@query(
    "j01_stream_curate",
    f"WITH {NEAR} SELECT book_id, line_no::BIGINT line_no, classification FROM classed",
)
def j01(spark, sf):
    out = scratch_dir(spark, "curate")
    step = lambda docs: px.image_records(fx.mark_up(docs)).select("book_id", "line_no", "classification")
    jobs.curate(_stream(spark, sf, "documents"), step, f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data").drop("batch")


@query("j02_stream_dedupe", "SELECT DISTINCT event_id, user_id FROM events")
def j02(spark, sf):
    """Every event arrives twice."""
    out = scratch_dir(spark, "dedupe")
    twice = _stream(spark, sf, "events").withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    jobs.run_available(jobs.dedupe(twice, ["event_id"], "ts", "1 day").select("event_id", "user_id"), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


@query("j02_stream_first", "SELECT DISTINCT event_id, user_id FROM events")
def j02_first(spark, sf):
    """Every event arrives twice, the second time in a later run on the same checkpoint."""
    out = scratch_dir(spark, "first")
    for _ in range(2):
        # a new folder's files are new to the stream, whatever the keys in them
        table(spark, sf, "events").select("event_id", "user_id").write.mode("append").parquet(f"{out}/in")
        arrived = jobs.read_files(spark, f"{out}/in", table(spark, sf, "events").select("event_id", "user_id").schema)
        jobs.run_available(jobs.first_results(arrived, ["event_id"]), f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


@query(
    "j02_stream_latest",
    """SELECT user_id, max(ts) ts, arg_max(event_id, (ts, event_id)) event_id FROM events GROUP BY user_id""",
)
def j02_latest(spark, sf):
    """The last event of every user; the events of odd ids arrive in a later run."""
    out = scratch_dir(spark, "latest")
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{out}/in")
        arrived = jobs.read_files(spark, f"{out}/in", rows.schema)
        jobs.run_latest(arrived, ["user_id"], ["ts", "event_id"], f"{out}/data", f"{out}/state")
    return jobs.read_latest(spark, f"{out}/data", ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_id")


@query(
    "j03_stream_bars",
    """WITH m AS (SELECT max(ts) t FROM events) SELECT event_type symbol, CAST(ts AS DATE) trade_date, arg_min("value", (epoch_us(ts), event_id)) AS open, max("value") high,
    min("value") low, arg_max("value", (epoch_us(ts), event_id)) AS close, count(*)::DOUBLE vol FROM events, m GROUP BY 1, 2, t HAVING CAST(ts AS DATE)+INTERVAL 1 DAY <= t - INTERVAL 1 DAY""",
)
def j03(spark, sf):
    out = scratch_dir(spark, "bars")
    bars = jobs.daily_bars(_stream(spark, sf, "events"), "event_type", "ts", "value", "1 day", "event_id")
    jobs.run_available(bars, f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")


@query(
    "j04_stream_error_rate",
    """WITH m AS (SELECT max(ts) t FROM events) SELECT CAST(ts AS DATE) "day", event_type AS "group", count(*) processed, count(*) FILTER ("value"<10) errors
    FROM events, m GROUP BY 1, 2, t HAVING CAST(ts AS DATE)+INTERVAL 1 DAY <= t - INTERVAL 1 DAY""",
)
def j04(spark, sf):
    out = scratch_dir(spark, "rates")
    rates = jobs.error_rate(_stream(spark, sf, "events"), "event_type", "ts", F.col("value") < 10)
    jobs.run_available(rates, f"{out}/data", f"{out}/state")
    return spark.read.parquet(f"{out}/data")
