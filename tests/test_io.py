import json

from pyspark.sql import functions as F

from figcorpus.operators import corpus as cp
from figcorpus.operators import inference as inf
from figcorpus.plans import fixtures as fx
from figcorpus.plans.catalog import QUERIES
from figcorpus.sources import readers as rd
from figcorpus.sources import writers as wr

SF = "/root/testdata/sf0.001"


def test_corpus_folder(spark, tmp_path):
    for p in ("markdown/000001.md", "markdown/000002.md", "markdown/notes.md", "images/000001/000001.JPG", "images/000001/x.txt", "pdf/000001.pdf"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"text of {p}\nand more")
    rows = rd.scan_books(spark, str(tmp_path)).collect()
    assert [(r["book_id"], r["text"], r["has_pdf"]) for r in rows] == [("000001", "text of markdown/000001.md\nand more", True)]
    images = rd.scan_images(spark, str(tmp_path)).collect()
    assert [(r["book_id"], r["image_id"]) for r in images] == [("000001", "000001")]
    loaded = rd.payload_guard(rd.load_images(spark, str(tmp_path / "images"))).first()
    assert loaded["error"] is None and loaded["base64_length"] % 4 == 0


def test_json_tree_keeps_bad_files_apart(spark, tmp_path):
    for name, text in (("b1/i1.json", '{"level": 3}'), ("b1/i2.json", '{"level": '), ("b2/i1.json", '{\n"level": "7"\n}')):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(text)
    good, bad = rd.scan_json_tree(spark, str(tmp_path), "level STRING")
    assert sorted((r["book_id"], r["image_id"], r["level"]) for r in good.collect()) == [("b1", "i1", "3"), ("b2", "i1", "7")]
    assert [(r["book_id"], r["image_id"]) for r in bad.collect()] == [("b1", "i2")]


def test_json_lists_become_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"k": 3}))
    assert sorted(r["k"] for r in rd.scan_json_files(spark, str(tmp_path), "k INT").collect()) == [1, 2, 3]


def test_index_list(spark, tmp_path):
    (tmp_path / "index.txt").write_text("000001-000045\n\n  000002-7 \nbroken\n1-2-3\n")
    good, bad = rd.read_index(spark, str(tmp_path / "index.txt"))
    assert [(r[0], r[1]) for r in good.collect()] == [("000001", "000045"), ("000002", "7")]
    assert [r[0] for r in bad.collect()] == ["broken", "1-2-3"]


def test_profile(spark):
    r = rd.profile_source(spark.createDataFrame([(1, "x")], "a int, b string")).first()
    assert r["fields"] == "a int, b string" and json.loads(r["sample"]) == {"a": 1, "b": "x"}


def test_hot_folder_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(4000).withColumn("book_id", F.lit("hot"))
    # tiny partitions would be merged again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    wr.write_partitioned(df, str(tmp_path / "o"), ["book_id"], "parquet", salts=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "o" / "book_id=hot").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4000


def test_renumbering(spark):
    docs = spark.createDataFrame([("b", "x ![](images/q.png) y ![](images/p.png) ![](images/q.png)"), ("a", "no image"), ("c", "![](images/lost.png)")], "name string, text string")
    images = spark.createDataFrame([("b", "images/p.png"), ("b", "images/q.png"), ("a", "images/z.png")], "name string, rel_path string")
    out, ids = cp.renumber(docs, images)
    assert [(r["book_id"], r["text"]) for r in out.collect()] == [
        ("000001", "x ![](../images/000001/000001.png) y ![](../images/000001/000002.png) ![](../images/000001/000001.png)")
    ]
    assert {(r["rel_path"], r["image_file"]) for r in ids.collect()} == {("images/q.png", "000001.png"), ("images/p.png", "000002.png")}


def test_parts_in_numeric_order(spark):
    df = spark.createDataFrame([(f"d_part_{k}", str(k)) for k in range(1, 12)] + [("e_part_1", "x")], "name string, text string")
    r = cp.merge_parts(df).collect()
    assert [(x["document"], x["text"].split(cp.PART_JOIN)) for x in r] == [("d", [str(k) for k in range(1, 12)])]
    old = cp.merge_parts(df, numeric=False).first()["text"].split(cp.PART_JOIN)
    assert old[:3] == ["1", "10", "11"]


def test_report_links(spark):
    html = '<ul class="list"><li><a href="./2010/a.html"> One </a></li><li><a href="/aboutboc/bi1/x"><b>Two</b></a></li><li><a href="other">No</a></li></ul>'
    pages = spark.createDataFrame([(1, html, "http://s/l/")], "page_id int, html string, url string")
    got = [(r["title"], r["link_url"]) for r in cp.extract_links(pages, "html", "url", cp.report_links()).orderBy("link_no").collect()]
    assert got == [("One", "http://s/l/2010/a.html"), ("Two", "http://s/aboutboc/bi1/x")]


def test_one_bad_row_costs_only_itself(spark):
    def model(part):
        if (part["id"] == 13).any():
            raise RuntimeError("bad row")
        return [i * 2 for i in part["id"]]

    rows = {r["id"]: r for r in inf.score_batches(spark.range(40), model, ["id"], batch=8, workers=3, retries=1).collect()}
    assert len(rows) == 40 and rows[13]["status"] == "error" and "bad row" in rows[13]["error"]
    assert all(r["response"] == str(i * 2) for i, r in rows.items() if i != 13)


def test_failed_answers_are_asked_again(spark):
    samples = spark.createDataFrame(
        [(i, "bg", "an", f"q{i}", {"A": "x", "B": "y"}, "A") for i in range(6)],
        "sample_id int, image_background string, analysis_information string, question string, options map<string,string>, gold string",
    )
    first = inf.multi_model_answers(samples, ["m"], lambda p: ["error" if "q3" in t else "a" for t in p["prompt"]])
    assert first.where("error_type = 'api_error'").count() == 4 and first.where("correct").count() == 20
    again = inf.retry_failed(first, samples, lambda p: ["B"] * len(p))
    assert again.count() == 24 and again.where("error_type is not null").count() == 0


def test_checkpoints_go_to_the_named_folder(spark):
    from figcorpus import session

    folder = session.checkpoint_dir(spark)
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    # Spark adds a folder of its own below the named one
    assert given is None or spark.sparkContext.getCheckpointDir().split(":")[-1].startswith(given.split(":")[-1].rstrip("/"))
    assert folder == session.checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert session.scratch_dir(spark, "x").startswith(folder.rstrip("/"))


def test_resumed_write_keeps_earlier_books(spark, tmp_path):
    from figcorpus.sources import writers

    def rows(*books):
        return spark.createDataFrame([(b, i) for b in books for i in range(20)], "book string, i int")

    path = str(tmp_path / "books")
    writers.write_partitioned(rows("b1", "b2"), path, ["book"])
    writers.write_partitioned(rows("b3"), path, ["book"])
    writers.write_partitioned(rows("b2").limit(5), path, ["book"])
    assert {r.book: r["count"] for r in spark.read.json(path).groupBy("book").count().collect()} == {"b1": 20, "b2": 5, "b3": 20}


def test_rows_with_errors_are_computed_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from figcorpus.sources import writers

    calls = spark.sparkContext.accumulator(0)

    def ask(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    df = spark.range(100).mapInPandas(ask, "id bigint")
    writers.write_with_errors(df, F.col("id") % 10 == 0, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert calls.value == 100
    assert spark.read.parquet(str(tmp_path / "good")).count() == 90 and spark.read.parquet(str(tmp_path / "bad")).count() == 10


def test_streams_read_files_and_folders(spark, tmp_path):
    from conftest import SF
    from figcorpus.plans.catalog import QUERIES

    spark.read.parquet(f"{SF}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("j02_stream_dedupe", "j04_stream_error_rate"):
        one, many = (sorted(map(tuple, QUERIES[name](spark, d).collect())) for d in (SF, str(tmp_path)))
        assert one == many and one


def test_keyed_state_outlives_runs_and_delays(spark, tmp_path):
    """Results come again years later and in another run: the first counts once, the latest one wins."""
    from figcorpus.streaming import jobs

    runs = [
        [("a", "2020-01-01", 1), ("b", "2020-01-02", 2), ("a", "2020-01-01", 1)],
        [("a", "2024-06-01", 3), ("c", "2024-06-01", 4)],
        [("b", "2019-01-01", 5), ("c", "2024-06-01", 4), (None, "2024-06-02", 6)],
    ]
    seen = []
    for run in runs:
        made = spark.createDataFrame(run, "k string, at string, v int").selectExpr("k", "CAST(at AS TIMESTAMP) AS at", "v")
        made.write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), made.schema)
        jobs.run_available(jobs.first_results(stream, ["k"]), str(tmp_path / "first"), str(tmp_path / "s1"))
        jobs.run_latest(stream, ["k"], ["at", "v"], str(tmp_path / "latest"), str(tmp_path / "s2"))
        seen.append(spark.read.parquet(str(tmp_path / "first")).count())
    assert seen == [2, 3, 4]
    got = jobs.read_latest(spark, str(tmp_path / "latest"), ["k"], ["at", "v"]).collect()
    assert {r["k"]: r["v"] for r in got} == {"a": 3, "b": 2, "c": 4, None: 6}


def test_a_failing_batch_is_halved(spark, tmp_path):
    """Calls are counted: one bad row in a batch of 64 costs about two calls a level, and good rows no more than those."""
    log = tmp_path / "calls"
    log.mkdir()

    def model(part):
        import uuid

        (log / uuid.uuid4().hex).write_text(",".join(map(str, part["id"])))
        if (part["id"] % 100 == 13).any():
            raise RuntimeError("bad row")
        return [str(i) for i in part["id"]]

    df = spark.range(0, 640, 1, 1)
    rows = inf.score_batches(df, model, ["id"], batch=64).collect()
    assert {r["id"] for r in rows if r["status"] == "error"} == {13, 113, 213, 313, 413, 513, 613}
    assert all(r["response"] == str(r["id"]) for r in rows if r["status"] == "ok")
    asked = [list(map(int, f.read_text().split(","))) for f in log.iterdir()]
    assert len(asked) <= 10 + 7 * 2 * 6
    whole = [x for x in range(640) if sum(x in a for a in asked) == 1]
    assert set(range(64 * 7, 64 * 8)) <= set(whole)  # a batch without a bad row is asked once
    assert max(sum(x in a for a in asked) for x in range(640)) <= 7


def test_a_function_may_report_single_rows(spark):
    def model(part):
        return [inf.RowError("no") if i == 5 else i for i in part["id"]]

    rows = {r["id"]: r for r in inf.score_batches(spark.range(20), model, ["id"], batch=20).collect()}
    assert rows[5]["error"] == "no" and rows[5]["status"] == "error" and rows[6]["response"] == "6"
    short = inf.score_batches(spark.range(2), lambda p: [], ["id"]).collect()
    assert all("0 replies" in r["error"] for r in short)


def test_several_calls_are_open_at_once_and_no_more(spark, tmp_path):
    def model(part):
        import time
        import uuid

        mark = tmp_path / uuid.uuid4().hex
        mark.touch()
        time.sleep(0.2)
        n = len(list(tmp_path.iterdir()))
        mark.unlink()
        return [n] * len(part)

    got = inf.score_batches(spark.range(0, 40, 1, 1), model, ["id"], batch=4, in_flight=4).collect()
    assert [r["id"] for r in got] == list(range(40))
    assert 2 <= max(int(r["response"]) for r in got) <= 4


def test_a_journal_asks_no_answered_key_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(die_at):
        def fn(part):
            import uuid

            (calls / uuid.uuid4().hex).write_text(",".join(map(str, part["id"])))
            if die_at is not None and (part["id"] == die_at).any():
                import os

                os._exit(1)  # the worker is lost in the middle of the job
            return ["bad" if i == 7 else str(i) for i in part["id"]]

        return fn

    df, journal = spark.range(0, 60, 1, 2), str(tmp_path / "journal")
    try:
        inf.journaled_batches(df, model(42), ["id"], journal, slices=4, batch=4).collect()
        raise AssertionError("the job should have been lost")
    except AssertionError:
        raise
    except Exception:
        pass
    kept = {r["id"] for r in spark.read.parquet(f"{journal}/*").collect()} if any((tmp_path / "journal").glob("*/*.parquet")) else set()
    for f in calls.iterdir():
        f.unlink()
    rows = {r["id"]: r for r in inf.journaled_batches(df, model(None), ["id"], journal, slices=4, batch=4).collect()}
    assert set(rows) == set(range(60)) and all(r["response"] == str(i) for i, r in rows.items() if i != 7)
    asked = [int(x) for f in calls.iterdir() for x in f.read_text().split(",")]
    assert len(asked) == len(set(asked)) and set(asked) == set(range(60)) - kept
    for f in calls.iterdir():
        f.unlink()
    assert inf.journaled_batches(df, model(None), ["id"], journal, slices=4).count() == 60 and not list(calls.iterdir())


def test_a_journal_keeps_the_last_success(spark, tmp_path):
    journal = str(tmp_path / "j")

    def failing(part):
        raise RuntimeError("down")

    df = spark.range(6)
    assert inf.journaled_batches(df, failing, ["id"], journal, slices=2).where("status = 'error'").count() == 6
    assert inf.journaled_batches(df, lambda p: p["id"], ["id"], journal, slices=2).where("status = 'error'").count() == 6
    assert inf.journaled_batches(df, lambda p: p["id"], ["id"], journal, slices=2, again=True).where("status = 'ok'").count() == 6
    assert inf.journaled_batches(df, failing, ["id"], journal, slices=2, again=True).where("status = 'ok'").count() == 6


def test_edits_reach_linked_records(spark):
    from figcorpus.operators import review as rv

    main = spark.createDataFrame([(1, "b", "x"), (2, "b", None), (3, "c", "x")], "id int, book string, f string")
    other = spark.createDataFrame([(10, "b", "x", 5), (11, "b", "y", 6), (12, "c", "y", 7)], "oid int, book string, g string, n int")
    edits = spark.createDataFrame(
        [(1, "one", "ann", "t1", 0), (1, "late", "ann", "t3", 0), (2, "two", "bob", "t2", 1), (9, "new", "bob", "t9", 2)],
        "id int, f string, reviewer string, timestamp string, original_index int",
    )
    done = rv.apply_linked_review(main, edits, ["id"], ["f"], {"o": (other, "oid", {"f": "g"})}, ["book"])
    got = {r["oid"]: (r["g"], r["n"], r["review_info"] and r["review_info"]["reviewer"]) for r in done["o"].collect()}
    assert got == {10: ("late", 5, "ann"), 11: ("two", 6, "bob"), 12: ("y", 7, None)}
    assert {r["id"]: r["f"] for r in done["main"].collect()} == {1: "late", 2: "two", 3: "x", 9: "new"}


def test_models_are_asked_in_many_tasks(spark):
    def task(part):
        from pyspark import TaskContext

        return [f"task {TaskContext.get().partitionId()}"] * len(part)

    rows = spark.range(400).coalesce(1).selectExpr("id AS sample_id", "'b' AS image_background", "'a' AS analysis_information", "'q' AS question", "'A' AS gold")
    samples = fx.with_options(rows)
    first = inf.multi_model_answers(samples, ["m"], task).collect()
    assert len(first) == 1600 and len({r["answer"] for r in first}) > 8
    # none is an option, so all are asked again
    again = inf.retry_failed(inf.multi_model_answers(samples, ["m"], task), samples, task).collect()
    assert len(again) == 1600 and len({r["answer"] for r in again}) > 8


def test_trees_of_small_files_are_written_by_many_tasks(spark):
    files = QUERIES["a03_scan_json_tree"](spark, SF).inputFiles()
    tasks = {f.split("/part-")[1].split("-")[0] for f in files}
    assert len(files) > 8 and len(tasks) > 4


def test_listing_leaves_the_session_as_it_was(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.json").write_text('{"level": 1}')
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    rd.scan_json_tree(spark, str(tmp_path), "level STRING")
    rd.scan_json_variants(spark, str(tmp_path))
    assert spark.conf.get(name) == before
