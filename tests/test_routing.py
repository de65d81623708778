from pyspark.sql import functions as F

from figcorpus.operators import corpus as cp
from figcorpus.operators import screening as sc


def test_index_for_nested_and_flat_folders(spark):
    files = spark.createDataFrame([("b1", "i1", "png"), ("b1", "i2", "jpg"), ("b2", "i1", "pdf")], "book_id string, image_id string, ext string")
    index = spark.createDataFrame([("b1", "i1"), ("b1", "i1"), ("b9", "i1")], "book_id string, image_id string")
    assert [r["ext"] for r in sc.select_by_index(files, index).collect()] == ["png"]
    assert sorted(r["ext"] for r in sc.select_by_index(files, index, nested=False).collect()) == ["jpg", "png"]
    assert [r["book_id"] for r in sc.missing(index, files, ["book_id", "image_id"]).collect()] == ["b9"]
    stats = sc.copy_stats(index, files, F.countDistinct("book_id")).first()
    assert (stats["total_processed"], stats["files_copied"], stats["missing_count"]) == (3, 2, 1)
    assert abs(stats["success_rate"] - 2 / 2 / 3 * 100) < 1e-9


def test_file_and_document_routes(spark):
    files = spark.createDataFrame([("a.pdf", 10), ("a.PDF", 99), ("a.txt", 99)], "path string, length long")
    assert [r["reason"] for r in sc.screen_files(files, 50).collect()] == ["too small", None, "not a pdf"]
    docs = spark.createDataFrame([(0.0, 5), (1.0, 0), (1.0, 601), (201.0, 1), (200.0, 600)], "mb double, pages int")
    assert [r["route"] for r in sc.route_documents(docs, "mb", "pages").collect()] == ["skip", "skip", "split", "split", "pass"]
    parts = cp.page_splits(spark.createDataFrame([(1, 1201), (2, 600)], "doc_id int, pages int"), "pages").collect()
    assert [(r["doc_id"], r["first_page"], r["last_page"]) for r in parts] == [(1, 1, 600), (1, 601, 1200), (1, 1201, 1201)]


def test_states(spark):
    df = spark.createDataFrame([("done",), ("queued",), ("pending",), ("odd",)], "s string")
    r = sc.state_counts(df, "s").first().asDict()
    assert r == {"done": 1, "processing": 0, "failed": 0, "pending": 1, "waiting_file": 0, "incomplete": 2}


def test_samples(spark):
    books = spark.range(57).selectExpr("CAST(id AS STRING) AS book_id", "id AS n_abnormal")
    picked = sc.sample_books(books, 10, seed=3)
    assert picked.count() == 5 and sorted(picked.collect()) == sorted(sc.sample_books(books, 10, seed=3).collect())
    assert sc.sample_books(books, 0.1).count() == 1
    r = sc.abnormal_sample_summary(books, picked, 10).first()
    assert (r["total_books"], r["sampled_books"], r["total_abnormal"]) == (57, 5, sum(range(57)))
    assert r["sampled_abnormal"] == sum(x["n_abnormal"] for x in picked.collect())


def test_sessions_name_the_checkpoint_folder(spark, tmp_path):
    """In a session of its own, since the folder belongs to the context."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
from figcorpus.session import checkpoint_dir, durable
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
print("FOLDER", checkpoint_dir(spark))
print("ROWS", durable(spark.range(5)).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert str(tmp_path) in out.stdout and "ROWS 5" in out.stdout, out.stderr[-500:]
