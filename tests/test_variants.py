"""Records of differing shape, and the filter in front of the anti join."""

import json

from pyspark.sql import functions as F

from figcorpus.operators import screening as sc
from figcorpus.operators import variants as va
from figcorpus.sources import readers as rd

RECORDS = [
    {"a": 1, "b": {"c": ["x", {"d": None, "e": True}], "": "empty name"}, "text": ' "quoted"\\ \n é '},
    {"a": "one", "b": [], "z": {}},
    [1.5, -20, 1e300, {"deep": {"er": {"est": [[["end"]]]}}}],
    "a text",
    None,
    {"a": 12345678901234567890, "b": {"c": False}},
]


def _folder(spark, tmp_path):
    for i, r in enumerate(RECORDS):
        (tmp_path / f"b{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"b{i % 2}" / f"r{i}.json").write_text(json.dumps(r, ensure_ascii=False, indent=i % 3 or None))
    (tmp_path / "b0" / "cut.json").write_text('{"a": ')
    (tmp_path / "b0" / "blank.json").write_text(" \n")
    return rd.scan_json_variants(spark, str(tmp_path))


def _leaves_of(value, path=""):
    """By hand: path and text of each leaf."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in _leaves_of(v, f"{path}.{k}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in _leaves_of(v, f"{path}[{i}]")]
    return [(path.removeprefix("."), value)]


def test_shapes_in_one_folder_round_trip(spark, tmp_path):
    good, bad = _folder(spark, tmp_path)
    assert sorted((r["image_id"], r["error"]) for r in bad.collect()) == [("blank", "empty file"), ("cut", "no JSON")]
    leaves = va.variant_leaves(good, ["book_id", "image_id"])
    paths = sorted((r["image_id"], r["p"]) for r in leaves.select("image_id", va.path_text().alias("p")).collect())
    # an empty name leaves its dot
    assert paths == sorted((f"r{i}", p) for i, r in enumerate(RECORDS) for p, _ in _leaves_of(r))
    again = va.rebuild_variants(leaves, ["book_id", "image_id"])
    rows = {r["image_id"]: r for r in again.select("image_id", F.to_json("record").alias("j"), "errors").collect()}
    read = {r["image_id"]: r["j"] for r in good.select("image_id", F.to_json("record").alias("j")).collect()}
    assert {k: r["j"] for k, r in rows.items()} == read and len(rows) == len(RECORDS)
    assert [json.loads(rows[f"r{i}"]["j"]) for i in range(len(RECORDS))] == RECORDS
    assert all(r["errors"] == [] for r in rows.values())
    texts = va.rebuild_variants(leaves, ["book_id", "image_id"], as_text=True)
    told = {r["image_id"]: json.loads(r["j"]) for r in texts.select("image_id", F.to_json("record").alias("j")).collect()}
    assert told["r1"] == RECORDS[1] and told["r5"] == {"a": "12345678901234567890", "b": {"c": "false"}}
    assert told["r0"]["text"] == '"quoted"\\ \n é' and told["r0"]["b"]["c"][1] == {"d": "", "e": "true"} and told["r4"] == ""


def test_edited_leaves_keep_what_cannot_be_read(spark):
    df = spark.createDataFrame([(1, '{"n": 3, "t": [true, 2.50]}'), (2, '{"n": 7}'), (3, None)], "id int, raw string")
    leaves = va.variant_leaves(df.select("id", F.try_parse_json("raw").alias("record")), ["id"])
    at = va.path_text()
    edited = leaves.withColumn(
        "value", F.when((at == "n") & (F.col("id") == 1), "three").when(at == "n", "008").when(at == "t[0]", "false").otherwise(F.col("value"))
    )
    rows = {r["id"]: (json.loads(r["j"]), r["errors"]) for r in va.rebuild_variants(edited, ["id"]).select("id", F.to_json("record").alias("j"), "errors").collect()}
    assert rows == {1: ({"n": "three", "t": [False, 2.5]}, ["n: no BIGINT: three"]), 2: ({"n": 8}, [])}
    assert va.shape(df.select(F.try_parse_json("raw").alias("record"))).first()["shape"].startswith("OBJECT<n: ")
    none = va.variant_leaves(df.where("id > 9").select("id", F.try_parse_json("raw").alias("record")), ["id"])
    assert none.count() == 0 and va.rebuild_variants(none, ["id"]).count() == 0


def test_filter_before_anti_join(spark):
    df = spark.range(40000).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id") % 7).alias("name"), (F.col("id") * 3).alias("__x"))
    done = df.where("k % 40 = 0").select("name", "k")
    got = sc.pending_by_filter(df, done, ["k", "name"])
    assert got.columns == df.columns and sorted(r["k"] for r in got.collect()) == [k for k in range(40000) if k % 40]
    words = 1000 // 4
    held = sc.key_filter(done, ["k", "name"], words)
    assert held.count() <= words
    denied, maybe = sc.split_by_filter(df, held, ["k", "name"], words)
    # rows that still meet the done keys: those done, and few others
    assert denied.count() + maybe.count() == 40000 and 1000 <= maybe.count() < 1000 + 39000 // 20
    assert denied.where("k % 40 = 0").count() == 0
    # filters of two halves merge
    parts = [sc.key_filter(done.where(f"k % 80 = {r}"), ["k", "name"], words) for r in (0, 40)]
    merged = parts[0].unionByName(parts[1]).groupBy("__word").agg(F.bit_or("__held").alias("__held"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, held.collect()))


def test_filter_beyond_its_size_and_odd_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (4, "d"), (4, "d")], "k long, v string")
    done = spark.createDataFrame([(1,), (None,), (9,)], "k long")
    wanted = [(4, "d"), (4, "d"), (None, "c")]
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))
    assert order(sc.pending_by_filter(df, done, ["k"]).collect()) == wanted
    assert order(sc.pending_by_filter(df, done, ["k"], max_words=0).collect()) == wanted
    assert order(sc.pending_by_filter(df, done.select(F.col("k").cast("int")), ["k"]).collect()) == wanted
    assert sc.pending_by_filter(df, done.where("k > 99"), ["k"]).count() == 5
    assert sc.pending_by_filter(df.where("k > 99"), done, ["k"]).count() == 0
