"""Sampling, positions, duplicates, votes and trees against brute force, hot groups included."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from figcorpus.functions import vectors as vec
from figcorpus.operators import dedup as dd
from figcorpus.operators import evaluation as ev
from figcorpus.operators import ranking as rk
from figcorpus.operators import review as rv
from figcorpus.operators import screening as sc
from figcorpus.operators import tree as tr
from figcorpus.plans import fixtures as fx


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_balanced_sample_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.randint(0, 9), f"b{rng.randint(0, 9)}", f"i{k}", rng.sample(range(1, 7), rng.randint(0, 4)), [rng.randint(1, 11)])
        for k in range(200)
    ]
    df = spark.createDataFrame(rows, "complexity_level int, book_id string, image_id string, content_theme array<int>, chart_type array<int>")
    got = {r["image_id"]: r["theme"] for r in sc.balanced_sample(df, limit=6).collect()}
    room, want = Counter(), {}
    for level, book, image, themes, charts in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if charts[0] not in sc.KEEP_CHART_TYPES:
            continue
        for t in themes:
            if room[t] < 6:
                room[t] += 1
                want[image] = t
                break
    assert got == want


def test_positions_with_a_hot_group(spark):
    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 40 AS STRING) END AS g", "id * 7919 % 6000 AS o")
    got = rk.with_position(df, ["o"], ("g",)).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["o"], r["position"]))
    assert sum(map(len, groups.values())) == 6000
    for rows in groups.values():
        assert [p for _, p in sorted(rows)] == list(range(1, len(rows) + 1))


def test_round_robin_is_even(spark):
    dealt = rk.round_robin(spark.range(1037), ["id"], 5, 4).groupBy("server", "shell").count().collect()
    assert len(dealt) == 20 and max(r["count"] for r in dealt) - min(r["count"] for r in dealt) <= 1


def test_conflicting_names_stay_unique(spark):
    names = ["a.pdf"] * 3 + ["a_1.pdf"] * 2 + ["a_7.pdf", "b", "b", "b_1", ".x", ".x"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r["unique_name"] for r in rk.conflict_suffix(df, "name", ["i"]).collect()]
    assert len(set(got)) == len(names) and {"a.pdf", "a_1.pdf", "a_7.pdf", "b", "b_1"} <= set(got)


def test_resume_by_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "d string, k int")
    done = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(r["k"] for r in sc.pending_groups(df, done, "d", ["k"]).collect()) == [1, 2]
    assert [r["k"] for r in sc.pending(df, done, ["k"]).collect()] == [2]


def test_levels(spark):
    one = spark.createDataFrame([(4,)], "v int")
    r = sc.describe_levels(one, ["v"]).first()
    assert (r["n"], r["median"], r["stdev"]) == (1, 4.0, 0.0)
    assert sc.histogram_pct(one.where("v > 9"), "v").count() == 0
    two = spark.createDataFrame([(1,), (2,), (4,), (-1,)], "v int")
    assert sc.describe_levels(two, ["v"]).first()["median"] == 1.5
    assert sc.describe_levels(sc.drop_sentinels(two, "v"), ["v"]).first()["n"] == 3


def clustered(rng, n, copies, dim=64):
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n, n)] + rng.normal(scale=0.02, size=(n, dim))
    hot = np.repeat(base[:1], copies, axis=0)
    close = base[1] + rng.normal(scale=0.01, size=(copies, dim))
    zero = np.zeros((2, dim))
    all_rows = np.concatenate([base, near, hot, close, zero])
    return all_rows[rng.permutation(len(all_rows))]


def test_cosine_plan_equals_brute_force_with_hot_copies(spark):
    v = clustered(np.random.default_rng(4), 60, 70)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, e array<double>")
    norms = np.linalg.norm(v, axis=1)
    u = v / np.where(norms == 0, 1, norms)[:, None]
    close = (u @ u.T >= 0.98) & (norms > 0)[:, None] & (norms > 0)[None, :]
    right = {j for j in range(len(v)) if close[:j, j].any()}
    assert {r["id"] for r in dd.cosine_delete_set(df, "id", "e").collect()} == right
    pairs = dd.similar_pairs_cosine(df, "id", "e")
    assert {r["id"] for r in dd.delete_set(pairs).collect()} == right
    assert all(close[r["left_id"], r["right_id"]] for r in pairs.collect())
    # small tiles give the same result
    units = dd._unit_reps(df, "id", "e")[0]
    key = lambda d: sorted((r["i"], r["j"]) for r in d.collect())
    assert key(dd.similar_units(units, 0.98, tile=7)) == key(dd.similar_units(units, 0.98))
    assert dd.similar_units(units, 0.98).count() == len(key(dd.similar_units(units, 0.98, grid_dims=3)))


def test_cosine_groups_are_bounded_beside_a_crowded_cell(spark):
    """One crowded cell, single rows in the cells around it: no group holds more than two tiles and some."""
    rng = np.random.default_rng(8)
    crowd = np.c_[0.5 + rng.uniform(0.01, 0.09, (3000, 2)), rng.normal(0, 1e-3, (3000, 3))]
    single = [[0.5 + 0.2 * a, 0.5 + 0.2 * b, 0.0, 0.0, 0.0] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*crowd, *single])]
    units = spark.createDataFrame(rows, "rep long, u array<double>")
    met = dd.meeting_rows(units, [0, 1], 0.2, 256)
    sides = met.groupBy("_c0", "_c1", "_lt", "_rt").agg(
        F.count_if(F.col("_side") == 0).alias("left"), F.count_if(F.col("_side") == 1).alias("right")
    )
    assert max(sides.agg(F.max("left"), F.max("right")).first()) <= 400
    held = {(r["_c0"], r["_c1"]) for r in met.where("_side = 0").select("_c0", "_c1").distinct().collect()}
    assert {(r["_c0"], r["_c1"]) for r in met.select("_c0", "_c1").distinct().collect()} == held


@pytest.mark.parametrize("bands", [2, 3, 6])
def test_hamming_pairs_equal_brute_force(spark, bands):
    rng = random.Random(bands)
    base = [rng.getrandbits(64) for _ in range(40)]
    sigs = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base * 4] + [base[0]] * 50
    signed = [s - (1 << 64) if s >> 63 else s for s in sigs]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, s long")
    close = {(i, j) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if bin(sigs[i] ^ sigs[j]).count("1") <= 5}
    assert {r["id"] for r in dd.hamming_delete_set(df, "id", "s", 5, bands).collect()} == {j for _, j in close}
    pairs = [(r["left_id"], r["right_id"]) for r in dd.similar_pairs_hamming(df, "id", "s", 5, bands).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= close
    first = {}
    for i, s in enumerate(sigs):
        first.setdefault(s, i)
    reps = set(first.values())
    assert {p for p in close if p[0] in reps and p[1] in reps} <= set(pairs)


def test_signature(spark):
    df = spark.createDataFrame([([float(i) for i in range(64)],)], "e array<float>")
    r = df.select(vec.signature("e", "mean").alias("m"), vec.signature("e", "next").alias("n")).first()
    assert r["m"] & (2**64 - 1) == (2**32 - 1) << 32 and r["n"] & (2**64 - 1) == 1 << 63


@pytest.mark.parametrize(
    "votes, answer, reliability",
    [("AAAAA", "A", "5"), ("AABAA", "A", "4"), ("BABAB", "B", "3"), ("ABBBC", "B", "3"), ("CAABB", "A", "2"), ("DCAAB", "A", "2"), ("DCBAE", "D", "1")],
)
def test_votes(spark, votes, answer, reliability):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(votes)], "q int, model_no int, answer string")
    r = ev.majority_vote(df, ["q"]).first()
    assert (r["answer"], r["reliability"]) == (answer, reliability)
    drawn = ev.majority_vote(df, ["q"], tie_seed=7).first()
    assert drawn["reliability"] == reliability and (answer == drawn["answer"] or votes == "CAABB")


@pytest.mark.parametrize(
    "last, n, want",
    [
        ("Perception", 1, ("Perception", "Data_extraction", 0)),
        ("Perception", 2, ("Perception", "Data_extraction", 1)),
        ("Perception", 3, ("Data_extraction", "Data_extraction", 0)),
        ("Data_extraction", 3, ("Calculation_analysis", "Calculation_analysis", 0)),
        ("Calculation_analysis", 1, ("Calculation_analysis", "Pattern_recognition", 1)),
        ("Logical_reasoning", 2, ("Decision_support", "Decision_support", 0)),
        ("Decision_support", 5, ("Decision_support", "Decision_support", 0)),
        (None, 0, ("Perception", "Perception", 0)),
    ],
)
def test_next_capability(spark, last, n, want):
    log = spark.createDataFrame([(1, k, last) for k in range(n)], "c int, pos int, capability string")
    r = tr.next_capability(log, ["c"], spark.createDataFrame([(1,)], "c int")).first()
    assert (r["current_capability"], r["next_capability"], r["hint"]) == want


def test_paths_of_deep_and_wide_trees(spark):
    chain = [(1, k, k - 1) for k in range(40)]
    star = [(2, 0, -1)] + [(2, k, 0) for k in range(1, 300)]
    nodes = spark.createDataFrame(chain + star, "fq_no int, question_node_no int, parent_node_no int")
    got = tr.leaf_to_root_chains(nodes).collect()
    assert len(got) == 300
    assert [r["path"] for r in got if r["fq_no"] == 1] == [list(range(40))]
    with pytest.raises(ValueError):
        tr.root_paths(spark.createDataFrame([(1, 0, 1), (1, 1, 0)], nodes.schema), max_rounds=4)


def test_victories_sum_to_the_length_of_correct_chains(spark):
    log = spark.createDataFrame(
        [(1, c, p, "question", p if p < 2 else 10 * c + p, c != 2) for c in range(4) for p in range(3 + c)],
        "fq_no int, chain_no int, pos int, type string, no int, correct boolean",
    )
    wins = tr.chain_wins(log).agg(F.sum("victory_count")).first()[0]
    assert wins == log.where("correct").count()


def test_first_child_wins_ties_and_unvisited_go_first(spark):
    nodes = spark.createDataFrame([(1, 0, -1, 9, 0), (1, 1, 0, 4, 2), (1, 2, 0, 4, 2), (1, 3, 0, 0, 0)], "fq_no int, question_node_no int, parent_node_no int, visit_count int, victory_count int")
    visited = nodes.where("visit_count > 0")
    pick = lambda d: {r["parent_node_no"]: r["question_node_no"] for r in tr.select_child(d).collect()}
    assert pick(tr.uct_scores(visited))[0] == 1
    assert pick(tr.ucb_scores(nodes))[0] == 3


def test_answer_texts(spark):
    df = fx.with_options(spark.createDataFrame([("A,C",), ("A,Z",), (None,)], "answer string"))
    assert [r[0] for r in df.select(tr.answer_texts()).collect()] == ["rises\nstays flat\n", "None", "None"]


def test_links_with_missing_fields_equal_brute_force(spark):
    rng = random.Random(9)
    pick = lambda xs: rng.choice(xs)
    main = [(i, "hot" if i % 3 else f"b{i % 5}", pick([None, 1, 2]), pick([None, "x", "y"])) for i in range(90)]
    other = [(i, "hot" if i % 3 else f"b{i % 5}", pick([None, "1", "2"]), pick([None, "x", "y"])) for i in range(80)]
    m = spark.createDataFrame(main, "id int, book string, a int, b string")
    o = spark.createDataFrame(other, "oid int, book string, p string, q string")
    got = sorted((r["id"], r["other_oid"]) for r in rv.link_records(m, o, {"a": "p", "b": "q"}, ["book"]).collect())
    same = lambda x, y: x is None or y is None or str(x) == str(y)
    want = sorted((x[0], y[0]) for x in main for y in other if x[1] == y[1] and same(x[2], y[2]) and same(x[3], y[3]))
    assert got == want


def test_class_links_expand_to_the_links_of_records(spark):
    rng = random.Random(4)
    pick = lambda xs: rng.choice(xs)
    main = [(i, "hot" if i % 3 else f"b{i % 5}", pick([None, 1, 2]), pick([None, "x", 'y"'])) for i in range(120)]
    other = [(i, "hot" if i % 3 else f"b{i % 5}", pick([None, "1", "2"]), pick([None, "x", 'y"'])) for i in range(110)]
    m = spark.createDataFrame(main, "id int, book string, a int, b string")
    o = spark.createDataFrame(other, "oid int, book string, p string, q string")
    fields = {"a": "p", "b": "q"}
    links = rv.link_classes(m, o, fields, ["book"])
    pairs = rv.link_records(m, o, fields, ["book"])
    mine = m.select("id", "book", rv.class_of(["a", "b"]).alias("main_class"))
    theirs = o.select("oid", "book", rv.class_of(["p", "q"]).alias("other_class"))
    expanded = links.join(mine, ["book", "main_class"]).join(theirs, ["book", "other_class"])
    want = sorted((r["id"], r["other_oid"]) for r in pairs.collect())
    assert sorted((r["id"], r["oid"]) for r in expanded.collect()) == want
    rows = links.collect()
    assert sum(r["n_main"] * r["n_other"] for r in rows) == len(want) and len(rows) < len(want) / 2
    counts = {r["id"]: r["n_links"] for r in rv.link_counts(m, links, ["a", "b"], ["book"]).collect()}
    assert counts == {x[0]: sum(p[0] == x[0] for p in want) for x in main}


def test_class_links_of_a_hot_book_stay_small(spark):
    """Records without any field match their whole book: 3,000 times 3,000 links are one row."""
    m = spark.range(3000).selectExpr("id", "'b' AS book", "CAST(NULL AS STRING) AS a")
    o = spark.range(3000).selectExpr("id AS oid", "'b' AS book", "CAST(NULL AS STRING) AS p")
    rows = rv.link_classes(m, o, {"a": "p"}, ["book"]).collect()
    assert [(r["n_main"], r["n_other"], r["main_class"]) for r in rows] == [(3000, 3000, "[null]")]
    assert rv.link_classes(m.limit(0), o, {"a": "p"}, ["book"]).count() == 0


def test_link_fields(spark):
    main, other = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(1, 2)], "b int, c int")
    assert rv.link_fields(main, {"o": other}, ["a", "b", "z"]) == {"o": ["b"]}


def test_nested_text_form_and_back(spark):
    df = spark.createDataFrame([(1, {"k": 2.5}, [True, None], (None, " x "))], "a int, m map<string,double>, l array<boolean>, s struct<u:date,v:string>")
    as_text = rv.stringify_leaves(df)
    assert as_text.first().asDict(recursive=True) == {"a": "1", "m": {"k": "2.5"}, "l": ["true", ""], "s": {"u": "", "v": "x"}}
    back = rv.restore_types(as_text, df.schema).first().asDict(recursive=True)
    assert back == {"a": 1, "m": {"k": 2.5}, "l": [True, None], "s": {"u": None, "v": "x"}}


def test_latest_edit_of_a_record_counts(spark):
    from figcorpus.operators import review

    main = spark.createDataFrame([(1, "a"), (2, "b")], "id int, lang string")
    edits = spark.createDataFrame([(1, "x", "r", 5, 0), (1, "y", "r", 9, 0), (3, "z", "r", 1, 0)], "id int, lang string, reviewer string, timestamp int, original_index int")
    assert sorted((r.id, r.lang) for r in review.apply_review(main, edits, ["id"], ["lang"]).collect()) == [(1, "y"), (2, "b"), (3, "z")]


def near_vectors(spark, n, dim=24, seed=3):
    """n distinct vectors, half of them 0.98 or more alike to another one."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 2, dim))
    near = base + rng.normal(scale=0.2 * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(dim), size=base.shape) * rng.uniform(0, 1, (n // 2, 1))
    v = np.concatenate([base, near])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(n)
    return u, spark.createDataFrame(list(zip(ids.tolist(), u.tolist())), "rep long, u array<double>")


def test_bands_find_what_they_promise_and_only_true_pairs_once(spark):
    u, units = near_vectors(spark, 4000)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)))}
    for recall, tile in ((0.95, 2048), (0.9999, 2048), (0.9999, 16)):
        got = [(r["i"], r["j"]) for r in dd.similar_by_bands(units, 0.98, recall, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= recall * len(want) * 0.999
    right = {r["id"] for r in dd.similar_by_bands(units, 0.98, how="left_semi").collect()}
    assert right <= {j for _, j in want} and len(right) >= 0.999 * len({j for _, j in want})


def test_work_of_bands_grows_with_the_table(spark):
    """Four times the vectors: about four times the rows dealt, and groups as small as before."""
    found = []
    for n in (10_000, 40_000):
        units = near_vectors(spark, n)[1]
        layout = dd.band_layout(n, 0.98, 0.95, 64)
        rows = dd.bucket_rows(units, *layout)
        sizes = rows.groupBy("_band", "_key", "_lt", "_rt").count()
        found.append((rows.count() / n, sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0] / n))
    (few, small), (many, large) = found
    assert many < 1.6 * few and large < 2 * small


def test_a_crowded_bucket_is_cut_into_tiles(spark):
    rng = np.random.default_rng(6)
    crowd = np.r_[np.ones(8)] + rng.normal(scale=0.01, size=(900, 8))
    units = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(crowd)], "rep long, u array<double>")
    rows = dd.bucket_rows(units, 3, 2, tile=64)
    assert rows.groupBy("_band", "_key", "_lt", "_rt").count().agg(F.max("count")).first()[0] < 64 * 4
    got = dd.similar_by_bands(units, 0.98, bucket=900, tile=64)
    assert got.count() == 900 * 899 // 2


def test_running_sums_cross_partitions(spark):
    from figcorpus.operators.ranking import with_running_sum

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 5)) for i in range(300)]
    got = with_running_sum(spark.createDataFrame(rows, "g string, at int, v int"), ["at"], F.col("v"), ("g",), parts=7).collect()
    want, upto = {}, {}
    for g, i, v in rows:
        upto[g] = upto.get(g, 0) + v
        want[i] = upto[g]
    assert {r["at"]: r["running"] for r in got} == want
