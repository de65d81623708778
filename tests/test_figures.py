"""Neighbour search, classes and references on literal layouts and against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from figcorpus.functions import text as tx
from figcorpus.operators import paragraphs as pg
from figcorpus.operators import proximity as px
from figcorpus.operators import references as rf

TAG = "![](../images/000001/%06d.jpg)"


def classes(docs, text, **search):
    rows = px.image_records(docs(text), **search).orderBy("line_no", "tag_no").collect()
    return [(r["image_filename"], r["classification"], r["caption_count"], r["other_count"]) for r in rows]


def lines(*xs):
    return "\n\n".join(xs)


def test_one_caption_below_is_normal(docs):
    assert classes(docs, lines("text", TAG % 1, "图1 growth", "more text", *["x"] * 12)) == [
        ("000001.jpg", "normal", 1, 0)
    ]


def test_interleaved_tags_and_captions_are_abnormal(docs):
    text = lines(TAG % 1, "图1 a", "图2 b", "图3 c", TAG % 2, "图4 d", TAG % 3, TAG % 4)
    assert {c for _, c, _, _ in classes(docs, text)} == {"abnormal"}


def test_no_numbered_caption_is_extreme(docs):
    text = lines("# INVESTMENTS", "10th Edition", TAG % 1, TAG % 2, "as shown in the figure", "author")
    assert {c for _, c, _, _ in classes(docs, text)} == {"extreme abnormal"}


def test_chart_numbers_are_no_figures(docs):
    assert classes(docs, lines(TAG % 1, "图表1 xxx", "Chart 2 yyy", *["t"] * 6))[0][1] == "extreme abnormal"


def test_section_reset_keeps_the_near_caption(docs):
    far = ["text"] * 8
    text = lines("第一章", TAG % 1, "图1 a", *far, "第二章", TAG % 2, "图1 b", *far)
    assert [c for _, c, _, _ in classes(docs, text)] == ["normal", "normal"]


def test_caption_on_the_next_line(docs):
    text = lines("t", TAG % 1 + "  \n图3-4 value", *["t"] * 12)
    row = px.image_records(docs(text)).first()
    assert (row["classification"], row["nearest_caption"]) == ("normal", "图3-4 value")


def test_caption_out_of_reach(docs):
    text = lines(TAG % 1, *["x"] * 8, "图1 too far", *["x"] * 20)
    assert classes(docs, text)[0][1] == "extreme abnormal"


def test_images_sharing_a_caption(docs):
    text = "\n".join([TAG % 1, TAG % 2, TAG % 3, TAG % 4, "图1 all four", "", "以上四张图是1组，图1表示这1组图"])
    assert {c for _, c, _, _ in classes(docs, text)} == {"abnormal"}


def test_label_inside_a_sentence_is_no_caption(docs):
    assert classes(docs, lines(TAG % 1, "we see in 图1 that", *["x"] * 12))[0][2] == 0


def test_second_line_of_a_figure_paragraph_counts(docs):
    text = lines(TAG % 1, "Figure caption of\nthe chart, Figure 2", *["x"] * 12)
    assert classes(docs, text)[0][2] == 1


def test_two_tags_on_one_line(docs):
    text = lines(TAG % 1 + " " + TAG % 2, "Figure 1 both", *["x"] * 12)
    assert [f for f, *_ in classes(docs, text)] == ["000001.jpg", "000002.jpg"]


def expanding(all_lines, center, pattern, reach=5):
    """Distances step by step, as a person would read off the rule."""
    def at(d):
        return [i for i in (center - d, center + d) if 0 <= i < len(all_lines) and re.search(pattern, all_lines[i])]

    d = 1
    while d <= reach and at(d):
        d += 1
    if d > reach:
        last = reach
    else:
        last = max(min(d + reach, len(all_lines) // 2), reach)
    return sorted(i for k in range(1, last + 1) for i in at(k))


@pytest.mark.parametrize("offset", [0, -1])
def test_search_equals_brute_force(docs, offset):
    rng = random.Random(3)
    pool = ["", "", "plain", "Figure 7 x", "Fig. 2", TAG % 9, "see Figure 3"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 45))) for _ in range(60)]
    rows = px.image_records(docs(*texts), center_offset=offset).collect()
    got = {}
    for r in rows:
        got[(r["book_id"], r["line_no"])] = (
            sorted(c["line_no"] - 1 for c in r["captions"]),
            sorted(c["line_no"] - 1 for c in r["other_images"]),
        )
    want = {}
    for b, text in enumerate(texts):
        ls = text.split("\n")
        # first line of the paragraph of each line
        start = {}
        for i, line in enumerate(ls):
            start[i] = start[i - 1] if i and ls[i - 1] != "" and line != "" else i
        for i, line in enumerate(ls):
            if line != TAG % 9:
                continue
            caps = [
                c
                for c in expanding(ls, i + offset, r"(?i)fig(ure|\.)?\s*\d")
                if ls[c].lower().startswith("fig") or ls[start[c]].lower().startswith("fig")
            ]
            others = [c for c in expanding(ls, i + offset, r"!\[") if c != i]
            want[(f"{b:06d}", i + 1)] = (caps, others)
    assert got == want


def test_paragraphs_keep_true_lines(docs):
    text = "\n\nfirst\nline two\n\n\n\n  third \n\nlast"
    rows = pg.split_paragraphs(docs(text)).orderBy("para_no").collect()
    ls = text.split("\n")
    assert [r["content"] for r in rows] == ["first\nline two", "third", "last"]
    for r in rows:
        assert ls[r["start_line"] - 1].strip() == r["lines"][0]
        assert ls[r["end_line"] - 1].strip() == r["lines"][-1]


def test_context_grows_by_whole_paragraphs(docs):
    paras = [c * 100 for c in "abcdefghij"]
    text = lines(*paras[:5], TAG % 1, *paras[5:])
    row = pg.paragraph_contexts(docs(text), tx.IMAGE_TAG, 400).first()
    # two paragraphs of 102 on each side reach 200
    assert row["context"] == lines(paras[3], paras[4], TAG % 1, paras[5], paras[6])


def references(docs, text, **how):
    marked = rf.marked_documents(docs(text))
    return marked, rf.find_references(marked, **how)


def test_exact_and_prefix_references(docs):
    text = lines("see Figure 1 here", TAG % 1, "Figure 1 sales", "Figure 19 and FIGURE 1.2", "figure 1 again", *["x"] * 9)
    _, refs = references(docs, text)
    got = refs.where("ref_line is not null").orderBy("ref_line", "char_pos").collect()
    assert [(r["ref_line"], r["char_pos"], r["is_exact"]) for r in got if r["caption"] == "Figure 1 sales"] == [
        (1, 4, True),
        (7, 0, False),
        (7, 14, False),
    ]  # stops after one exact and two others, so line 9 is not reached


def test_unreferenced_caption_is_kept(docs):
    _, refs = references(docs, lines(TAG % 1, "Figure 4 alone", *["x"] * 12))
    counts = rf.reference_counts(refs).collect()
    assert [(c["figure_number"], c["reference_count"]) for c in counts] == [("Figure 4", 0)]
    assert rf.reference_counts(refs, keep_unreferenced=False).count() == 0


def test_number_run_into_a_year(docs):
    text = lines(TAG % 1, "图22015-2016", *["x"] * 8, "如图6. 2所示经济持续增长", "如图2所示经济持续下降", "如图22所示经济持续增长")
    marked, refs = references(docs, text)
    fixed = rf.repair_figure_numbers(marked, rf.reference_counts(refs)).collect()
    assert [(r["figure_number"], r["repaired_number"]) for r in fixed] == [("图22015-2016", "图2")]


def test_nested_record(docs):
    text = lines("see 图1 below", TAG % 1, "图1 growth", *["x"] * 9)
    r = rf.context_records(docs(text)).first()
    assert r["classification"] == "normal" and r["total_reference_count"] == 1
    ref = r["caption_references"][0]["references"][0]
    assert ref["is_exact_match"] and ref["reference_paragraph"] == "see 图1 below"
    assert r["captions_found"][0]["line_number"] == 5
    assert TAG % 1 in r["image_surround_text"] and r["other_images_nearby"]["count"] == 0


def test_long_documents_keep_their_line_numbers(docs):
    rng = random.Random(11)
    pieces = [rng.choice(["a", "b\nc", "", "\nd", TAG % 3, "e \n\t"]) for _ in range(700)]
    text = "\n\n".join(pieces)
    ls = text.split("\n")
    rows = pg.split_paragraphs(docs(text)).orderBy("para_no").collect()
    assert len(rows) == sum(1 for p in pieces if p.strip())
    for r in rows:
        assert "\n".join(ls[r["start_line"] - 1 : r["end_line"]]).strip() == r["content"]
    windows = pg.image_char_windows(docs(text), 5).orderBy("image_no").collect()
    starts = [m.start() for m in re.finditer(r"!\[", text)]
    assert [w["context"] for w in windows] == [text[max(0, s - 5) : s + 5] for s in starts]


def brute_references(captions, labels):
    """Every caption against every label of its number, in order, up to one exact and two others."""
    out = set()
    for c in captions:
        exact = other = 0
        for x in sorted(labels, key=lambda x: (x["ref_para"], x["char_pos"])):
            if x["book_id"] != c["book_id"] or x["prefix"] != c["figure_number"].lower():
                continue
            if x["ref_para"] == c["image_para"] or x["ref_line"] == c["caption_line"] or (exact >= 1 and other >= 2):
                continue
            is_exact = c["figure_number"].lower() in [y.lower() for y in x["labels"]]
            exact, other = exact + is_exact, other + (not is_exact)
            out.add((c["book_id"], c["line_no"], c["tag_no"], c["caption_no"], x["ref_para"], x["char_pos"], is_exact))
    return out


def shared_numbers(docs, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        blocks = []
        for i in range(40):
            label = rng.choice(["Figure 1", "Figure 1", "Figure 12", "Figure 2", "图1", "图12"])
            if rng.random() < 0.4:
                blocks += [TAG % i, f"{label} growth {i}"]
            else:
                blocks.append(f"As {label} and Figure 1 say, so be it." + rng.choice(["", f"\nAnd {label}a too.\n{TAG % (100 + i)}"]))
        texts.append(lines(*blocks))
    return docs(*texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_references_equal_brute_force_where_numbers_are_shared(docs, seed):
    marked = rf.marked_documents(shared_numbers(docs, seed))
    captions = rf._captions(marked, ("book_id",), {}).collect()
    labels = rf.label_prefixes(marked.select("book_id", "marks"), ("book_id",)).collect()
    got = rf.find_references(marked).collect()
    found = [r for r in got if r["ref_line"] is not None]
    want = brute_references(captions, labels)
    assert {(r["book_id"], r["line_no"], r["tag_no"], r["caption_no"], r["ref_para"], r["char_pos"], r["is_exact"]) for r in found} == want
    assert len(found) == len(want) > 0
    assert len({(r["book_id"], r["line_no"], r["tag_no"], r["caption_no"]) for r in got}) == len(captions)


def test_many_captions_of_one_number_cost_linear_rows(docs):
    """400 captions of one number and as many references: the slices stay short and the answer is linear."""
    images = [lines(TAG % i, f"Figure 7 title {i}", "plain words") for i in range(400)]
    refs = [f"Then Figure 7{'1' * (i % 2)} says {i}." for i in range(400)]
    marked = rf.marked_documents(docs(lines(*[x for both in zip(images, refs) for x in both])))
    captions = rf._captions(marked, ("book_id",), {}).withColumn("prefix", F.lower("figure_number"))
    assert captions.count() >= 400
    listed = rf.label_prefixes(marked.select("book_id", "marks"), ("book_id",)).withColumn("is_exact", rf._exact("prefix"))
    _, slices = rf._rankings(captions, listed.select("book_id", "prefix", "ref_para", "char_pos", "ref_line", "is_exact"), ["book_id", "prefix"])
    assert slices.count() < 3 * captions.count()
    assert rf.find_references(marked).count() < 20 * captions.count()


def around(paras, at, k):
    """Whole paragraphs on both sides until half of k is reached."""
    def side(step):
        out, size = [], 0
        i = at + step
        while 0 <= i < len(paras) and size < k / 2:
            out.append(paras[i])
            size += len(paras[i]) + 2
            i += step
        return out

    return "\n\n".join([*side(-1)[::-1], paras[at], *side(1)])


@pytest.mark.parametrize("seed", [1, 3])
def test_records_hold_the_texts_their_lines_lie_in(docs, seed):
    made = shared_numbers(docs, seed)
    texts = {r["book_id"]: r["text"].split("\n\n") for r in made.collect()}
    rows = rf.context_records(made).collect()
    n_references = 0
    for r in rows:
        paras, first = texts[r["book_id"]], {}
        line = 1
        for i, p in enumerate(paras):
            for j in range(p.count("\n") + 1):
                first[line + j] = i
            line += p.count("\n") + 2
        assert r["image_surround_text"] == around(paras, first[r["image_tag_line_number"]], 4000)
        for c in r["captions_found"]:
            assert c["content_paragraph"] == around(paras, first[c["line_number"]], 500)
        for ref in [x for c in r["caption_references"] or () for x in c["references"]]:
            at = first[ref["match_line_info"]["line_number"]]
            assert ref["reference_paragraph"] == paras[at]
            assert ref["reference_paragraph_extension"] == around(paras, at, 1000)
            n_references += 1
    assert n_references > 0 and len(rows) == sum(p.count("![") for ps in texts.values() for p in ps)


def test_first_texts_give_the_same_contexts(docs):
    from figcorpus.functions import prompts as pr

    made = shared_numbers(docs, 5)

    def contexts(every):
        r = rf.context_records(made, every=every)
        r = r.withColumn("references", F.flatten(F.transform("caption_references", lambda c: c["references"])))
        return sorted(
            tuple(x)
            for x in r.select(
                "book_id", "image_tag_line_number", "tag_no",
                F.coalesce(pr.assemble_context("classification", "image_filename", "nearest_caption", "references", "image_surround_text"), F.lit("")),
                pr.select_prompt_context("classification", "nearest_caption", "caption_references", "image_surround_text"),
            ).collect()
        )

    assert contexts(True) == contexts(False)


def test_marks_of_a_long_paragraph_cost_linear_bytes(docs):
    """A paragraph with a label on every line is kept once, not once per label."""
    sizes = []
    for kb in (5, 10, 20):
        para = "\n".join(f"Then Figure 7 says {i:04d}." for i in range(kb * 40))
        marked = rf.marked_documents(docs(lines(TAG % 1, "Figure 7 title", para)), texts=True)
        told = F.transform("texts", lambda t: F.length(t["told"]["text"]))
        row = marked.select(F.length(F.to_json("marks")).alias("marks"), F.aggregate(told, F.lit(0), lambda a, x: a + x).alias("texts")).first()
        sizes.append(row["marks"] + row["texts"])
    assert sizes[1] < 2.2 * sizes[0] and sizes[2] < 2.2 * sizes[1]


def test_records_of_no_documents_and_of_repeated_ids(spark, docs):
    assert rf.context_records(spark.createDataFrame([], "book_id string, text string")).count() == 0
    one = docs(lines("see 图1 below", TAG % 1, "图1 growth", *["x"] * 9))
    assert {r["image_surround_text"] is not None for r in rf.context_records(one.unionByName(one)).collect()} == {True}


def test_marks_carry_their_labels_so_that_no_join_reads_lines_again(spark, docs):
    """Labels and their places are those that a search in the paragraph finds; documents are derived and marked in one pass."""
    text = "Intro\n\n" + TAG % 1 + "\n \tFigure 1 and 图 2-3, Fig. 4 see\n\n  Figure 7\u3000 \n\nNo number\n\n\n\nAs fig 12 Figure 12 shows"
    marked = rf.marked_documents(docs(text), texts=True)
    got = rf.placed_labels(marked, ("book_id",)).orderBy("ref_line", "char_pos").collect()
    assert [r.label for r in got] == ["Figure 1", "图 2-3", "Fig. 4", "Figure 7", "fig 12", "Figure 12"]
    paras = {p.para_no: p.content for p in pg.split_paragraphs(docs(text)).collect()}
    assert all(paras[r.ref_para][r.char_pos :].startswith(r.label) for r in got)
    assert "labels" in marked.select(F.explode("marks").alias("m")).select("m.*").columns
    derived = px.figure_marks(docs(text).withColumn("text", F.upper(F.lower("text"))), labels=True, texts=True)
    plan = derived._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
    assert px.figure_marks(docs("no image, Figure 1"), labels=True).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "\u3000a\x85", "\n\ta b\n", "a\u2028", "\u200ba"])
def test_ends_are_stripped_as_before(spark, text):
    row = spark.createDataFrame([(text,), (None,)], "t string").select(tx.strip("t").alias("a"), tx.strip_ends("t").alias("b")).collect()
    assert all(r.a == r.b for r in row)
