import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from figcorpus.functions import parsing as ps
from figcorpus.functions import prompts as pr
from figcorpus.functions import text as tx


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


def many(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_html_tables(spark):
    html = "<table border=\"1\"><tr><td5</td><th>a\t  b</th></tr></table>\n  \n\n<p class='x' style=\"y\">end</p> "
    assert one(spark, html, tx.clean_html_tables) == "5\n\na b\n\n<p>end</p>"


def test_drop_section_takes_the_first_pattern_of_the_list(spark):
    text = "intro\n# SUMMARY\ns\n# List of Figures\nFigure 1 .. 3\n# Body\nFigure 1o, 图 3O, 2一3"
    assert one(spark, text, tx.drop_section) == "intro\n# SUMMARY\ns\n\n# Body\nFigure 1o, 图 3O, 2一3"
    assert one(spark, text, tx.clean_document).endswith("Figure 10, 图 30, 2-3")
    assert one(spark, "Figure 1o", lambda c: tx.clean_document(c, only_with_section=True)) == "Figure 1o"
    assert one(spark, "a\n# 图 索 引\nrest", tx.drop_section) == "a"


def test_wide_spaces_count_as_space(spark):
    assert one(spark, "图　3 x", tx.figure_identifier) == "图　3"


@pytest.mark.parametrize(
    "reply, want",
    [
        ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        ('```{"a": 1}```', '{"a": 1}'),
        ('  {"a": 1} ', '{"a": 1}'),
        ("no object", "no object"),
        ("", None),
    ],
)
def test_extract_json(spark, reply, want):
    assert one(spark, reply, ps.extract_json) == want


def test_screening_defaults(spark):
    rows = many(
        spark,
        ['{"is_compliant": "yes", "compliance_level": 10, "complexity_level": "8"}', "sorry", '{"is_compliant": "no", "compliance_level": : 1, "complexity_level": 3}', None],
        ps.parse_screening,
    )
    assert [(r["is_compliant"], r["compliance_level"], r["complexity_level"]) for r in rows] == [
        ("yes", 10, 8),
        ("null", -1, -1),
        ("no", 1, 3),
        ("null", -1, -1),
    ]


def test_verdicts(spark):
    assert many(spark, ["keep", " Delete it", "KEEP or DELETE", "hm"], ps.map_verdict) == ["keep", "delete", "keep", "uncertain"]


def test_urls_like_the_standard_rule(spark):
    bases = ["http://a.b/c/d.html", "http://a.b/c/", "https://a.b", "http://a.b/x/y/z?q=1"]
    hrefs = ["e.pdf", "./e.pdf", "../e.pdf", "/e.pdf", "//h/e", "http://o/p", "?k=1", "#t", "f/../g.html", "../../../up.html"]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "b string, h string")
    got = {(r["b"], r["h"]): r["u"] for r in df.select("b", "h", tx.resolve_url("b", "h").alias("u")).collect()}
    assert got == {(b, h): urljoin(b, h) for b, h in pairs}


def test_names(spark):
    assert one(spark, 'a/b:c*"d"', lambda c: tx.sanitize_name(c, "drop")) == "abcd"
    assert one(spark, "Année 1: x-y", lambda c: tx.sanitize_name(c, "word")) == "Année 1_ x-y"
    assert one(spark, " .a?b. ", lambda c: tx.sanitize_name(c, "folder")) == "a_b"
    assert one(spark, "...", lambda c: tx.sanitize_name(c, "folder")) == "unnamed_folder"
    assert one(spark, "x" * 200 + ".pdf", tx.truncate_name) == "x" * 96 + ".pdf"
    assert one(spark, "1234567", tx.zero_fill) == "1234567"


def trimmed(text, limit):
    """The rule read off step by step, for comparison."""
    ends = ".?!。？！"
    if len(text) <= limit:
        return text
    mid, half = len(text) // 2, limit // 2

    def snap(lo, hi):
        before = max(text.rfind(e, 0, lo) for e in ends)
        after = min([p for p in (text.find(e, hi) for e in ends) if p >= 0], default=None)
        return (
            before + 1 if before >= 0 and lo - before < 200 else lo,
            after + 1 if after is not None and after - hi < 200 else hi,
        )

    lo, hi = snap(max(0, mid - half - 200), min(len(text), mid + half + 200))
    if hi - lo > limit:
        near = [p for p in (text.find(e, max(0, mid - 100), mid + 100) for e in ends) if p >= 0]
        if near:
            a = min(near, key=lambda p: abs(p - mid))
            lo, hi = snap(max(0, a - half), min(len(text), a + half))
    return text[lo:hi].strip()


def test_trim_to_sentences(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh     .?!。") if rng.random() < 0.1 else "x" for _ in range(n)) for n in (50, 999, 1001, 1500, 3000, 9000)]
    texts += ["no end at all " * 200, "。" * 2000]
    got = many(spark, texts, lambda c: tx.trim_to_sentences(c, 1000))
    assert got == [trimmed(t, 1000) for t in texts]


def test_abbreviations_in_one_pass(spark):
    df = spark.createDataFrame([("The GDP (XGDP) of GDP; naïve", {"GDP": "Gross CPI Product", "CPI": "no"})], "t string, m map<string,string>")
    row = df.select(
        tx.expand_abbreviations("t", "m").alias("all"), tx.expand_abbreviations("t", "m", first_only=True).alias("first"),
        tx.expand_abbreviations("t", "m", word_boundary=False).alias("loose"),
    ).first()
    assert row["all"] == "The GDP (Gross CPI Product) (XGDP) of GDP (Gross CPI Product); naïve"
    assert row["first"] == "The GDP (Gross CPI Product) (XGDP) of GDP; naïve"
    assert row["loose"] == row["all"]


def test_context_is_not_repeated(spark):
    df = spark.createDataFrame([("normal", "p.jpg", "cap", None, "around")], "c string, p string, k string, r array<struct<is_exact_match:boolean,reference_paragraph_extension:string>>, s string")
    plain = df.select(pr.assemble_context("c", "p", "k", "r", "s").alias("x")).first()["x"]
    twice = df.select(pr.assemble_context("c", "p", "k", "r", "s", repeat_surround=True).alias("x")).first()["x"]
    assert plain.count("around") == 1 + plain.count("surrounding") * 0 and twice.count(": around") == 2


def test_answers(spark):
    df = spark.createDataFrame([(0, " b ", {"A": "x", "B": "y"}), (1, "error 500", {"A": "x"}), (2, "B!", {"B": "x"}), (3, None, {"B": "x"})], "i int, r string, o map<string,string>")
    rows = df.select("i", ps.validate_answer("r", "o").alias("v"), ps.needs_retry("r", "o").alias("again")).orderBy("i").collect()
    assert [(r["v"]["answer"], r["v"]["valid"]) for r in rows] == [("B", True), ("error", True), ("B!", False), (None, False)]
    assert [r["again"] for r in rows] == [True, True, True, False]


def test_random_option_is_stable_and_valid(spark):
    df = spark.range(200).selectExpr("concat('bad', id) AS a", "map('A','x','B','y','C','z') AS o")
    picks = [r[0] for r in df.select(ps.random_option("a", "o")).collect()]
    assert picks == [r[0] for r in df.select(ps.random_option("a", "o")).collect()] and set(picks) == {"A", "B", "C"}


def test_template(spark):
    df = spark.createDataFrame([("q", None, 3)], "a string, b string, n int")
    got = df.select(pr.fill_template('Ask {a} [{b}] {n}: {"k": 1} {other}', a="a", b="b", n="n")).first()[0]
    assert got == 'Ask q [] 3: {"k": 1} {other}'


def test_headings_share_one_search(spark):
    pattern = tx.any_heading(tx.SECTION_HEADINGS)
    assert pattern.count("#") == 1
    apart = "(?iU)" + "|".join(f"(?:{h})" for h in tx.SECTION_HEADINGS)
    texts = ["## 图 目录", "# list  of\nfigures", "#3 Results", "# 3 resultsand", "#", "# # summary", "summary", "x # 图\u3000索 引", "#\xa0Conclusions", "", None]
    assert many(spark, texts, lambda x: x.rlike(pattern)) == many(spark, texts, lambda x: x.rlike(apart))
    # other marks, and lists whose parts are not one alternative each, are searched as they are
    for headings in (["# A|B", "# C"], ["A", r"#\s*B"], [r"#\s*?A"], [r"#\s*A|B"]):
        assert tx.any_heading(headings) == "(?iU)" + "|".join(f"(?:{h})" for h in headings)


def test_blanks_and_attributes_in_any_order(spark):
    texts = [" a  b\tc \t d\t \te", "x class= class=\"y\"'z' w", "width = '3'>", "width=3 'q'", "a=\"b\" STYLE\n=\n\"c\"d", "\t", "", None]
    want = ["a b c d e", "x w", ">", "width=3 'q'", "a=\"b\"d", "", "", None]
    assert many(spark, texts, tx.clean_html_tables) == want


def test_the_limit_of_a_trim_is_worked_out_once(spark):
    """And borders move to sentence ends less than 200 characters away, no farther."""
    assert str(tx.trim_to_sentences("x", F.col("limit_of_x"))).count("limit_of_x") == 1

    def cut(near, far):
        # the window of 1,400 characters around the middle starts at 1,300 and ends at 2,700
        t = ["x"] * 4000
        t[1300 - near], t[2700 + far] = ".", "."
        return "".join(t)

    texts = [cut(n, n) for n in (1, 199, 200, 201, 700)]
    got = many(spark, texts, lambda x: tx.trim_to_sentences(x, 1000))
    assert [len(g) for g in got] == [1402, 1798, 1400, 1400, 1400]
