
from figcorpus.operators import abbreviations as ab


def table(spark, *texts):
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "i int, book_id string, text string")
    return {r["abbreviation"]: r["full_form"] for r in ab.build_table(df, order=("i",)).collect()}


def test_full_forms(spark):
    assert table(spark, "the Gross Domestic Product (GDP) rose") == {"GDP": "Gross Domestic Product"}
    # skipped words stay in the phrase but carry no letter
    assert table(spark, "Bank of the West (BW) said") == {"BW": "Bank of the West"}
    # without parentheses: behind the abbreviation, and across it
    assert table(spark, "NPV means Net Present Value") == {"NPV": "Net Present Value"}
    assert table(spark, "NPV Net Present Value") == {"NPV": "Net Present Value"}
    assert table(spark, "Return On Assets ROA") == {}  # "on" is skipped, so no word gives the O
    assert table(spark, "Total Asset TAT Turnover") == {"TAT": "Total Asset Turnover"}


def test_rejected_forms(spark):
    assert table(spark, "Not Done (ND)") == {}  # a trivial pair
    assert table(spark, "Big USA Fund (BUF)") == {}  # a word in capitals
    assert table(spark, "Gross Product (GDP)") == {}  # too few words
    assert table(spark, "a 1 (AB)") == {}


def test_first_success_wins(spark):
    got = table(spark, "unclear SRI text", "Small Ring Index (SRI)", "Second Rate Idea (SRI)")
    assert got == {"SRI": "Small Ring Index"}


def test_window_of_fifteen_words(spark):
    near = " ".join(["filler"] * 12)
    # the letters must be those of the last words before the parenthesis
    assert table(spark, f"Earnings Per Share {near} (EPS)") == {}
    assert table(spark, f"{near} {near} Earnings Per Share (EPS)") == {}  # "per" is skipped
    assert table(spark, f"{near} Earnings Price Spread (EPS)") == {"EPS": "Earnings Price Spread"}


def test_texts_and_images(spark):
    t = spark.createDataFrame([("b", "GDP", "Gross Domestic Product")], "book_id string, abbreviation string, full_form string")
    texts = spark.createDataFrame([(1, "b", "GDP up"), (2, "c", "GDP up"), (3, "b", "none"), (4, "b", None)], "i int, book_id string, x string")
    got = {r["i"]: r["expanded"] for r in ab.expand_texts(texts, t, "x", ["i"]).collect()}
    assert got == {1: "GDP (Gross Domestic Product) up", 2: "GDP up", 3: "none", 4: None}
    images = spark.createDataFrame([(1, "b", ["GDP", "X", "GDP"]), (2, "b", ["X"]), (3, "c", ["GDP"]), (4, "b", [])], "i int, book_id string, acronyms array<string>")
    got = {r["i"]: r["matched_expansions"] for r in ab.match_acronyms(images, t, ["i"]).collect()}
    assert got == {1: {"GDP": "Gross Domestic Product"}, 2: {}, 4: {}}


def test_contexts(spark):
    ctx = spark.createDataFrame([(1, "The path of this image is: [p].\n\nrest"), (2, "plain")], "i int, contextual_information string")
    exp = spark.createDataFrame([(1, {"A": "b"}), (2, {}), (9, {})], "i int, matched_expansions map<string,string>")
    good, lost = ab.join_expansions(ctx, exp, ["i"])
    got = {r["i"]: r["contextual_information"] for r in good.collect()}
    assert got[1] == "The path of this image is: [p].\n\nAcronyms found in the image and their expansions:\n- A: b\n\nrest"
    assert got[2] == "plain\n\nNo acronyms were found in the image."
    assert [r["i"] for r in lost.collect()] == [9]
