"""Cases that a contract names: references that a document may not make for itself, letters, clashing columns."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import corpus_pipeline
from figcorpus.llm import langid, quality, toxicity
from figcorpus.llm.common import table

MID = "/root/testdata/sf0.01"


def test_a_document_is_no_reference_of_its_own(spark):
    docs = table(spark, MID, "documents").select("doc_id", "text", "lang")
    labels = table(spark, MID, "labels")
    junk = docs.join(labels.where("quality = 0"), "doc_id").orderBy("doc_id").limit(5).select("doc_id", "text", "lang").collect()
    rng = random.Random(1)
    nonsense = " ".join("".join(rng.choices("bcdfgklmnprstvz", k=7)) for _ in range(2000))
    rest = docs.where(~F.col("doc_id").isin([r.doc_id for r in junk]))

    def verdicts(lang):
        rows = [(r.doc_id, r.text, lang or r.lang) for r in junk] + [(-1, nonsense, lang)]
        got = quality.quality(rest.union(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")))
        return {r.doc_id: r.kept for r in got.where(F.col("doc_id").isin([x[0] for x in rows])).collect()}

    known, own = verdicts(None), verdicts("zz")
    assert not own[-1] and not known[-1]
    assert own == known


def test_the_only_long_document_of_a_language_is_left_out_of_it(spark):
    rng = random.Random(2)
    common = [(k, " ".join(rng.choices(["the", "of", "and", "to", "cat"], k=150)), "en") for k in range(40)]
    long_ = " ".join("".join(rng.choices("bcdfgklmnp", k=6)) for _ in range(20000))
    docs = spark.createDataFrame([*common, (99, long_, "en")], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in quality.quality(docs).where("word_distance > 0.5").collect()} >= {99}


def test_numbers_that_look_like_letters_are_none():
    assert not langid.has_letter("½ ² ① Ⅷ 12_3") and langid.has_letter("½a") and langid.has_letter("ß") and not langid.has_letter("")


def test_rows_without_id_are_sampled_by_their_text(spark):
    docs = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"), F.lit("en").alias("lang"))
    n = langid.sample(docs, langid.Settings(per_language=200, max_rows=200)).count()
    assert 100 < n < 300


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_carry_clashing_columns(spark, name, stage):
    docs = table(spark, MID, "documents").where("doc_id < 200")
    odd = ["key", "h", "copies", "cuts", "chunk", "row", "id", "size", "place", "fingerprint", "lang_pred", "__row", "trigger"]
    wide = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0)).cast("string")) for c in odd})
    got = stage(spark, wide, MID)
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in odd)


def test_more_entries_than_allowed_raise():
    toxicity._bounded([1], toxicity.Settings(max_entries=1))
    with pytest.raises(ValueError, match="entries"):
        toxicity._bounded([1, 2], toxicity.Settings(max_entries=1))
