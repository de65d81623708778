"""Abbreviation tables: find full forms in the text, join them back to texts and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import text as tx

# fixed values: words that carry no letter of an abbreviation
SKIP_WORDS = (
    "a an the and or but nor for yet so at by in of on to up as is it if be do we he she they them us "
    "with from into onto upon over under out off via per etc vs v"
).split()
# fixed values: words that alone make no two-letter abbreviation
COMMON_WORDS = "no not of on in at to for from by or and the a an".split()
# fixed values: two letters that are words rather than abbreviations
TRIVIAL_PAIRS = ["ND", "OF", "FO", "BY", "IN", "AT", "TO", "FR"]

_WORDS_PARENTHESISED = 15
_WORDS_NEAR = 10


def _is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def initials_match(abbr: Column, words: Column) -> Column:
    """One word per letter, same initials, no word in capitals, no trivial two-letter pair."""
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), "")
    two = F.length(abbr) == 2
    trivial = two & initials.isin(TRIVIAL_PAIRS)
    common = two & F.forall(words, lambda w: F.lower(w).isin(COMMON_WORDS))
    return (
        (F.size(words) == F.length(abbr))
        & (initials == abbr)
        & ~trivial
        & ~common
        & ~F.exists(words, _is_upper)
    )


def _content(words: Column) -> Column:
    """Words that count, with their places: array<struct<w,i>>."""
    return F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: ~F.lower(x["w"]).isin(SKIP_WORDS),
    )


def _phrase(abbr: Column, words: Column, picked: Column) -> Column:
    """The phrase from the first to the last picked word when the initials fit, else NULL."""
    first, last = F.get(picked, F.lit(0))["i"], F.element_at(picked, -1)["i"]
    fits = (F.size(picked) == F.length(abbr)) & initials_match(abbr, F.transform(picked, lambda x: x["w"]))
    return F.when(fits, F.array_join(F.slice(words, first + 1, last - first + 1), " "))


def full_form(abbr: Column, before: Column, after: Column, in_parentheses: Column) -> Column:
    """Full form for one occurrence, NULL when no phrase around it fits.

    ``before`` holds the words in front, nearest last, ``after`` those behind.
    """
    n = F.length(abbr)

    def last_n(words):
        return tx.bind(
            _content(words),
            lambda c: F.when(F.size(c) >= n, _phrase(abbr, words, F.slice(c, F.size(c) - n + 1, n))),
        )

    def first_n(words):
        return tx.bind(_content(words), lambda c: F.when(F.size(c) >= n, _phrase(abbr, words, F.slice(c, F.lit(1), n))))

    def any_n(words):
        return tx.bind(
            _content(words),
            lambda c: F.when(
                F.size(c) >= n,
                F.get(
                    F.filter(
                        F.transform(
                            F.sequence(F.lit(1), F.size(c) - n + 1), lambda k: _phrase(abbr, words, F.slice(c, k, n))
                        ),
                        lambda p: p.isNotNull(),
                    ),
                    F.lit(0),
                ),
            ),
        )

    def tail(words, k):
        return F.slice(words, F.greatest(F.size(words) - k, F.lit(0)) + 1, F.lit(k))

    near = tail(before, _WORDS_NEAR)
    return F.coalesce(
        F.when(in_parentheses, last_n(before)),
        last_n(near),
        first_n(after),
        any_n(F.concat(near, after)),
    )


def abbreviation_occurrences(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """One row per run of two or more capitals with the words around it.

    Words are cut once per document; an occurrence only carries the 15 words before it
    and the 10 after, taken inside the document's row.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\(?\w+\)?)"), F.lit(1))
    cut = docs.where(F.col(text).rlike("[A-Z]{2}")).select(
        *keys, pieces.alias("_pieces"), F.transform(pieces, lambda p: F.btrim(p, F.lit("()"))).alias("_words")
    )
    words = F.col("_words")

    def around(w, i):
        return F.struct(
            i.alias("pos"),
            w.alias("abbreviation"),
            F.slice(words, F.greatest(i - _WORDS_PARENTHESISED, F.lit(0)) + 1, F.least(i, F.lit(_WORDS_PARENTHESISED))).alias(
                "before"
            ),
            F.slice(words, i + 2, F.lit(_WORDS_NEAR)).alias("after"),
            F.get("_pieces", i).rlike(r"^\(.*\)$").alias("in_parentheses"),
        )

    hits = F.filter(
        F.transform(words, lambda w, i: F.when(w.rlike("^[A-Z]{2,}$"), around(w, i))), lambda x: x.isNotNull()
    )
    return cut.select(*keys, F.explode(hits).alias("o")).select(*keys, "o.*")


def build_table(docs: DataFrame, text: str = "text", book: str = "book_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Abbreviation table per book; the first occurrence with a fitting phrase wins.

    Occurrences that found nothing are dropped before the one shuffle, and min_by merges
    on the map side, so a hot book costs one row per abbreviation and task.
    """
    keys = (book, *order)
    found = abbreviation_occurrences(docs, text, keys).withColumn(
        "full_form", full_form(F.col("abbreviation"), F.col("before"), F.col("after"), F.col("in_parentheses"))
    )
    place = F.struct(*order, "pos")
    return (
        found.where("full_form IS NOT NULL")
        .groupBy(book, "abbreviation")
        .agg(F.min_by("full_form", place).alias("full_form"), F.min(place).alias("first_pos"))
    )


def expand_texts(
    texts: DataFrame, table: DataFrame, text: str, key: list[str], book: str = "book_id", out: str = "expanded", **how
) -> DataFrame:
    """Texts with their book's abbreviations written out; texts without a table stay as they are.

    Only the abbreviations that occur in a text are looked up: the joined key is (book,
    abbreviation), so no book's whole table is gathered or broadcast, and a hot book's
    lookups spread over its abbreviations.
    """
    found = texts.where(F.col(text).rlike("[A-Z]{2}")).select(
        *key,
        book,
        F.explode(
            F.array_distinct(
                F.regexp_extract_all(F.col(text), F.lit(r"([A-Z]{2,})"), F.lit(1))
            )
        ).alias("abbreviation"),
    )
    maps = (
        found.join(table.select(book, "abbreviation", "full_form"), [book, "abbreviation"])
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("abbreviation", "full_form"))).alias("_map"))
    )
    return texts.join(maps, key, "left").withColumn(out, tx.expand_abbreviations(text, "_map", **how)).drop("_map")


def match_acronyms(images: DataFrame, table: DataFrame, key: list[str], book: str = "book_id") -> DataFrame:
    """Expansions of the acronyms seen in each image; images of books without a table are
    dropped, images without a match keep an empty map."""
    with_table = images.join(table.select(book).distinct(), book, "left_semi")
    seen = with_table.select(*key, book, F.posexplode_outer("acronyms").alias("_pos", "abbreviation"))
    first = seen.groupBy(*key, book, "abbreviation").agg(F.min("_pos").alias("_pos"))
    hits = first.join(table.select(book, "abbreviation", "full_form"), [book, "abbreviation"], "left")
    entry = F.when(F.col("full_form").isNotNull(), F.struct("_pos", "abbreviation", "full_form"))
    return hits.groupBy(*key, book).agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["abbreviation"], e["full_form"])
            )
        ).alias("matched_expansions")
    )


def join_expansions(contexts: DataFrame, expansions: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(contexts with their expansions inserted, expansions whose context is missing)."""
    good = contexts.join(expansions.select(*key, "matched_expansions"), key).withColumn(
        "contextual_information", tx.insert_block("contextual_information", "matched_expansions")
    )
    lost = expansions.join(contexts.select(*key), key, "left_anti").withColumn("error", F.lit("context missing"))
    return good, lost
