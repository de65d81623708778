"""Quality rules: base counts, and the distance of a document's histograms from language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import durable, per_batch, query, table, text_buffer

#: Character classes, by the first byte of a character.
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other_ascii", "beyond_ascii")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x80:
        return 8 if byte < 0xC0 else 7  # 8: inside a character, not counted
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c in " \t\n\r\x0b\x0c":
        return 3
    if c in ".,;:!?'\"()-":
        return 4
    return 5 if byte in SYMBOLS else 6


_CLASS = np.array([_class_of(b) for b in range(256)], np.int64)


@dataclass(frozen=True)
class Settings:
    """Limits of the verdict.

    A word is common if it makes up ``common_share`` of a language's words; the
    histogram holds all that are. Histograms of fewer than ``min_words`` words
    or ``min_chars`` characters are not judged. A distance fails above its limit
    plus ``slack`` over the root of the number counted. ``word_limit`` lies
    between the farthest good text of the labelled rows (0.24 without slack) and
    a text without any common word (0.36). A language is a reference from
    ``ref_docs`` documents with words and ``ref_words`` words on, all of them
    counted; smaller ones give neither common words nor a distance. ``held_words`` are the counts that a
    task holds at once; results don't depend on it.
    """

    common_share: float = 0.004
    ref_docs: int = 20
    ref_words: int = 2_000
    held_words: int = 500_000
    min_words: int = 50
    min_chars: int = 300
    class_limit: float = 0.25
    word_limit: float = 0.30
    slack: float = 1.0


def _ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64), known


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first occurrence included.

    ``window`` must be a power of two: windows of double length are named by
    the ranks of their halves, so equal names mean equal words.
    """
    if len(ids) < window + 1 or distinct == len(ids):
        return 0
    names, span, n = ids, 1, distinct
    while span < window:
        pairs = names[: len(names) - span] * n + names[span:]
        _, names = np.unique(pairs, return_inverse=True)
        n, span = int(names.max()) + 1, span * 2
        if n == len(names):
            return 0
    again = np.bincount(names, minlength=n)[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def common_words(docs: DataFrame, settings: Settings) -> list[str]:
    """The words that make up ``common_share`` of the words of some reference language, counted over all documents.

    A task adds its batches up and gives off its counts whenever it holds
    ``held_words`` of them; sums over all tasks decide, so neither batches nor
    partitions matter. A language has at most 1 / ``common_share`` such words.
    """

    def rows(counts: dict[str, Counter], docs_of: Counter) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            # the language's total is the row without a word, its documents that of the empty word
            words, n = [None, b"", *c], [sum(c.values()), docs_of[lang], *c.values()]
            langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(words), np.int32)))
            yield pa.RecordBatch.from_arrays([langs, pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        docs_of: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.lower().split() if lang is not None and text else []
                if words:
                    counts.setdefault(lang, Counter()).update(words)
                    docs_of[lang] += 1
            if sum(map(len, counts.values())) >= settings.held_words:
                yield from rows(counts, docs_of)
                counts, docs_of = {}, Counter()
        yield from rows(counts, docs_of)

    found = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, word binary, n bigint")
    summed = durable(found.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    enough = summed.where("length(word) = 0").where(F.col("n") >= settings.ref_docs).select("lang")
    totals = summed.where("word is null").where(F.col("n") >= settings.ref_words).select("lang", F.col("n").alias("total")).join(enough, "lang")
    common = summed.where("length(word) > 0").join(totals, "lang").where(F.col("n") >= F.lit(settings.common_share) * F.col("total"))
    return sorted(bytes(r.word).decode() for r in common.select("word").distinct().collect())


_BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
BASE_COLUMNS = [x.split()[0] for x in _BASE.split(", ")]


def counts(docs: DataFrame, words: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(\\*keep, base counts, class histogram, histogram of ``words`` and the rest) of every whole text."""
    common = {w.encode(): k for k, w in enumerate(words)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.num_columns - 1)
        data, ends = text_buffer(column)
        n = len(ends) - 1
        classes = np.zeros((n, 8), np.int64)
        base = np.zeros((n, 5), np.int64)
        rows, places, values = [], [], []
        for i in range(n):
            lo, hi = int(ends[i]), int(ends[i + 1])
            if lo == hi:
                continue
            by = np.bincount(_CLASS[data[lo:hi]], minlength=9)[:8]
            classes[i] = by
            text = data[lo:hi].tobytes()
            list_ = text.split()
            base[i, 0] = len(list_)
            base[i, 1] = by.sum() - by[3]
            base[i, 2] = by[5]
            base[i, 3] = repeated_lines(text)
            ids, known = _ids(list_)
            base[i, 4] = repeated_words(ids, len(known))
            lowered = Counter(text.lower().split()) if common else {}
            for w in lowered.keys() & common.keys():
                rows.append(i)
                places.append(common[w])
                values.append(lowered[w])
        per_row = np.bincount(np.array(rows, np.int64), minlength=n) if n else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(per_row)], pa.int32())
        out = [pa.array(base[:, k]) for k in range(5)]
        out.append(pa.FixedSizeListArray.from_arrays(pa.array(classes.reshape(-1)), 8).cast(pa.list_(pa.int64())))
        out.append(pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())))
        out.append(pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*keep, *BASE_COLUMNS, "classes", "places", "times"])

    rows = docs.select(*keep, "text")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(per_batch(run), f"{kinds}{_BASE}, classes array<bigint>, places array<int>, times array<bigint>")


def references(counted: DataFrame, n_words: int, settings: Settings) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and word counts of each reference language, summed over all its documents."""
    known = counted.where("lang is not null and n_words > 0")
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(8)]
    large = known.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_words").alias("n"), *sums)
    large = durable(large.where((F.col("docs") >= settings.ref_docs) & (F.col("n") >= settings.ref_words)))
    classes = {r.lang: r for r in large.collect()}
    pairs = known.select("lang", F.explode(F.arrays_zip("places", "times")).alias("z"))
    summed = pairs.groupBy("lang", "z.places").agg(F.sum("z.times").alias("n"))
    listed = summed.join(large.select("lang"), "lang", "left_semi").collect()  # reference languages x common words
    of_lang: dict[str, list[tuple[int, int]]] = {}
    for x in listed:
        of_lang.setdefault(x.lang, []).append((x.places, x.n))
    out = {}
    for lang, r in classes.items():
        by_class = np.array([r[f"c{k}"] for k in range(8)], float)
        by_word = np.zeros(n_words + 1)
        for place, times in of_lang.get(lang, []):
            by_word[place] = times
        by_word[n_words] = max(0.0, r.n - by_word.sum())
        if by_class.sum() and by_word.sum():
            out[lang] = (by_class, by_word)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` from the distribution ``q``."""
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(1)

    return np.sqrt(np.maximum(0.0, (part(p) + part(np.broadcast_to(q, p.shape))) / 2))


def sparse_js_distance(rows: np.ndarray, share: np.ndarray, n: int, there: np.ndarray) -> np.ndarray:
    """As :func:`js_distance` for ``n`` rows that hold ``share`` at some places and nothing elsewhere.

    ``there`` is what the other distribution, one for each row, holds at these places.
    """
    m = (share + there) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(share > 0, share * np.log2(share / m), 0.0) + np.where(there > 0, there * np.log2(there / m), 0.0)
    # a place that the row lacks adds what the other holds, which is 1 in all
    return np.sqrt(np.maximum(0.0, (np.bincount(rows, both - there, n) + 1.0) / 2))


def judge(counted: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]], n_words: int, settings: Settings, keep: tuple[str, ...]) -> DataFrame:
    """Adds ``base_failed``, the distances from the nearest reference (null where guarded) and ``kept``.

    A document of a reference's own language meets what the others of that language hold.
    """
    names = sorted(refs)

    def nearest(n: int, distances: Iterator[np.ndarray]) -> np.ndarray:
        return reduce(np.minimum, distances) if names else np.zeros(n)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        n = batch.num_rows
        base = {k: col[k].to_numpy(zero_copy_only=False) for k in BASE_COLUMNS}
        classes = np.array(col["classes"].to_pylist(), float).reshape(n, 8)
        at = np.repeat(np.arange(n), col["places"].value_lengths().to_numpy(zero_copy_only=False))
        places = col["places"].flatten().to_numpy(zero_copy_only=False)
        times = col["times"].flatten().to_numpy(zero_copy_only=False).astype(float)
        rest = np.maximum(0, base["n_words"] - np.bincount(at, times, n))
        # the words that are not common stand at the last place of every row
        at, places, times = np.r_[at, np.arange(n)], np.r_[places, np.full(n, n_words)], np.r_[times, rest]
        share = times / np.maximum(1, np.bincount(at, times, n))[at]
        failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
        chars = classes.sum(1)
        by_class = classes / np.maximum(1, chars[:, None])
        lang = np.array(col["lang"].to_pylist(), object)
        totals = np.bincount(at, times, n)

        def class_distance(k: str) -> np.ndarray:
            others = refs[k][0] - classes * (lang == k)[:, None]
            left = others.sum(1, keepdims=True)
            return np.where(left[:, 0] > 0, js_distance(by_class, others / np.maximum(1, left)), np.inf)

        def word_distance(k: str) -> np.ndarray:
            own = lang == k
            left = refs[k][1].sum() - totals * own
            there = (refs[k][1][places] - times * own[at]) / np.maximum(1, left)[at]
            return np.where(left > 0, sparse_js_distance(at, share, n, there), np.inf)

        d_class = nearest(n, map(class_distance, names))
        d_word = nearest(n, map(word_distance, names))
        long_chars, long_words = chars >= settings.min_chars, base["n_words"] >= settings.min_words
        bad = long_chars & (d_class > settings.class_limit + settings.slack / np.sqrt(np.maximum(1, chars)))
        bad |= long_words & (d_word > settings.word_limit + settings.slack / np.sqrt(np.maximum(1, base["n_words"])))
        out = [col[k] for k in keep] + [col[k] for k in BASE_COLUMNS]
        out += [pa.array(failed), pa.array(~failed & ~bad)]
        out += [pa.array(d_class, mask=~long_chars), pa.array(d_word, mask=~long_words)]
        return pa.RecordBatch.from_arrays(out, [*keep, *BASE_COLUMNS, "base_failed", "kept", "class_distance", "word_distance"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counted.schema.fields if f.name in keep)
    return counted.mapInArrow(
        per_batch(run), f"{kinds}{_BASE}, base_failed boolean, kept boolean, class_distance double, word_distance double"
    )


def quality(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Base counts and verdict of every row of ``docs(doc_id, text, lang)``.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated
    windows of 8 words. Others fail if their class or common-word histogram is
    far from the reference of every language that is large enough for one;
    ``lang`` says which documents make up a reference, and a document's own
    counts are taken out of its language's before the two meet. Null text
    counts as empty. Short histograms are not judged; texts of any length are
    counted whole. Without a reference nothing is judged but the base. Repeated
    rows count again, an empty table gives no rows, other columns are not looked at.
    """
    words = common_words(docs, settings)
    counted = durable(counts(docs, words, ("doc_id", "lang")))
    return judge(counted, references(counted, len(words), settings), len(words), settings, ("doc_id",))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
