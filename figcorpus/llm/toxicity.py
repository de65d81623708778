"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from figcorpus.llm.common import durable, fold_of, per_batch, query, table, texts

#: Letters of other scripts that look like Latin ones, and what they stand for.
_LOOKALIKES = dict(zip("авеёкмнорстухіјѕґԁԛԝһαβεικνορτυχγωı", "abeekmhopctyxijsrdqwhabeiknoptuxywi"))
#: Digits and signs that stand for letters inside a word.
_DIGITS = dict(zip("01345789@$", "oieastbgas"))
_NOT_SHOWN = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


class _Fold(dict):
    """Maps a character to its lower-case Latin look-alike, everything that is no letter to a space; hidden ones go."""

    def __missing__(self, code: int):
        if code in _NOT_SHOWN or unicodedata.combining(chr(code)):
            out = None
        else:
            plain = unicodedata.normalize("NFKC", chr(code)).lower()
            plain = "".join(_LOOKALIKES.get(c, c) for c in plain)
            out = plain if plain.isalpha() else plain if plain in _DIGITS else " "
        self[code] = out
        return out


_FOLD = _Fold()
_NEAR_LETTER = re.compile(r"(?<=[^\W\d_])[013457893@$]+(?=[^\W\d_])|(?<![^\W_])[01345789@$]+(?=[^\W\d_])|(?<=[^\W\d_])[01345789]+(?![^\W_])")
_SIGNS = re.compile(r"[\d@$]")
_AS_LETTERS = str.maketrans(_DIGITS)
_AS_SPACE = dict.fromkeys(map(ord, "0123456789@$"), " ")


def fold(text: str) -> list[str]:
    """The words of a text in lower case, look-alikes and digit spellings read as letters.

    Digits count as letters only in a word that has some; a number stays out.
    Signs count only between letters or before one.
    """
    text = unicodedata.normalize("NFC", text) if not text.isascii() else text
    text = text.translate(_FOLD)
    if _SIGNS.search(text):
        text = _NEAR_LETTER.sub(lambda m: m[0].translate(_AS_LETTERS), text).translate(_AS_SPACE)
    return text.split()


@dataclass(frozen=True)
class Settings:
    """Bounds of the training. ``max_labelled`` bounds the labelled rows; more than ``max_entries`` entries or exceptions raise an error."""

    max_labelled: int = 30_000
    max_entries: int = 100_000
    prefix: tuple[int, int] = (4, 8)
    min_word: int = 3
    min_rows: int = 4
    min_z: float = 7.0
    min_weight: float = 1.5
    smooth: float = 0.5
    seed: int = 5


@dataclass(frozen=True)
class Model:
    """``lexicon``: folded entry to weight; ``" word "`` is a whole word, ``" begin"`` the beginning of one.

    ``exceptions`` are folded phrases between spaces; entries found inside one
    do not count. ``slopes`` weigh the evidence, its density and whether there
    is any.
    """

    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    slopes: tuple[float, float, float]
    bias: float


def build(entries, exceptions=()) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for e, w in dict(entries).items():
        machine.add_word(e, (len(e), w))
    for e in exceptions:
        if e not in machine:
            machine.add_word(e, (len(e), None))
    if len(machine):
        machine.make_automaton()
    return machine


def evidence(words: list[str], machine: ahocorasick.Automaton) -> tuple[float, float, float]:
    """log(1 + weight), log(1 + weight per 100 words), and whether an entry was found outside the exceptions.

    Of entries that begin at the same word the heaviest counts.
    """
    if not words or not len(machine):
        return 0.0, 0.0, 0.0
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in machine.iter(f" {' '.join(words)} "):
        if weight is None:
            spared.append((end - size + 1, end))
        else:
            at = end - size + 1
            hits[at] = max(weight, hits.get(at, 0.0))
    if spared:
        starts = np.array(list(hits), np.int64)
        lo, hi = np.array(spared).T
        order = np.argsort(lo)
        lo, reach = lo[order], np.maximum.accumulate(hi[order])
        k = np.searchsorted(lo, starts, "right") - 1
        inside = (k >= 0) & (reach[np.maximum(k, 0)] > starts)
        for s in starts[inside].tolist():
            del hits[s]
    total = sum(hits.values())
    return math.log1p(total), math.log1p(100 * total / len(words)), float(bool(hits))


def terms(words: list[str], settings: Settings) -> set[str]:
    """The lexicon entries that a text could give: its words and their beginnings."""
    lo, hi = settings.prefix
    out = set()
    for w in set(words):
        if len(w) >= settings.min_word:
            out.add(f" {w} ")
        for n in range(lo, min(hi, len(w) - 1) + 1):
            out.add(f" {w[:n]}")
    return out


def _sketch(words: list[str]) -> int:
    """Smallest hash of the text's word pairs: near copies mostly share it."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or {" ".join(words)}
    return min(xxh64_intdigest(p) for p in pairs) & ((1 << 63) - 1)


def _training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Bounded sample of labelled texts (doc_id, toxic, words), one of each group of near copies."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = known.orderBy(F.xxhash64("doc_id", F.lit(settings.seed)), "doc_id").limit(settings.max_labelled)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [fold(t) for t in texts(batch.column(2))]
        sketch = [_sketch(w) for w in words]
        joined = [" ".join(w) for w in words]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined), pa.array(sketch, pa.int64())], ["doc_id", "toxic", "words", "sketch"])

    # limit() above proves the size: max_labelled rows of two integers
    rows = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    folded = rows.mapInArrow(per_batch(run), "doc_id bigint, toxic int, words string, sketch bigint")
    one = folded.groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "words")).alias("x"))
    return durable(one.select("x.doc_id", "toxic", "x.words"))


def _presence(rows: DataFrame, emit) -> DataFrame:
    """(term, toxic rows, clean rows) over the learning rows; a batch sends each of its terms once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        for toxic, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for t in emit(joined.split()):
                counts.setdefault(t, [0, 0])[1 if toxic else 0] += 1
        names = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[t][1] for t in names], pa.int64()), pa.array([counts[t][0] for t in names], pa.int64())],
            ["term", "bad", "fine"],
        )

    found = rows.select("toxic", "words").mapInArrow(per_batch(run), "term string, bad bigint, fine bigint")
    return found.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Slopes and bias by Newton steps with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _bounded(rows: list, settings: Settings) -> None:
    if len(rows) > settings.max_entries:
        raise ValueError(f"more than {settings.max_entries} entries")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn lexicon, exceptions and slopes from ``labels(doc_id, toxic)`` and the texts of ``docs``.

    An entry's weight is its smoothed log odds in toxic against clean rows, for
    entries whose count in toxic rows stands out by ``min_z`` deviations.
    Exceptions are whole words and pairs of neighbours around an entry that
    clean rows have several times and toxic ones never. No labels, or labels of
    one kind, give an empty lexicon and the score of the base rate.
    """
    rows = _training_rows(docs, labels, settings)
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n, bad = totals.n, totals.bad
    base = (bad + 0.5) / (n + 1)
    empty = Model({}, (), (0.0, 0.0, 0.0), math.log(base / (1 - base)))
    if not bad or bad == n:
        return empty
    learn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(settings.seed + 1)), F.lit(4)) != 0)
    sums = learn.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if not sums.bad or sums.bad == sums.n:
        learn, sums = rows, totals
    n_bad, n_fine = sums.bad, sums.n - sums.bad
    p = n_bad / sums.n
    seen = F.col("bad") + F.col("fine")
    z = (F.col("bad") - seen * p) / F.sqrt(seen * p * (1 - p))
    weight = F.log((F.col("bad") + settings.smooth) / (n_bad + 1)) - F.log((F.col("fine") + settings.smooth) / (n_fine + 1))
    best = (
        _presence(learn, lambda words: terms(words, settings))
        .where(F.col("bad") >= settings.min_rows)
        .withColumns({"z": z, "weight": weight})
        .where((F.col("z") >= settings.min_z) & (F.col("weight") >= settings.min_weight))
        .orderBy(F.desc("z"), "term")
        .limit(settings.max_entries + 1)
        .collect()
    )
    _bounded(best, settings)
    weights = {r.term: float(r.weight) for r in best}
    counts = {r.term: (r.bad, r.fine) for r in best}
    lexicon = {t: weights[t] for t in telling(counts)}
    if not lexicon:
        return empty
    whole = build(lexicon)

    def around(words: list[str]) -> set[str]:
        line, out = f" {' '.join(words)} ", set()
        starts, at = {}, 0
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w) + 1
        for end, (size, _) in whole.iter(line):
            i = starts[end - size + 1]
            out.add(f" {words[i]} ")
            if i:
                out.add(f" {words[i - 1]} {words[i]} ")
            if i + 1 < len(words):
                out.add(f" {words[i]} {words[i + 1]} ")
        return out

    spared = (
        _presence(learn, around)
        .where((F.col("bad") == 0) & (F.col("fine") >= settings.min_rows))
        .orderBy(F.desc("fine"), "term")
        .limit(settings.max_entries + 1)
        .collect()
    )
    _bounded(spared, settings)
    exceptions = tuple(sorted(r.term for r in spared))
    machine_of = (dict(lexicon), exceptions)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = build(*machine_of)
        found = np.array([evidence(x.split(), machine) for x in batch.column(1).to_pylist()]).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in found.T]], ["toxic", "a", "b", "c"])

    seen_rows = rows.select("toxic", "words").mapInArrow(per_batch(measure), "toxic int, a double, b double, c double")
    x = seen_rows.toPandas().to_numpy(float)  # max_labelled rows of numbers
    x = x[np.lexsort(x.T)]  # sums in one order, so reruns agree
    w = _logistic(x[:, 1:], x[:, 0])
    return Model(lexicon, exceptions, tuple(map(float, w[:3])), float(w[3]))


def telling(counts: dict[str, tuple[int, int]]) -> set[str]:
    """The entries that say something of their own, from (toxic rows, clean rows) of each.

    An entry goes where a shorter beginning finds more toxic rows and hardly
    more clean ones, and where a longer entry finds the very same rows.
    """
    out = set(counts)
    for term, (bad, fine) in counts.items():
        word = term.strip()
        for n in range(3, len(word) + (term[-1] == " ")):
            shorter = f" {word[:n]}"
            if shorter not in counts:
                continue
            more, worse = counts[shorter]
            if (more, worse) == (bad, fine):
                out.discard(shorter)
            elif more > bad and worse <= fine + 0.01 * more:
                out.discard(term)
    return out


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, \\*keep, score) of every whole text: 0 to 1, the probability of label 1.

    Null and empty texts, and texts without a letter, have no evidence and get
    the score that the bias alone gives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most twice max_entries phrases
    columns = ["doc_id", *keep]

    def run(batches):
        m = shared.value
        machine = build(m.lexicon, m.exceptions)
        slopes = np.array(m.slopes)
        for batch in batches:
            found = np.array([evidence(fold(t), machine) for t in texts(batch.column(batch.num_columns - 1))]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(found @ slopes + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], [*columns, "score"])

    rows = docs.select(*columns, "text")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}score double")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold_of("doc_id", 5) != 0))
    held = fold_of("doc_id", 5) == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
