"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import fold_of, per_batch, query, table, text_buffer

ORDERS = (2, 3, 4)
#: Bytes of text whose subwords a task holds at once.
CHUNK = 1 << 18
_WORD_CHAR = re.compile(r"[^\W\d_]")
# everything in ASCII that is not a letter separates words
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of the training; the sample is bounded in rows, and in subwords of each row.

    ``max_rows`` are shared out among the languages; a language learns about
    ``least`` rows even if that is more, or all it has. A row's ``max_subwords``
    are drawn from its whole text. A small sample is gone through more often,
    ``min_steps`` batches in all.
    """

    per_language: int = 1500
    max_rows: int = 12000
    least: int = 30
    max_subwords: int = 4096
    bits: int = 16
    dim: int = 16
    epochs: int = 6
    min_steps: int = 1200
    batch: int = 32
    rate: float = 20.0
    per_step: int = 256
    calibration: float = 0.2
    reject_below: float = 0.35
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``table[h]`` holds the logits that subword bucket h adds; a text's logits are their mean.

    With more languages than dimensions it holds embeddings instead, and ``head`` makes logits of their mean.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int
    head: np.ndarray | None = None


def subwords(text: np.ndarray, bits: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the ``order`` bytes from each position, and whether they are a subword.

    A subword may touch the space before or behind its word, but not run over
    two words or consist of the gap between them.
    """
    n = max(0, len(text) - order + 1)
    code = np.zeros(n, np.uint32)
    space = text == 32
    inner = np.zeros(n, bool)
    for i in range(order):
        code |= text[i : i + n].astype(np.uint32) << np.uint32(8 * i)
        if 0 < i < order - 1:
            inner |= space[i : i + n]
    ok = ~inner & ~(space[:n] & space[order - 1 : order - 1 + n])
    hashed = (code ^ np.uint32(0x9E3779B9 * order & 0xFFFFFFFF)) * np.uint32(2654435761)
    return (hashed >> np.uint32(32 - bits)).astype(np.int64), ok


def plain_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 with a space for whatever separates words; every text stands between spaces of its own."""
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    lowered = pc.utf8_lower(column.fill_null("").cast(pa.large_string()))
    data, ends = text_buffer(pc.binary_join_element_wise(empty, lowered, empty, space))
    return _PLAIN[data], ends


def _features(text: str, bits: int) -> np.ndarray:
    data, _ = plain_bytes(pa.array([text]))
    found = []
    for order in ORDERS:
        ids, ok = subwords(data, bits, order)
        found.append(ids[ok])
    return np.concatenate(found)


def drawn(text: str, settings: Settings) -> np.ndarray:
    """At most ``max_subwords`` buckets of the whole text's subwords: a seeded draw from all positions, piece by piece."""
    data, _ = plain_bytes(pa.array([text]))
    rng = np.random.default_rng([settings.seed, zlib.crc32(data.tobytes())])
    keys, kept = np.zeros(0), np.zeros(0, np.int64)
    for lo in range(0, len(data), CHUNK):
        for order in ORDERS:
            ids, ok = subwords(data[lo : lo + CHUNK + order - 1], settings.bits, order)
            keys, kept = np.r_[keys, rng.random(int(ok.sum()))], np.r_[kept, ids[ok]]
            if len(keys) > settings.max_subwords:
                # the smallest keys of all positions so far
                at = np.sort(np.argpartition(keys, settings.max_subwords)[: settings.max_subwords])
                keys, kept = keys[at], kept[at]
    return kept.astype("<u2" if settings.bits <= 16 else "<u4")


def train(rows: list[tuple[str, str]], settings: Settings = Settings()) -> Model:
    """Fit on (text, language) rows, see :func:`learn`."""
    return learn([(drawn(text, settings), lang) for text, lang in rows], settings)


def learn(rows: list[tuple[np.ndarray, str]], settings: Settings = Settings()) -> Model:
    """Fit on (subword buckets, language) rows by stochastic gradient descent; a share of them calibrates.

    Embeddings and softmax are trained together, then multiplied, since the
    logits of a mean are the mean of the logits. The temperature minimises the
    log loss of the calibration rows. Rows should come in a fixed order.
    """
    languages = tuple(sorted({lang for _, lang in rows}))
    if not languages:
        return Model((), np.zeros((1 << settings.bits, 0), np.float32), np.zeros(0), 1.0, settings.bits)
    rng = np.random.default_rng(settings.seed)
    where = {lang: i for i, lang in enumerate(languages)}
    examples = [(ids, where[lang]) for ids, lang in rows if len(ids)]
    order = rng.permutation(len(examples))
    n_cal = int(len(examples) * settings.calibration)
    held, learn = order[:n_cal], order[n_cal:]
    emb = rng.normal(0, 1 / settings.dim, (1 << settings.bits, settings.dim)).astype(np.float32)
    out = np.zeros((settings.dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    per_epoch = -(-len(learn) // settings.batch)
    epochs = max(settings.epochs, -(-settings.min_steps // max(1, per_epoch))) if per_epoch else 0
    steps, done = max(1, epochs * per_epoch), 0
    for _ in range(epochs):
        for at in range(0, len(learn), settings.batch):
            rate = settings.rate * max(0.02, 1 - done / steps)
            done += 1
            rows_ = [examples[i] for i in rng.permutation(learn[at : at + settings.batch])]
            picked = [x if len(x) <= settings.per_step else x[rng.integers(0, len(x), settings.per_step)] for x, _ in rows_]
            sizes = np.array([len(x) for x in picked])
            flat = np.concatenate(picked)
            mean = np.add.reduceat(emb[flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]
            logits = mean @ out + bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(rows_)), [y for _, y in rows_]] -= 1
            prob /= len(rows_)
            back = (prob @ out.T) / sizes[:, None]
            out -= np.float32(rate * 0.05) * (mean.T @ prob)
            bias -= np.float32(rate * 0.05) * prob.sum(0)
            np.add.at(emb, flat, np.repeat(-rate * back, sizes, axis=0).astype(np.float32))
    wide = len(languages) > settings.dim
    table, head = (emb, out) if wide else ((emb @ out).astype(np.float32), None)
    model = Model(languages, table, bias.astype(np.float64), 1.0, settings.bits, head)
    if not n_cal:
        return model
    means = np.array([table[examples[i][0]].mean(0) for i in held])
    scores = ((means @ head if wide else means) + bias).astype(np.float64)
    truth = np.array([examples[i][1] for i in held])
    grid = np.geomspace(0.2, 20, 61)
    loss = [_log_loss(scores / t, truth) for t in grid]
    return replace(model, temperature=float(grid[int(np.argmin(loss))]))


def _log_loss(logits: np.ndarray, truth: np.ndarray) -> float:
    top = logits.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(logits - top).sum(1)) + top[:, 0] - logits[np.arange(len(truth)), truth]))


def _pieces(ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first row, last row, from, to) of pieces of about CHUNK bytes; a longer text is cut into several."""
    out, row, n = [], 0, len(ends) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1)
        if last == row + 1:
            for at in range(int(ends[row]), int(ends[row + 1]), CHUNK):
                out.append((row, last, at, min(int(ends[row + 1]), at + CHUNK)))
        else:
            out.append((row, last, int(ends[row]), int(ends[last])))
        row = last
    return out


def logits(column: pa.Array, model: Model) -> np.ndarray:
    """Mean logits of every whole text, piece by piece; rows without subwords have the bias alone."""
    data, ends = plain_bytes(column)
    n = len(ends) - 1
    total, count = np.zeros((n, model.table.shape[1])), np.zeros(n, np.int64)
    for first, last, lo, hi in _pieces(ends):
        bounds = np.clip(ends[first : last + 1], lo, hi) - lo
        for order in ORDERS:
            # a piece of a longer text reads on into the next one, so no subword is lost or counted twice
            stop = min(hi + order - 1, int(ends[last]))
            ids, ok = subwords(data[lo:stop], model.bits, order)
            lim = np.minimum(np.maximum(bounds[1:] - (0 if last == first + 1 else order - 1), bounds[:-1]), len(ids))
            lim = np.maximum(lim, np.minimum(bounds[:-1], len(ids)))
            if last > first + 1:
                # subwords that would run into the next text of the piece
                inside = np.zeros(len(ids) + 1, np.int64)
                starts = np.minimum(bounds[:-1], len(ids))
                np.add.at(inside, starts, 1)
                np.add.at(inside, lim, -1)
                ok &= np.cumsum(inside)[: len(ids)] > 0
            values = model.table[ids]
            values[~ok] = 0
            sums = np.zeros((len(ids) + 1, values.shape[1]))
            np.cumsum(values, axis=0, out=sums[1:], dtype=np.float64)
            good = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(ok, out=good[1:])
            starts = np.minimum(bounds[:-1], len(ids))
            stops = np.maximum(lim, starts)
            total[first:last] += sums[stops] - sums[starts]
            count[first:last] += good[stops] - good[starts]
    mean = total / np.maximum(count, 1)[:, None]
    return (mean if model.head is None else mean @ model.head) + model.bias


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; fractions, circled and Roman numerals are not."""
    return any(m[0].isalpha() for m in _WORD_CHAR.finditer(text))


def sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """Learning rows (place, doc_id, lang, ids): of each language those whose hash of doc_id and text is below a bound that keeps
    about its share of them, with buckets drawn from their whole texts.

    Languages are counted first, so only sampled rows move, and their subwords
    instead of their texts. Every value of lang has a share, small ones all rows.
    """
    known = docs.where("lang is not null and text is not null").withColumn(
        "place", F.pmod(F.xxhash64("doc_id", "text", F.lit(settings.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    )
    counts = known.groupBy("lang").count().collect()  # a row per language
    share = max(settings.least, min(settings.per_language, settings.max_rows / max(1, len(counts))))
    bounds = docs.sparkSession.createDataFrame([(r.lang, share / r["count"]) for r in counts], "lang string, bound double")
    # as small as the list it is made of
    picked = known.join(F.broadcast(bounds), "lang").where("place < bound").select("place", "doc_id", "lang", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [drawn(t, settings).tobytes() for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["place", "doc_id", "lang", "ids"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[:-1])
    return picked.mapInArrow(per_batch(run), f"{kinds}ids binary")


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on the bounded sample of ``docs(doc_id, text, lang)``."""
    rows = sorted(sample(docs, settings).collect(), key=lambda r: (r.place, str(r.doc_id), r.lang, r.ids))
    return learn([(np.frombuffer(r.ids, "<u2" if settings.bits <= 16 else "<u4"), r.lang) for r in rows], settings)


def identify(docs: DataFrame, model: Model, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (calibrated probability) and ``rejected`` to (doc_id, \\*keep) of every row.

    Null text, text without a letter, and every text under a model without
    languages gets ``und`` with score 0. ``rejected`` is true for ``und`` and
    for a probability below ``settings.reject_below``. Ties go to the language
    that sorts first. Texts of any length are read whole, in pieces. Repeated
    rows are told each, an empty table gives no rows, and other columns than
    ``keep`` are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows of one float per language
    columns = ["doc_id", *keep]
    reject = settings.reject_below

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        text = batch.column(batch.num_columns - 1)
        known = np.array([t is not None and has_letter(t) for t in text.to_pylist()], bool) & bool(m.languages)
        if m.languages:
            scaled = logits(text, m) / m.temperature
            prob = np.exp(scaled - scaled.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            best = prob.argmax(1)
            names = np.array(m.languages, object)[best]
            score = np.where(known, prob[np.arange(len(best)), best], 0.0)
        else:
            names, score = np.full(len(known), "und", object), np.zeros(len(known))
        names = np.where(known, names, "und")
        out = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(~known | (score < reject))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*columns, "lang_pred", "score", "rejected"])

    rows = docs.select(*columns, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(per_batch(run), f"{kinds}, lang_pred string, score double, rejected boolean")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold_of("doc_id", 3) != 1))
    found = identify(docs, model)
    return found.withColumn("held_out", fold_of("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects; the model learns from the same rows as the query's."""
    model = fit(docs.where(fold_of("doc_id", 3) != 1))
    rows = docs.withColumn("__row", F.struct(*docs.columns))
    kept = identify(rows.select("doc_id", "text", "__row"), model, keep=("__row",)).where("not rejected")
    return kept.select("__row.*").select(*docs.columns)
