"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import per_batch, query, table
from figcorpus.llm.html_blocks import Block, blocks
from figcorpus.llm.html_pages import labelled_pages

_TELLING = frozenset("header footer nav aside main article section form figure blockquote table ul ol dl dialog button select label menu".split())
_DIGIT = re.compile(r"\d")
_WORDS = frozenset(
    "cookie cookies subscribe newsletter advertisement sponsored copyright rights privacy terms comments comment reply login search sign share follow".split()
)


@dataclass(frozen=True)
class Settings:
    """Training pages are made by ``labelled_pages``; their number bounds the training."""

    pages: int = 800
    seed: int = 17
    epochs: int = 12
    rate: float = 0.25
    ridge: float = 1e-4


@dataclass(frozen=True)
class Model:
    """Weights of the features for label 1 against 0, of the first label, and of each step (from, to)."""

    weights: dict[str, float]
    first: float
    steps: np.ndarray


def _bin(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def place_features(b: Block) -> list[str]:
    """Names of the features of where a block stands: its ancestors' tags and names."""
    told = [t for t in b.path if t in _TELLING]
    fs = ["bias", f"tag={b.path[-1] if b.path else ''}", f"near={told[-1] if told else ''}", f"two={'>'.join(told[-2:])}"]
    fs += [f"in={t}" for t in set(told)]
    fs += [f"name={m}" for m in b.marks]
    fs += [f"own={m}" for m in b.own_marks]
    return fs


def text_features(b: Block, same: bool, edge: str) -> list[str]:
    """Names of the features of a block's text, and of its place among the others."""
    text = b.text
    n = text.count(" ") + 1
    fs = [
        f"words={_bin(n, (2, 4, 8, 16, 32))}",
        f"links={_bin(b.link_share, (0.01, 0.3, 0.7, 0.99))}",
        f"end={text[-1] if text[-1] in '.!?:' else ''}",
        f"commas={_bin(text.count(','), (1, 3))}",
        f"digits={_bin(len(_DIGIT.findall(text)) / len(text), (0.01, 0.2))}",
        "same=yes" if same else "same=no",
    ]
    if "©" in text:
        fs.append("sign=©")
    if n < 40:
        fs += [f"word={w}" for w in {w.strip(".,:!|").lower() for w in text.split()} & _WORDS]
    if edge:
        fs.append(edge)
    return fs


def features(found: list[Block]) -> list[list[str]]:
    """All features that hold for each block."""
    return [place_features(b) + text_features(b, *_around(found, i)) for i, b in enumerate(found)]


def _around(found: list[Block], i: int) -> tuple[bool, str]:
    same = i > 0 and found[i - 1].path == found[i].path
    return same, "edge=first" if i == 0 else "edge=last" if i == len(found) - 1 else ""


def _forward_backward(scores: np.ndarray, first: float, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at each block, and summed probability of each step."""
    n = len(scores)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.c_[np.zeros(n), scores]
    a[0] = emit[0] + (0.0, first)
    for i in range(1, n):
        x = a[i - 1][:, None] + steps
        top = x.max(0)
        a[i] = emit[i] + top + np.log(np.exp(x - top).sum(0))
    for i in range(n - 2, -1, -1):
        x = steps + emit[i + 1] + b[i + 1]
        top = x.max(1, keepdims=True)
        b[i] = top[:, 0] + np.log(np.exp(x - top).sum(1))
    total = np.logaddexp(*a[-1])
    pair = a[:-1, :, None] + steps + (emit[1:] + b[1:])[:, None, :] - total
    return np.exp(a[:, 1] + b[:, 1] - total), np.exp(pair).sum(0)


def train(pages: list[tuple[list[list[str]], list[int]]], settings: Settings = Settings()) -> Model:
    """Maximise the conditional likelihood of the labels by adaptive gradient steps, a page at a time."""
    index: dict[str, int] = {}
    coded = []
    for feats, labels in pages:
        if not labels:
            continue
        ids = [np.array([index.setdefault(f, len(index)) for f in fs], np.int64) for fs in feats]
        flat = np.concatenate(ids)
        coded.append((flat, np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.array(labels, float)))
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-6)
    first, first_seen, steps, steps_seen = 0.0, 1e-6, np.zeros((2, 2)), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for k in rng.permutation(len(coded)):
            flat, block, y = coded[k]
            scores = np.bincount(block, w[flat], minlength=len(y))
            p, pair = _forward_backward(scores, first, steps)
            grad = np.bincount(flat, (y - p)[block], minlength=len(w)) - settings.ridge * w
            seen += grad**2
            w += settings.rate * grad / np.sqrt(seen)
            g = y[0] - p[0]
            first_seen += g**2
            first += settings.rate * g / np.sqrt(first_seen)
            real = np.zeros((2, 2))
            np.add.at(real, (y[:-1].astype(int), y[1:].astype(int)), 1)
            g = real - pair - settings.ridge * steps
            steps_seen += g**2
            steps += settings.rate * g / np.sqrt(steps_seen)
    return Model({f: float(w[i]) for f, i in index.items()}, float(first), steps)


def viterbi(scores: list[float], first: float, steps: np.ndarray) -> list[int]:
    """The most probable labels; ties go to 0."""
    if not scores:
        return []
    (s00, s01), (s10, s11) = steps.tolist()
    zero, one = 0.0, scores[0] + first
    back = []
    for s in scores[1:]:
        z, o = (zero + s00 >= one + s10), (zero + s01 >= one + s11)
        back.append((0 if z else 1, 0 if o else 1))
        zero, one = (zero + s00 if z else one + s10), (zero + s01 if o else one + s11) + s
    at = int(one > zero)
    out = [at]
    for b in reversed(back):
        at = b[at]
        out.append(at)
    return out[::-1]


def label(found: list[Block], model: Model) -> list[int]:
    """Viterbi labels of a page's blocks; blocks of the same place share that part of their score."""
    get = model.weights.get
    places: dict[tuple, float] = {}
    scores = []
    for i, b in enumerate(found):
        key = (b.path, b.marks, b.own_marks)
        if (place := places.get(key)) is None:
            place = places[key] = sum(get(f, 0.0) for f in place_features(b))
        scores.append(place + sum(get(f, 0.0) for f in text_features(b, *_around(found, i))))
    return viterbi(scores, model.first, model.steps)


@lru_cache(maxsize=4)
def fit(settings: Settings = Settings()) -> Model:
    """Train on the labelled pages; a page whose blocks do not match its labels is an error."""
    rows = []
    for page, labels in labelled_pages(settings.pages, settings.seed):
        found = blocks(page)
        if [b.text for b in found] != [t for t, _ in labels]:
            raise ValueError("a labelled page was not read as it was written")
        rows.append((features(found), [y for _, y in labels]))
    return train(rows, settings)


def main_text(page: str | None, model: Model) -> tuple[str, int, int]:
    found = blocks(page)
    kept = [b.text for b, y in zip(found, label(found, model)) if y]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of every whole page of ``pages(page_id, url, html)``.

    ``text`` joins the blocks labelled as article in page order by a line end;
    it is empty for null, empty and markup-only pages. Rows are told apart by
    nothing, so repeated rows give repeated results.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())  # a weight per feature of the bounded training

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [main_text(x, shared.value) for x in batch.column(2).to_pylist()]
        text, seen, kept = zip(*rows)
        out = [pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(seen, pa.int64()), pa.array(kept, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(per_batch(run), "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint")


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
