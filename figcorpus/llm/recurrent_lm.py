"""A gated recurrent language model that scores whole documents, beside an add-one unigram base.

Words are counted over all training documents. The frequent ones are outputs of
their own; the others share outputs by the hash of their ending, within which a word's
probability is its add-one count. Outputs stand in classes of about equal root frequency, so
a probability is that of the class times that within it. The network is warmed
up on a bounded sample, then every task trains its own documents from the
current weights, and the tasks' weights are averaged by the tokens they saw.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import durable, fold_of, per_batch, query, table, text_buffer
from figcorpus.session import scratch_dir


@dataclass(frozen=True)
class Settings:
    """``own_words``: words that are outputs of their own; ``endings``: outputs that the others share.

    ``listed``: words whose counts every task holds; the others' are joined.
    ``warm_rows`` documents, up to ``warm_tokens`` neighbouring tokens of each, are
    the warm-up sample, which only comes first. All training documents are learned in ``rounds`` shares, one after another: the state runs
    through each whole document, and every ``window`` has its loss taken and sent back. An ``every`` above 1 learns from
    one window in so many, for trials.
    """

    own_words: int = 4000
    endings: int = 1000
    listed: int = 200_000
    embedding: int = 16
    hidden: int = 24
    lanes: int = 256
    window: int = 16
    every: int = 1
    rate: float = 0.1
    warm_rows: int = 1500
    warm_tokens: int = 512
    warm_lanes: int = 64
    rounds: int = 2
    seed: int = 5


def words_of(column: pa.Array) -> pa.ListArray:
    """Words of each row between the six ASCII blanks, A-Z lower-cased; blanks at a row's ends leave empty ones."""
    column = column.fill_null("") if column.null_count else column
    return pc.ascii_split_whitespace(pc.ascii_lower(column))


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The rows' words as codes, one row after another; the number of each row's words; the word of each code."""
    split = words_of(column)
    lengths = split.value_lengths().to_numpy().astype(np.int64)
    found = split.flatten().dictionary_encode()
    codes, words = found.indices.to_numpy(), found.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        there = codes != empty
        upto = np.append(0, np.cumsum(there))[np.append(0, np.cumsum(lengths))]
        codes, lengths = codes[there], np.diff(upto)
    return codes, lengths, words.cast(pa.binary())


def with_ends(ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Each row's output ids, and behind them the end, 0."""
    out = np.zeros(len(ids) + len(lengths), np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return np.split(out, np.cumsum(lengths + 1)[:-1])


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-4:]) % endings


#: What one byte adds to a CRC-32.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)


def endings_of(words: pa.Array, endings: int) -> np.ndarray:
    """:func:`ending` of each word."""
    data, offsets = text_buffer(words)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (4, 3, 2, 1):
        long = np.flatnonzero(np.diff(offsets) >= back)
        crc[long] = CRC[(crc[long] ^ data[offsets[long + 1] - back]) & 255] ^ crc[long] >> 8
    return (crc ^ np.uint32(0xFFFFFFFF)) % endings


# counts

#: A quarter of the distinct words that a task holds when it writes its counts; bytes of text that it takes words of at a time.
HELD, PIECE = 100_000, 4_000_000


def _pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows, first and behind the last, cut where their texts come to ``PIECE`` bytes."""
    _, offsets = text_buffer(column)
    first = 0
    for i in range(len(column)):
        if offsets[i + 1] - offsets[first] >= PIECE or i + 1 == len(column):
            yield first, i + 1
            first = i + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) summed over a task's documents, written whenever more than 4 ``HELD`` words are held."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        for first, last in _pieces(batch.column("text")):
            found = pc.value_counts(words_of(batch.column("text").slice(first, last - first)).flatten())
            told = pa.table([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])
            held.append(told.filter(pc.not_equal(told["word"], "")))
            if sum(t.num_rows for t in held) > 8 * HELD:
                held = [added()]
                if held[0].num_rows > 4 * HELD:
                    yield from held.pop().to_batches()
    if held:
        yield from added().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows, added up in each task before they are dealt by word."""
    return docs.select("text").mapInArrow(_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """All words above a count, as many as stay within ``most``, by count and word."""
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    held, least = 0, None
    for s in steps:
        held += s.words
        if held > most:
            break
        least = s.least
    if least is None:
        return []
    rows = counts.where(F.col("n") >= least).collect()  # no more than most
    return sorted(((r.word.encode(), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


# the network

#: Rows of states whose class logits are held at a time; logits within classes, but for one class, at a time. Both stay in a core's cache.
BLOCK, WITHIN = 512, 60_000


def logistic(negated: np.ndarray) -> None:
    """The logistic function, in place, of the negatives of what is given."""
    np.minimum(negated, 80, out=negated)  # where exp stays finite
    np.exp(negated, out=negated)
    negated += 1
    np.reciprocal(negated, out=negated)


class ByClass:
    """Softmaxes of rows of states: over the classes, and over the outputs of each row's own class.

    Rows stand in the order of their targets' classes, so that a class is a run of rows: ``order`` says where they come
    from. Logits within classes lie in one array, row after row, so that all are exponentiated and summed at once.
    """

    def __init__(self, net: Net, hidden: np.ndarray, targets: np.ndarray):
        self.net, n = net, len(targets)
        of = net.class_of[targets]
        self.order = np.argsort(of, kind="stable")
        self.cls, wanted = of[self.order], targets[self.order]
        self.rows = np.empty((n, net.h + 1), np.float32)  # a one behind each state meets the biases
        self.rows[:, :-1] = hidden[self.order]
        self.rows[:, -1] = 1
        counts = np.bincount(of, minlength=len(net.starts) - 1)
        sizes, behind = np.diff(net.starts), np.cumsum(counts)
        self.sizes = sizes[self.cls]
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.at = self.begins + (wanted - net.starts[self.cls])
        ends = np.cumsum(counts * sizes)
        #: of each class with rows: its rows and its outputs, each as first and behind the last; classes are grouped by their logits' number
        self.groups: list[list[tuple[int, int, int, int]]] = []
        upto = -1
        for k in np.flatnonzero(counts).tolist():
            if ends[k] > upto:
                self.groups.append([])
                upto = ends[k] - counts[k] * sizes[k] + WITHIN
            self.groups[-1].append((int(behind[k] - counts[k]), int(behind[k]), int(net.starts[k]), int(net.starts[k + 1])))

    def within(self, weights: np.ndarray, small: bool):
        """Logits within the rows' classes, a group of classes at a time: (rows, logits, each row's first, each target's place, blocks).

        weights: of each output, its bias last. A block is a class: its rows, first and behind the last, its outputs, and its logits.
        """
        for runs in self.groups:
            rows = slice(runs[0][0], runs[-1][1])
            sizes, shift = self.sizes[rows], self.begins[rows.start]
            begins = self.begins[rows] - shift
            out = np.empty(int(begins[-1] + sizes[-1]), np.float32)
            blocks, begin = [], 0
            for first, last, lo, hi in runs:
                end = begin + (last - first) * (hi - lo)
                block = out[begin:end].reshape(last - first, hi - lo)
                np.matmul(self.rows[first:last], weights[lo:hi].T, out=block)
                blocks.append((first, last, lo, hi, block))
                begin = end
            if not small:
                out -= np.repeat(np.maximum.reduceat(out, begins), sizes)
            yield rows, out, begins, self.at[rows] - shift, blocks

    def classes(self, weights: np.ndarray, small: bool):
        """Logits of the classes, some rows at a time: (rows, logits, places of the targets' classes)."""
        for first in range(0, len(self.rows), BLOCK):
            rows = slice(first, min(first + BLOCK, len(self.rows)))
            out = self.rows[rows] @ weights
            if not small:
                out -= out.max(axis=1, keepdims=True)
            yield rows, out, (np.arange(len(out)), self.cls[rows])


class Net:
    """Embeddings, one gated recurrent layer, and an output softmax factored by class."""

    def __init__(self, arrays: dict[str, np.ndarray], starts: np.ndarray):
        self.w, self.starts = arrays, starts  # outputs of class k: starts[k] to starts[k + 1]
        self.class_of = np.repeat(np.arange(len(starts) - 1, dtype=np.int16 if len(starts) < 2**15 else np.int64), np.diff(starts))
        self.h = arrays["u"].shape[0]

    @staticmethod
    def fresh(mass: np.ndarray, s: Settings) -> Net:
        """Random weights for outputs of the given masses, in falling order; biases say the masses."""
        rng = np.random.default_rng(s.seed)
        k = len(mass)
        n_classes = max(1, math.isqrt(k))
        upto = np.cumsum(np.sqrt(mass + 1.0))
        class_of = np.minimum((upto - 1e-9) / upto[-1] * n_classes, n_classes - 1).astype(int)
        _, starts = np.unique(class_of, return_index=True)
        starts = np.append(starts, k)
        p = (mass + 1.0) / (mass + 1.0).sum()
        of_class = np.add.reduceat(p, starts[:-1])
        within = p / np.repeat(of_class, np.diff(starts))

        def draw(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        e, h = s.embedding, s.hidden
        arrays = {
            "e": draw(k, e, scale=0.3), "x": draw(e, 3 * h, scale=e**-0.5), "u": draw(h, 3 * h, scale=h**-0.5),
            "b": np.zeros(3 * h, np.float32), "c": draw(h, len(of_class), scale=0.05), "cb": np.log(of_class).astype(np.float32),
            "o": draw(k, h, scale=0.05), "ob": np.log(within).astype(np.float32),
        }
        return Net(arrays, starts)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def filled(self, flat: np.ndarray) -> Net:
        out, at = {}, 0
        for k in sorted(self.w):
            n = self.w[k].size
            out[k] = flat[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n
        return Net(out, self.starts)

    def gates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of inputs, biases and weights of states, each for both gates and the news; the gates' are negated."""
        signs = np.array([-1, -1, 1], np.float32)[:, None, None]
        parts = (self.w[k].reshape(-1, 3, self.h).transpose(1, 0, 2) for k in ("x", "b", "u"))
        return tuple(np.ascontiguousarray(signs * p) for p in parts)

    def negated(self) -> tuple[np.ndarray, np.ndarray]:
        """What each output adds to the gates and the news, and the state's weights, with the gates' parts negated."""
        x, b, u = self.gates()
        return self.w["e"] @ x + b, u

    def forward(self, ids: np.ndarray, keep: np.ndarray, state: np.ndarray, negated: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """States after each step of ids (steps x lanes); keep is 0 where a document starts."""
        h, (table, u) = self.h, negated
        steps, lanes = ids.shape
        after = np.empty((steps, lanes, h), np.float32)
        a, s = np.empty((3, lanes, h), np.float32), np.empty((3, lanes, h), np.float32)
        g, (z, r, new) = s[:2], s
        starts = keep.min(axis=1) < 1
        for t in range(steps):
            if starts[t]:
                state = state * keep[t][:, None]
            table.take(ids[t], axis=1, out=a, mode="clip")
            np.matmul(state, u, out=s)
            g += a[:2]
            logistic(g)
            new *= r
            new += a[2]
            np.tanh(new, out=new)
            state = np.subtract(state, new, out=after[t])
            state *= z
            state += new
        return after

    def run(self, ids: np.ndarray, keep: np.ndarray, state: np.ndarray):
        """As :meth:`forward`, with what the way back needs: inputs, states before, and (gates, their news' part), by gate first."""
        h, (wx, b, u) = self.h, self.gates()
        steps, lanes = ids.shape
        x = self.w["e"][ids]
        before, after, news = (np.empty((steps, lanes, h), np.float32) for _ in range(3))
        parts, a = np.empty((steps, 3, lanes, h), np.float32), np.empty((3, lanes, h), np.float32)
        starts = keep.min(axis=1) < 1
        for t in range(steps):
            before[t] = state
            if starts[t]:
                before[t] *= keep[t][:, None]
            s, new = parts[t], news[t]
            np.matmul(x[t], wx, out=a)
            a += b
            np.matmul(before[t], u, out=s)
            g = s[:2]
            g += a[:2]
            logistic(g)
            np.multiply(s[1], s[2], out=new)
            new += a[2]
            np.tanh(new, out=new)
            state = np.subtract(before[t], new, out=after[t])
            state *= s[0]
            state += new
        return after, (x, before, news, parts)

    def back(self, d_after: np.ndarray, keep: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the layer's weights and of its inputs from those of its states, a step at a time from the last."""
        x, before, news, parts = kept
        steps, lanes, h = before.shape
        u, wx = np.ascontiguousarray(self.w["u"].T), np.ascontiguousarray(np.roll(self.w["x"], h, axis=1).T)
        # columns: what reaches the news as inputs' part, update, reset, the news as states' part
        part = np.empty((lanes, 4 * h), np.float32)
        of_inputs, of_states = part[:, : 3 * h], part[:, h:]
        later, ones = np.zeros((lanes, h), np.float32), np.ones(lanes, np.float32)
        g_u, g_x, g_b, d_x = np.zeros((h, 3 * h), np.float32), np.zeros((x.shape[2], 3 * h), np.float32), np.zeros(3 * h, np.float32), np.empty_like(x)
        starts = keep.min(axis=1) < 1
        for t in range(steps - 1, -1, -1):
            d, (z, r, inner), new = d_after[t], parts[t], news[t]
            d += later
            through = 1 - z
            through *= d
            d_new = new * new
            np.subtract(1, d_new, out=d_new)
            d_new *= through
            part[:, :h] = d_new
            through *= z
            np.multiply(through, before[t] - new, out=part[:, h : 2 * h])
            d_new *= r
            part[:, 3 * h :] = d_new
            d_new *= inner
            np.multiply(d_new, 1 - r, out=part[:, 2 * h : 3 * h])
            g_u += before[t].T @ of_states
            g_x += x[t].T @ of_inputs
            g_b += ones @ of_inputs
            np.matmul(of_inputs, wx, out=d_x[t])
            later = of_states @ u
            d *= z
            later += d
            if starts[t]:
                later *= keep[t][:, None]
        return {"u": g_u, "x": np.roll(g_x, -h, axis=1), "b": np.roll(g_b, -h)}, d_x.reshape(steps * lanes, -1)

    def small(self) -> bool:
        """Whether no logit can leave the range in which exp needs no shift; states lie within -1 and 1."""
        w = self.w
        ones = np.ones(self.h, np.float32)
        return max((ones @ np.abs(w["c"]) + np.abs(w["cb"])).max(), (np.abs(w["o"]) @ ones + np.abs(w["ob"])).max()) < 60

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases in one: of classes by column, of outputs by row."""
        w = self.w
        return np.vstack([w["c"], w["cb"]]), np.hstack([w["o"], w["ob"][:, None]])

    def log_probs(self, hidden: np.ndarray, targets: np.ndarray, small: bool = False, joined: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, one row of states each."""
        of_classes, of_outputs = joined or self.joined()
        by = ByClass(self, hidden, targets)
        found = np.empty(len(targets), np.float32)
        for rows, logits, begins, at, _ in by.within(of_outputs, small):
            found[rows] = logits[at]
            found[rows] -= np.log(np.add.reduceat(np.exp(logits, out=logits), begins))
        ones = np.ones(of_classes.shape[1], np.float32)
        for rows, logits, at in by.classes(of_classes, small):
            found[rows] += logits[at]
            found[rows] -= np.log(np.exp(logits, out=logits) @ ones)
        out = np.empty_like(found)
        out[by.order] = found
        return out

    def gradients(self, ids, targets, keep, active, state):
        """Mean loss, gradients of one window (truncated: none beyond it), and the state to go on from.

        Gradients of embeddings come as (rows, values). A softmax is never divided by its sums: its rows of states are.
        """
        w, h = self.w, self.h
        after, kept = self.run(ids, keep, state)
        on = np.flatnonzero(active.ravel())
        by = ByClass(self, after.reshape(-1, h)[on], targets.ravel()[on])
        n = np.float32(len(on))
        g, small, (of_classes, of_outputs) = {}, self.small(), self.joined()

        loss, back = 0.0, np.empty((len(on), h), np.float32)
        found, weights, ones = np.zeros_like(of_classes), np.ascontiguousarray(w["c"].T), np.ones(of_classes.shape[1], np.float32)
        for rows, logits, at in by.classes(of_classes, small):
            sums = np.exp(logits, out=logits) @ ones
            loss -= np.log(logits[at] / sums + 1e-30).sum()
            logits[at] -= sums
            share = (1 / (sums * n))[:, None]
            found += (by.rows[rows] * share).T @ logits
            np.multiply(logits @ weights, share, out=back[rows])
        g["c"], g["cb"] = found[:-1], found[-1]

        found = np.zeros_like(of_outputs)
        for rows, logits, begins, at, blocks in by.within(of_outputs, small):
            sums = np.add.reduceat(np.exp(logits, out=logits), begins)
            loss -= np.log(logits[at] / sums + 1e-30).sum()
            logits[at] -= sums
            share = (1 / (sums * n))[:, None]
            mine, inside = by.rows[rows] * share, np.empty((len(sums), h), np.float32)
            for first, last, lo, hi, block in blocks:
                of = slice(first - rows.start, last - rows.start)
                np.matmul(block.T, mine[of], out=found[lo:hi])
                np.matmul(block, w["o"][lo:hi], out=inside[of])
            inside *= share
            back[rows] += inside
        g["o"], g["ob"] = found[:, :-1], found[:, -1]

        d_after = np.zeros((ids.size, h), np.float32)
        d_after[on[by.order]] = back
        of_layer, d_x = self.back(d_after.reshape(*ids.shape, h), keep, kept)
        g |= of_layer
        used = ids.ravel().astype(np.int16 if len(w["e"]) < 2**15 else np.int64)
        order = np.argsort(used, kind="stable")
        used = used[order]
        starts = np.flatnonzero(np.append(True, used[1:] != used[:-1]))
        g["e"] = (used[starts], np.add.reduceat(d_x[order], starts, axis=0))
        return float(loss / n), g, after[-1]


class Trainer:
    """Gradient descent with a rate per weight that falls with the gradients it has seen."""

    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.seen = net, rate, 0
        self.past = {k: np.full(v.shape, 1e-6, np.float32) for k, v in net.w.items()}

    def step(self, grads: dict) -> None:
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (None, g)
            w, past = self.net.w[k], self.past[k]
            for first in range(0, len(g), BLOCK):
                rows = slice(first, first + BLOCK)
                part, now = np.clip(g[rows], -0.1, 0.1), rows if at is None else at[rows]
                past[now] += part * part
                part *= self.rate
                part /= np.sqrt(past[now])
                w[now] -= part

    def learn(self, docs: list[np.ndarray], lanes: int, window: int, every: int = 1) -> float:
        """One pass over documents of output ids; each lane's state goes on from window to window.

        One window in ``every`` is learned from, in turn; through the others the state only runs.
        """
        total, steps, turn = 0.0, 0, 0
        state = None
        for ids, targets, keep, active, _, first in windows(docs, lanes, window * 4):
            state = np.zeros((ids.shape[1], self.net.h), np.float32) if first else state[: ids.shape[1]]
            negated = None
            for at in range(0, len(ids), window):
                now = slice(at, at + window)
                if turn % every == 0 and active[now].any():
                    loss, grads, state = self.net.gradients(ids[now], targets[now], keep[now], active[now], state)
                    self.step(grads)
                    negated = None
                    total, steps = total + loss, steps + 1
                else:
                    negated = negated or self.net.negated()
                    state = self.net.forward(ids[now], keep[now], state, negated)[-1]
                turn += 1
            self.seen += int(active.sum())
        return total / max(steps, 1)


def windows(docs: list[np.ndarray], lanes: int, window: int):
    """Steps of documents laid end to end in lanes: (inputs, targets, keep, active, document, first).

    A document is its words' outputs and the end, 0; the input before its first word is the end, too.
    Lanes fall in length, so those that are done are the last ones and go.
    """
    if not docs:
        return
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lanes = min(lanes, len(docs))
    load, mine = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in order:
        n, k = load[0]
        heapq.heapreplace(load, (n + len(docs[i]), k))
        mine[k].append(i)
    mine.sort(key=lambda m: -sum(len(docs[i]) for i in m))
    lines = [np.concatenate([docs[i] for i in m]) for m in mine]
    owner = [np.repeat(np.array(m, np.int32), [len(docs[i]) for i in m]) for m in mine]
    longs = np.array([len(x) for x in lines])
    for start in range(0, int(longs[0]), window):
        alive = int((longs > start).sum())
        width = min(window, int(longs[0]) - start)
        targets, doc = np.zeros((width, alive), np.int64), np.zeros((width, alive), np.int64)
        before, active = np.zeros((width, alive), np.int64), np.zeros((width, alive), bool)
        for k in range(alive):
            line = lines[k][start : start + width]
            targets[: len(line), k], doc[: len(line), k], active[: len(line), k] = line, owner[k][start : start + width], True
            before[: len(line), k] = lines[k][start - 1 : start - 1 + len(line)] if start else np.append(0, line[:-1])
        yield before, targets, (before != 0).astype(np.float32), active, doc, start == 0


def doc_log_probs(net: Net, docs: list[np.ndarray], lanes: int = 512, window: int = 64) -> np.ndarray:
    """Natural log probability of each document of output ids, the state carried through all its windows."""
    out = np.zeros(len(docs))
    state, small, negated, joined = None, net.small(), net.negated(), net.joined()
    for ids, targets, keep, active, doc, first in windows(docs, lanes, window):
        state = np.zeros((ids.shape[1], net.h), np.float32) if first else state[: ids.shape[1]]
        after = net.forward(ids, keep, state, negated)
        state = after[-1]
        on = np.flatnonzero(active.ravel())
        found = net.log_probs(after.reshape(-1, net.h)[on], targets.ravel()[on], small, joined)
        out += np.bincount(doc.ravel()[on], found.astype(np.float64), len(docs))
    return out


# the model of a corpus


@dataclass
class Model:
    """``ids``: words with outputs of their own; ``listed``: frequent words, ``logs``: log10(count + 1) of each.

    ``shared``: log10 of each ending's tokens + words + 1, by ending; ``first_of``: output of each ending.
    ``tokens``, ``types``: all training tokens and distinct ones, ends included.
    """

    settings: Settings
    net: Net
    ids: dict[bytes, int]
    own_logs: np.ndarray
    listed: list[bytes]
    logs: np.ndarray
    shared: np.ndarray
    first_of: np.ndarray
    tokens: int
    types: int
    ends: int
    counts: DataFrame | None = None

    def local(self, learning: bool = False) -> Model:
        """What tasks need; learning takes no counts."""
        less = {"listed": [], "logs": self.logs[:0]} if learning else {}
        return Model(**{**self.__dict__, "counts": None, **less})


class _Outputs:
    """The output of each word: its own, or its ending's."""

    def __init__(self, model: Model):
        self.model, self.own = model, pa.array(list(model.ids), pa.binary())
        self.ids = np.fromiter(model.ids.values(), np.int32, len(model.ids))

    def __len__(self) -> int:
        return len(self.own)

    def of(self, words: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(words, self.own), -1).to_numpy()
        out = self.model.first_of[endings_of(words, self.model.settings.endings)].astype(np.int32)
        out[at >= 0] = self.ids[at[at >= 0]]
        return out


def _encoded(batch: pa.RecordBatch, outputs: _Outputs) -> list[np.ndarray]:
    out, column = [], batch.column("text")
    for first, last in _pieces(column):
        codes, lengths, words = coded(column.slice(first, last - first))
        out += with_ends(outputs.of(words)[codes], lengths)
    return out


CHUNKS = 32


def _learned(shared, lanes: int, window: int, part_salt: int):
    """A task's weights after a pass over its documents, in chunks, times the tokens seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Model = shared.value
        trainer = Trainer(model.net.filled(model.net.flat()), model.settings.rate / 2)
        for batch in batches:
            if batch.num_rows:
                trainer.learn(_encoded(batch, _Outputs(model)), lanes, window, model.settings.every)
        if trainer.seen:
            part = TaskContext.get().partitionId()
            chunks = np.array_split(trainer.net.flat().astype(np.float64) * trainer.seen, CHUNKS)
            rows = [pa.array(np.arange(CHUNKS)), pa.array([part // part_salt] * CHUNKS), pa.array([float(trainer.seen)] * CHUNKS)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([c.astype(np.float32).tobytes() for c in chunks], pa.binary())], ["chunk", "salt", "seen", "sums"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows by (chunk, salt)."""
    held: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = row["chunk"], row["salt"]
            values = np.frombuffer(row["sums"], np.float32).astype(np.float64)
            n, sums = held.get(key, (0.0, 0.0))
            held[key] = n + row["seen"], sums + values
    if held:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.array([v[0] for v in held.values()]),
                pa.array([v[1].astype(np.float32).tobytes() for v in held.values()], pa.binary()),
            ],
            ["chunk", "salt", "seen", "sums"],
        )


def average(rows: DataFrame) -> np.ndarray | None:
    """The mean weights by tokens seen: groups of tasks first, then all groups, a chunk at a time."""
    schema = "chunk bigint, salt bigint, seen double, sums binary"
    some = rows.repartition("chunk", "salt").mapInArrow(_summed, schema).withColumn("salt", F.lit(0).cast("bigint"))
    found = some.repartition(CHUNKS, "chunk").mapInArrow(_summed, schema).collect()  # one row a chunk: the net's size
    if not found:
        return None
    return np.concatenate([np.frombuffer(r.sums, np.float32) / r.seen for r in sorted(found, key=lambda r: r.chunk)])


def _sampled(shared):
    """Neighbouring outputs of a sampled document, from a place that its text decides."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model: Model = shared.value
        most = model.settings.warm_tokens
        out = []
        for ids in _encoded(batch, _Outputs(model)):
            at = zlib.crc32(ids.astype(np.int64).tobytes()) % (len(ids) - most + 1) if len(ids) > most else 0
            out.append(ids[at : at + most].astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return run


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from all rows of ``docs(doc_id, text)``; null text is empty, repeated rows count each.

    Counts are those of all rows. Every row runs through the network once, whole, in the task that
    reads it. The driver sees the listed words, one row an ending, the warm-up sample and the averaged weights, all
    bounded by settings. Without rows every output is equally likely.
    """
    s, spark = settings, docs.sparkSession
    counts = durable(word_counts(docs))
    ends = docs.count()
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    listed = most_frequent(counts, s.listed)
    own = listed[: s.own_words]
    names = spark.createDataFrame([(w.decode(),) for w, _ in own], "word string")
    mark = F.crc32(F.substring(F.col("word").cast("binary"), -4, 4)) % s.endings
    # as many rows as settings.own_words, and an ending's row each
    others = counts.join(F.broadcast(names), "word", "left_anti").groupBy(mark.alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    tokens, shared = np.zeros(s.endings), np.zeros(s.endings)
    for r in others.collect():
        tokens[r.ending], shared[r.ending] = r.n, r.n + r.words
    # output 0 is the end whatever its mass; the others follow by mass
    mass = np.concatenate([[n for _, n in own], tokens]).astype(float)
    order = np.argsort(-mass, kind="stable")
    output = np.empty(len(mass), np.int64)
    output[order] = np.arange(1, len(mass) + 1)
    net = Net.fresh(np.concatenate([[ends], mass[order]]), s)
    own_logs = np.zeros(len(mass) + 1)
    own_logs[output[: len(own)]] = [math.log10(n + 1) for _, n in own]
    model = Model(
        s, net, {w: int(output[i]) for i, (w, _) in enumerate(own)}, own_logs, [w for w, _ in listed],
        np.array([math.log10(n + 1) for _, n in listed]), np.log10(shared + 1), output[len(own) :], int(total.n or 0) + ends, total.words + (ends > 0), ends, counts,
    )
    if not ends:
        return model

    place = F.pmod(F.xxhash64(F.lit(s.seed), F.col("doc_id").cast("string"), "text"), F.lit(1_000_003))
    rows = docs.select("text", place.alias("place"))
    sc = spark.sparkContext
    now = sc.broadcast(model.local(learning=True))
    sample = rows.where(F.col("place") < math.ceil(1_000_003 * min(1.0, s.warm_rows / ends)))
    found = sample.select("text").mapInArrow(per_batch(_sampled(now)), "ids binary").limit(2 * s.warm_rows).collect()
    warm = [np.frombuffer(r.ids, np.int32).astype(np.int64) for r in found]
    trainer = Trainer(model.net, s.rate)
    for _ in range(2):
        trainer.learn(warm, s.warm_lanes, s.window)
    for k in range(s.rounds):
        shared_now = sc.broadcast(model.local(learning=True))
        share = rows.where(F.col("place") % s.rounds == k).select("text")
        schema = "chunk bigint, salt bigint, seen double, sums binary"
        flat = average(share.mapInArrow(_learned(shared_now, s.lanes, s.window, 256), schema))
        if flat is not None:
            model.net = model.net.filled(flat)
        shared_now.unpersist()
    now.unpersist()
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        listed, outputs = pa.array(model.listed, pa.binary()), _Outputs(model)
        less = model.own_logs.copy()
        less[model.first_of] += model.shared

        def counted(column: pa.Array):
            """The rows' output ids, base logarithms, what words have within their outputs, and the words that are joined later."""
            codes, lengths, words = coded(column)
            number = pc.fill_null(pc.index_in(words, listed), -1).to_numpy()
            output, log = outputs.of(words), np.zeros(len(words))
            log[number >= 0] = model.logs[number[number >= 0]]
            row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            # within an ending a word has its add-one share: counts from the lists, totals here
            base, share = (np.bincount(row, x[codes], len(lengths)) for x in (log, log - less[output]))
            apart = np.flatnonzero(number[codes] < 0)
            pairs, times = np.unique(row[apart].astype(np.int64) * len(words) + codes[apart], return_counts=True)
            of_row, word = np.divmod(pairs, max(len(words), 1))
            upto = pa.array(np.append(0, np.cumsum(np.bincount(of_row, minlength=len(lengths)))), pa.int32())
            unlisted = np.bincount(row[apart], minlength=len(lengths))
            named = words.take(pa.array(word)).cast(pa.string())
            docs = with_ends(output[codes], lengths)
            return docs, base, share, unlisted, pa.ListArray.from_arrays(upto, named), pa.ListArray.from_arrays(upto, pa.array(times.astype(np.int64)))

        for batch in batches:
            column = batch.column("text")
            made = [(lo, hi, *counted(column.slice(lo, hi - lo))) for lo, hi in _pieces(column)]
            logs = doc_log_probs(model.net, [d for m in made for d in m[2]], model.settings.lanes) / math.log(10)
            for lo, hi, docs, base, share, unlisted, named, times in made:
                lengths = np.array([len(x) for x in docs])
                start = base + math.log10(model.ends + 1) - lengths * math.log10(model.tokens + model.types + 1)
                kept = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(lengths), pa.array(lengths - unlisted - (model.ends == 0)), pa.array(start), pa.array(logs[lo:hi] + share), named, times],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "rest_n"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text, held_out)``.

    Scores are log10 probabilities of the whole text, its end included. Counts
    of words that tasks don't hold are joined and added to the rows. Null text is
    empty; repeated rows are scored each; other columns are not looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.local())
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rest array<string>, rest_n array<bigint>"
    path = scratch_dir(spark, "lm-scored")
    scored = docs.select("doc_id", "held_out", "text").mapInArrow(_scored(shared), schema)
    scored.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.parquet(path)
    rest = scored.select("id", F.explode(F.arrays_zip("rest", "rest_n")).alias("w")).select("id", F.col("w.rest").alias("word"), F.col("w.rest_n").alias("times"))
    told = rest.join(model.counts, "word").groupBy("id").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"), F.sum("times").alias("known"))
    more = F.coalesce("log", F.lit(0.0))
    return scored.join(told, "id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


@query("op11_lm_scoring")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of("doc_id", 7) == 2).alias("held_out"))
    return score(docs, fit(docs.where("not held_out")))
