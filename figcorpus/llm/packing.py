"""Packing documents into training windows by lexical retrieval: a sharded BM25 index finds the neighbours of a seed."""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from figcorpus.llm.common import query, table, texts
from figcorpus.session import scratch_dir


@dataclass(frozen=True)
class Settings:
    """``shard_tokens`` is about a shard's size, cut by ``cuts`` sampled documents a
    shard, whose weights are projected to ``sketch`` numbers. One tree of cuts makes
    at most ``fan`` parts; more shards are cut in levels.

    A seed asks with its ``terms`` heaviest terms for ``keep`` neighbours at a
    time; when they yield no more, with all its terms.
    """

    vocabulary: str = "byte_bpe_50k.json"
    window: int = 2048
    end_id: int = 1
    shard_tokens: int = 4_000_000
    terms: int = 12
    keep: int = 16
    cuts: int = 64
    sketch: int = 64
    fan: int = 256
    k1: float = 1.2
    b: float = 0.75
    seed: int = 13


# token ids

#: Runs without white space from which on the other implementation is faster.
_LONG_RUN = re.compile(r"\S{5000}")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of the byte-level vocabulary in a tokenizers file; the strings of its added tokens give those tokens' ids.

    The file's merges are in the order of their ids, so tiktoken gives the same
    ids from its vocabulary, and several times faster; texts with very long
    unbroken runs, where its time grows with their square, go to tokenizers. A
    text comes back as the little-endian bytes of its ids, ``kind`` each.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self._added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self._added}
        self.size = 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]])
        self.kind, self.width = ("<u2", 2) if self.size <= 1 << 16 else ("<u4", 4)
        self._fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self._added)
        self._slow = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        if len(text) >= 5000 and _LONG_RUN.search(text):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        allowed = "all" if any(t in text for t in self._added) else set()
        return self._fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype(self.kind).tobytes()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(public_tokenizers.path(vocabulary))


_TOKENS = "row bigint, doc_id bigint, n bigint, ids binary"


def tokenize(docs: DataFrame, s: Settings) -> DataFrame:
    """(row, doc_id, n, ids) of every whole text with its end id, written once; ids are little-endian, 16 bits where the vocabulary allows."""
    path = scratch_dir(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(s.vocabulary)
        end = np.array([s.end_id], encode.kind).tobytes()
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [encode(t) + end for t in texts(part.column(1))]
                rows = pa.array(serial + np.arange(len(ids)))
                serial += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column(0), pa.array([len(x) // encode.width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "n", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _TOKENS)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _array(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4")


def _counted_each(docs: list[np.ndarray], most: int = 200_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents counted in runs of about ``most`` ids, by one sort of (document, id) each: the
    run's first document, where each document's part begins (and the last one ends), the distinct ids of each, how often each occurs.
    """
    sizes = np.array([len(x) for x in docs], np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(docs):
        hi = min(lo + (1 << 16), max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + most, "right"))))
        ids = np.concatenate(docs[lo:hi])
        kind, bits = (np.uint32, 16) if ids.dtype.itemsize == 2 else (np.uint64, 32)
        keys = np.repeat(np.arange(hi - lo, dtype=kind) << kind(bits), sizes[lo:hi]) | ids
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        seen = keys[starts]
        bounds = np.searchsorted(seen >> kind(bits), np.arange(hi - lo + 1))
        yield lo, bounds, (seen & kind((1 << bits) - 1)).astype(ids.dtype), np.diff(np.r_[starts, len(keys)])
        lo = hi


def document_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """In how many documents each id of the vocabulary occurs, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            ids = [_array(blob, n) for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            for _, _, found, _ in _counted_each(ids):
                seen += np.bincount(found, minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["term", "n"])

    found = tokens.select("n", "ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    table_ = found.toArrow()  # a row per id of the vocabulary
    out[table_.column("term").to_numpy()] = table_.column("n").to_numpy()
    return out


def _weights(docs: list[np.ndarray], idf: np.ndarray, mean: float, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct ids of each document and their BM25 weights."""
    for lo, bounds, t, tf in _counted_each(docs):
        sizes = np.repeat([len(x) for x in docs[lo : lo + len(bounds) - 1]], np.diff(bounds))
        w = idf[t] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * sizes / mean))
        for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield t[first:end], w[first:end]


@lru_cache(maxsize=2)
def _signs(size: int, s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).choice(np.array([-1, 1], np.float32), (size, s.sketch))


def sketches_of(docs: list[np.ndarray], idf: np.ndarray, mean: float, s: Settings) -> np.ndarray:
    """Random projections of the documents' weights to unit vectors; lexically close documents have close ones."""
    signs = _signs(len(idf), s)
    out = np.empty((len(docs), s.sketch), np.float32)
    for v, (t, w) in zip(out, _weights(docs, idf, mean, s)):
        v[:] = (w * idf[t]).astype(np.float32) @ signs[t]
        v /= max(1e-9, float(np.linalg.norm(v)))
    return out


def _scores(vectors: np.ndarray, axes: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Where vectors lie along an axis, in steps; ``ties`` in [0, 1) part those in one step, such as a crowd of copies."""
    return np.floor((vectors.astype(float) * axes).sum(1) * 1e4) + ties


@dataclass(frozen=True)
class Tree:
    """Splits of sketches; a child below 0 is the shard ~child."""

    axes: np.ndarray
    at: np.ndarray
    children: np.ndarray

    def place(self, vectors: np.ndarray, ties: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), 0 if len(self.at) else -1)
        while len(open_ := np.flatnonzero(node >= 0)):
            k = node[open_]
            node[open_] = self.children[k, (_scores(vectors[open_], self.axes[k], ties[open_]) > self.at[k]).astype(int)]
        return ~node


def grow(vectors: np.ndarray, ties: np.ndarray, sizes: np.ndarray, shards: int) -> Tree:
    """Cut a sample again and again along its widest direction, into ``shards`` parts of about equal size."""
    axes, at, children = [], [], []

    def split(rows: np.ndarray, first: int, n: int) -> int:
        if n == 1:
            return ~first
        x = vectors[rows].astype(float)
        x = x - x.mean(0) if len(rows) else x
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        score = _scores(vectors[rows], axis[None, :], ties[rows])
        order = np.argsort(score, kind="stable")
        sums = np.cumsum(sizes[rows][order])
        cut = int(np.searchsorted(sums, sums[-1] * (n // 2) / n)) if len(rows) else 0
        here = len(at)
        axes.append(axis)
        at.append(score[order[min(cut, len(rows) - 1)]] if len(rows) else 0.0)
        children.append([0, 0])
        low = score <= at[here]
        children[here] = [split(rows[low], first, n // 2), split(rows[~low], first + n // 2, n - n // 2)]
        return here

    split(np.arange(len(vectors)), 0, shards)
    return Tree(np.array(axes).reshape(len(at), vectors.shape[1]), np.array(at), np.array(children, np.int64).reshape(len(at), 2))


def _ties(rows: np.ndarray) -> np.ndarray:
    """A number in [0, 1) of each row."""
    return (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(float) / (1 << 40)


def levels(shards: int, fan: int) -> tuple[int, int]:
    """(levels, parts of each cut): the fewest levels of at most ``fan`` parts that make ``shards`` parts or little more."""
    depth, made = 1, fan
    while made < shards:
        depth, made = depth + 1, made * fan
    parts = max(1, round(shards ** (1 / depth)))
    while parts**depth < shards:
        parts += 1
    return depth, parts


class Index:
    """BM25 over the documents of a shard, with document counts of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, s: Settings) -> None:
        self.s = s
        terms, owners, weights = [], [], []
        self.queries = []
        for i, (t, w) in enumerate(_weights(docs, idf, mean, s)):
            terms.append(t)
            owners.append(np.full(len(t), i, np.int32))
            weights.append(w.astype(np.float32))
            # the heaviest stand in front
            self.queries.append(t[np.argpartition(-w, s.terms - 1)] if len(t) > s.terms else t)
        flat = np.concatenate(terms)
        order = np.argsort(flat, kind="stable")
        self.owners, self.weights = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.bounds = np.searchsorted(flat[order], np.arange(len(idf) + 1))
        self.n = len(docs)

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents that share the seed's most telling terms, or else any of its terms, best first; ties to the earlier one."""
        terms = self.queries[seed]
        return self._best(terms[: self.s.terms], used) or (self._best(terms, used) if len(terms) > self.s.terms else [])

    def _best(self, terms: np.ndarray, used: np.ndarray) -> list[int]:
        lists = [(self.bounds[t], self.bounds[t + 1]) for t in terms.tolist()]
        own = np.concatenate([self.owners[lo:hi] for lo, hi in lists])
        scores = np.bincount(own, np.concatenate([self.weights[lo:hi] for lo, hi in lists]), self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        if len(found) > self.s.keep:
            cut = np.partition(scores[found], -self.s.keep)[-self.s.keep]
            found = found[scores[found] >= cut]
        return found[np.argsort(-scores[found], kind="stable")[: self.s.keep]].tolist()


@dataclass(frozen=True)
class Piece:
    doc: int
    start: int
    length: int
    sequence: int
    offset: int


def pack(sizes: list[int], neighbours, window: int) -> list[Piece]:
    """Cut and place documents 0 .. n - 1 into sequences of ``window`` tokens without padding.

    A window begins with what was left of the last document, or the next unused
    one, and takes that seed's nearest unused neighbours until it is full; the
    last to come is cut, and its rest seeds the next window. When its ranked
    neighbours are placed, the same seed asks again; only when it has none left,
    the next unused document comes and asks. What does not fill a window in the end
    is cut into sequences whose lengths are powers of two, which need no padding.
    ``neighbours(seed, used)`` lists documents, best first; ``used`` may be read
    as a mask.
    """
    n = len(sizes)
    used = np.zeros(n, bool)
    out: list[Piece] = []
    open_: list[tuple[int, int, int]] = []  # document, start, length of the unfinished window
    sequence, room, following = 0, window, 0
    left: tuple[int, int] | None = None
    ranked: list[int] = []
    seed: int | None = None  # whose neighbours are ranked; none when it has no more

    def close(pieces: list[tuple[int, int, int]]) -> None:
        nonlocal sequence
        at = 0
        for doc, start, length in pieces:
            out.append(Piece(doc, start, length, sequence, at))
            at += length
        sequence += 1

    while True:
        if left is None:
            while ranked and used[ranked[0]]:
                ranked.pop(0)
            if not ranked and open_ and seed is not None:
                ranked = [d for d in neighbours(seed, used) if not used[d]]
                if not ranked:
                    seed = None
            if ranked:
                doc = ranked.pop(0)
            else:
                while following < n and used[following]:
                    following += 1
                if following == n:
                    break
                doc = following
                if open_:
                    used[doc] = True
                    seed, ranked = doc, neighbours(doc, used)
            used[doc] = True
            left = (doc, 0)
        doc, start = left
        if not open_:
            seed, ranked = doc, neighbours(doc, used)
        take = min(room, sizes[doc] - start)
        open_.append((doc, start, take))
        room -= take
        left = (doc, start + take) if start + take < sizes[doc] else None
        if not room:
            close(open_)
            open_, room = [], window
    total = window - room
    while total:
        part = 1 << (total.bit_length() - 1)
        total -= part
        pieces = []
        while part:
            doc, start, length = open_.pop(0)
            take = min(part, length)
            pieces.append((doc, start, take))
            part -= take
            if take < length:
                open_.insert(0, (doc, start + take, length - take))
        close(pieces)
    return out


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _sampled(placed: DataFrame, step: float, sketches: Callable[[pa.RecordBatch], np.ndarray], s: Settings) -> DataFrame:
    """(shard, row, n, vector) of documents drawn by their tokens, one in about ``step`` tokens, by a hash of the row."""
    drawn = F.pmod(F.xxhash64("row", F.lit(s.seed)), F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.col("n") / F.lit(step)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pa.array([v.tobytes() for v in sketches(batch)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), found], ["shard", "row", "n", "vector"])

    return placed.where(drawn).select("shard", "row", "n", "ids").mapInArrow(taken, "shard bigint, row bigint, n bigint, vector binary")


def _grown(some: list[tuple[int, int, bytes]], step: float, fan: int, s: Settings) -> Tree:
    """The tree of a sample of (row, tokens, sketch)."""
    some = sorted(some)
    vectors = np.array([np.frombuffer(v, np.float32) for _, _, v in some], np.float32).reshape(len(some), s.sketch)
    sizes = np.array([max(n, step) for _, n, _ in some], float)
    return grow(vectors, _ties(np.array([row for row, _, _ in some], np.int64)), sizes, fan)


def _cut_again(placed: DataFrame, fan: int, tokens: float, below: int, sketches: Callable[[pa.RecordBatch], np.ndarray], s: Settings) -> DataFrame:
    """Documents with their shard cut into ``fan`` parts of about ``tokens`` tokens.

    Every shard's tree grows in a task from that shard's own sample, about ``cuts``
    documents a part, and travels ahead of the shard's documents, so neither the driver nor a
    broadcast holds trees. A shard of many parts (``below``) is dealt over several tasks, each with the tree.
    """
    spark = placed.sparkSession
    out = scratch_dir(spark, "placed")
    placed.write.parquet(out)
    placed = spark.read.schema(placed.schema).parquet(out)
    step = tokens / s.cuts

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def planted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([pickle.dumps(_grown(held, step, fan, s))], pa.binary())], ["shard", "ids"])

        for batch in batches:
            for shard, row, n, vector in zip(*[c.to_pylist() for c in batch.columns]):
                if held and shard != now:
                    yield planted()
                    held = []
                now = shard
                held.append((row, n, vector))
        if held:
            yield planted()

    salts = max(1, below // 16)
    sample = _sampled(placed, step, sketches, s).repartition("shard").sortWithinPartitions("shard")
    trees = sample.mapInArrow(plant, "shard bigint, ids binary").select(
        "shard", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"), *[F.lit(None).cast("bigint").alias(c) for c in ("row", "doc_id", "n")], "ids"
    )
    own = placed.select("shard", F.pmod(F.xxhash64("row", F.lit(s.seed + 1)), F.lit(salts)).alias("salt"), "row", "doc_id", "n", "ids")
    together = trees.unionByName(own).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("row").asc_nulls_first())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            batch = batch.select(["shard", "row", "doc_id", "n", "ids"])
            shards, heads = batch.column(0).to_numpy(), np.flatnonzero(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            # runs of one shard; a tree stands in front of its documents
            starts = np.unique([0, *heads, *(np.flatnonzero(np.diff(shards)) + 1)]).astype(int) if len(shards) else []
            for lo, hi in zip(starts, [*starts[1:], len(shards)]):
                if lo in heads:
                    tree, of, lo = pickle.loads(batch.column(4)[lo].as_py()), shards[lo], lo + 1
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                first = int(shards[lo]) * fan
                # a shard of which nothing was drawn is small and stays whole
                cut = tree.place(sketches(part), _ties(part.column(1).to_numpy())) if of == shards[lo] else np.zeros(hi - lo, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first + cut, pa.int64()), *part.columns[1:]], ["shard", "row", "doc_id", "n", "ids"])

    return together.mapInArrow(place, f"shard bigint, {_TOKENS}")


def pack_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of ``docs(doc_id, text)``.

    Every id of every text and the end id behind it lies in exactly one piece;
    null text is the end id alone. Sequences hold ``window`` ids, those at a
    shard's end a smaller power of two, so nothing is padded. Documents are
    dealt to shards by cuts along the widest directions of their projected
    weights, so that lexically close ones meet at any size of the table. The driver holds one tree of at
    most ``fan`` parts and its sample; parts are cut further in tasks (:func:`_cut_again`). Rows that share a doc_id are
    documents of their own, and equal ones may lie in several shards. A shard holds its own inverted
    index, weighted by document counts over the whole corpus, and packs itself;
    sequence ids go on from the shard's number times 2**32.
    """
    s = settings
    spark = docs.sparkSession
    tokens = tokenize(docs, s)
    sums = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    if not sums.n:
        return spark.createDataFrame([], _PIECES)
    size = encoder(s.vocabulary).size
    counts = document_counts(tokens, size)
    idf = np.log(1 + (sums.n - counts + 0.5) / (counts + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)  # a number per id of the vocabulary
    depth, fan = levels(-(-sums.tokens // s.shard_tokens), s.fan)
    shards = fan**depth
    mean = sums.tokens / sums.n
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(shard: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ids = [_array(blob, n) for _, n, blob in rows]
        index = Index(ids, shared.value, mean, s)
        pieces = pack([len(x) for x in ids], index.neighbours, s.window)
        wide = [zlib.crc32(ids[p.doc][p.start : p.start + p.length].astype("<u4").tobytes()) for p in pieces]
        columns = [
            [rows[p.doc][0] for p in pieces],
            [p.start for p in pieces],
            [p.length for p in pieces],
            wide,
            [len(ids[p.doc]) for p in pieces],
            [(shard << 32) + p.sequence for p in pieces],
            [p.offset for p in pieces],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for shard, doc, n, blob in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
                if held and shard != now:
                    yield work(now, held)
                    held = []
                now = shard
                held.append((doc, n, blob))
        if held:
            yield work(now, held)

    def sketches(batch: pa.RecordBatch) -> np.ndarray:
        sizes, blobs = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        return sketches_of([_array(blob, n) for n, blob in zip(sizes, blobs)], shared.value, mean, s)

    # documents drawn by their tokens, about ``cuts`` a part
    step = sums.tokens / fan / s.cuts
    some = _sampled(tokens.withColumn("shard", F.lit(0).cast("bigint")), step, sketches, s).collect() if shards > 1 else []
    tree = spark.sparkContext.broadcast(_grown([(r.row, r.n, r.vector) for r in some], step, fan, s))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_numpy()
            shard = tree.value.place(sketches(batch), _ties(rows)) if shards > 1 else np.zeros(len(rows), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], ["shard", "row", "doc_id", "n", "ids"])

    placed = tokens.select("row", "doc_id", "n", "ids").mapInArrow(place, f"shard bigint, {_TOKENS}")
    for level in range(2, depth + 1):
        placed = _cut_again(placed, fan, sums.tokens / fan**level, shards // fan ** (level - 1), sketches, s)
    dealt = placed.repartition(parts, "shard").sortWithinPartitions("shard", "row")
    return dealt.mapInArrow(run, _PIECES)


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into."""
    return pack_documents(docs)
