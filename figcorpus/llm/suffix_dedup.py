"""Removal of repeated byte strings by prefix-free parsing of the corpus.

A rolling hash over the text sets triggers. They cut every document into
phrases, twice: coarse phrases begin where the hash of the window is divisible
by a number, fine ones where the smallest hash among the windows of a match
changes. Consecutive phrases overlap by the match length less one, so each
string of the match length lies in exactly one phrase of either parse, and
equal strings lie in phrases with the same trigger.

The dictionary of coarse phrases settles what is copied whole: a phrase in a
document with a larger doc_id than the smallest that holds it is a repeat from
end to end. What is left are fine phrases whose trigger occurs elsewhere too.
Their suffixes are sorted trigger by trigger, as far as a match goes; together
with the smallest doc_id at which the parse holds each phrase, that order shows
the smallest document of every string. Only dictionary entries are shuffled,
one per phrase and chunk of documents, however often a chunk holds it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import per_batch, query, table
from figcorpus.session import scratch_dir

#: Positions of a text parsed at once.
SEGMENT = 1 << 14
#: Positions of a fine phrase at most, so that a word has a bit for each.
MASK_BITS = 63
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Settings:
    """``match``: bytes of a repeated string; ``window``: bytes under the rolling hash; ``every``: mean bytes of a coarse phrase.

    ``chunk_bytes`` and ``chunk_rows`` bound a chunk (but for one longer
    document), ``bucket_bytes`` the corpus bytes behind a bucket of triggers.
    """

    match: int = 50
    window: int = 24
    every: int = 256
    chunk_bytes: int = 4 << 20
    chunk_rows: int = 4096
    bucket_bytes: int = 16 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, SEGMENT + 128)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), SEGMENT + 128)


def rolling(x: np.ndarray, window: int) -> np.ndarray:
    """Mixed Karp-Rabin hash (modulo 2**64) of the ``window`` bytes from every position."""
    n = len(x) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _DOWN[: len(x)], out=sums[1:])
    h = (sums[window:] - sums[:n]) * _UP[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, h
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


@dataclass
class Parse:
    """Phrases of the documents of a chunk, laid end to end: starts, stops and documents of fine and coarse ones.

    A phrase covers the match starts from its own start to its stop, and its
    text goes on for the match length less one.
    """

    fine: np.ndarray
    fine_stop: np.ndarray
    triggers: np.ndarray
    coarse: np.ndarray
    coarse_stop: np.ndarray
    coarse_doc: np.ndarray


def parse(x: np.ndarray, bounds: np.ndarray, s: Settings, fine_too: bool = True) -> Parse:
    """Parse documents of at least ``match`` bytes each; document i is ``x[bounds[i] : bounds[i + 1]]``."""
    stops = bounds[1:] - s.match + 1
    fine, triggers, coarse = [], [], [bounds[:-1]]
    total = int(stops[-1]) if len(stops) else 0
    # starts whose string would run into the next document
    torn = np.zeros(total + 1, np.int32)
    torn[stops[:-1]] += 1
    torn[bounds[1:-1]] -= 1
    torn = np.cumsum(torn[:-1]) > 0
    # a segment's first start always opens a phrase, which at most adds an entry
    for at in range(0, total, SEGMENT):
        upto = min(total, at + SEGMENT)
        h = rolling(x[at : upto + s.match - 1], s.window)
        ok = ~torn[at:upto]
        cuts = np.flatnonzero((h[: upto - at] % np.uint64(s.every) == 0) & ok) + at
        coarse.append(cuts)
        if not fine_too:
            continue
        low = sliding_min(h, s.match - s.window + 1)
        fresh = np.r_[True, (low[1:] != low[:-1]) | ~ok[:-1]]
        starts = np.flatnonzero(fresh & ok)
        fine.append(starts + at)
        triggers.append(low[starts])
    none = np.zeros(0, np.int64)
    coarse = np.unique(np.concatenate(coarse))
    coarse_doc = np.searchsorted(bounds, coarse, "right") - 1
    coarse_stop = np.minimum(np.r_[coarse[1:], total], stops[coarse_doc]) if len(coarse) else none
    fine, triggers = np.concatenate([none, *fine]), np.concatenate([none.astype(np.uint64), *triggers])
    fine_stop = np.minimum(np.r_[fine[1:], total], stops[np.searchsorted(bounds, fine, "right") - 1]) if len(fine) else none
    if len(fine) and (fine_stop - fine).max() > MASK_BITS:
        more = -(-(fine_stop - fine) // MASK_BITS)
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        fine, fine_stop, triggers = np.repeat(fine, more) + nth * MASK_BITS, np.repeat(fine_stop, more), np.repeat(triggers, more)
        fine_stop = np.minimum(fine_stop, fine + MASK_BITS)
    return Parse(fine, fine_stop, triggers, coarse, coarse_stop, coarse_doc)


# chunks: documents that travel together


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_next_batch()


def to_chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """(chunk, bytes, docs): documents in their order of reading, packed together.

    ``docs`` must have ``doc_id`` and binary ``text``; all its columns travel
    along. The chunks are written once, as a table bucketed by chunk in the
    shared folder, so that no later join moves texts.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = _lengths(batch.column(at))
            lo = 0
            while lo < batch.num_rows:
                upto = np.cumsum(sizes[lo : lo + s.chunk_rows])
                hi = lo + max(1, int(np.searchsorted(upto, s.chunk_bytes, "right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial]), pa.array([int(upto[hi - lo - 1])]), pa.array([_packed(part)], pa.binary())], ["chunk", "bytes", "docs"]
                )
                serial, lo = serial + 1, hi

    name = f"chunks_{uuid.uuid4().hex}"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(run, "chunk bigint, bytes bigint, docs binary").repartition(parts, "chunk")
    writer = packed.write.bucketBy(parts, "chunk").sortBy("chunk").option("compression", "none")
    writer.option("path", scratch_dir(docs.sparkSession, "chunks")).saveAsTable(name)
    return docs.sparkSession.table(name)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)


@dataclass
class _Chunk:
    """A chunk's rows, and its parsed documents end to end: those with a doc_id and room for a match."""

    rows: pa.RecordBatch
    at: list[int]
    ids: np.ndarray
    bounds: np.ndarray
    text: bytes
    parse: Parse

    def coarse_names(self, s: Settings) -> list[bytes]:
        text, digest, more = memoryview(self.text), xxhash.xxh3_128_digest, s.match - 1
        return [digest(text[a : b + more]) for a, b in zip(self.parse.coarse.tolist(), self.parse.coarse_stop.tolist())]

    def phrase(self, start: int, stop: int, s: Settings) -> memoryview:
        return memoryview(self.text)[start : stop + s.match - 1]


def _read(blob: bytes, s: Settings, fine_too: bool = True) -> _Chunk:
    rows = _unpacked(blob)
    ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
    texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
    at = [i for i, (d, t) in enumerate(zip(ids, texts)) if d is not None and t is not None and len(t) >= s.match]
    text = b"".join(texts[i] for i in at)
    bounds = np.cumsum([0, *(len(texts[i]) for i in at)])
    found = parse(np.frombuffer(text, np.uint8), bounds, s, fine_too)
    return _Chunk(rows, at, np.array([ids[i] for i in at], np.int64), bounds, text, found)


# first exchange: which document first holds a coarse phrase


def _dealt(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its values) by the values' remainder."""
    by = values % np.uint64(buckets)
    order = np.argsort(by, kind="stable")
    cut = np.searchsorted(by[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, order[cut[b] : cut[b + 1]]


def _binary(values) -> pa.Array:
    return pa.array(values, pa.binary())


def _own_firsts(c: _Chunk, names: list[bytes]) -> dict[bytes, int]:
    """The smallest doc_id of the chunk for each coarse phrase."""
    ids = c.ids[c.parse.coarse_doc]
    firsts: dict[bytes, int] = {}
    for i in np.argsort(ids, kind="stable").tolist():
        firsts.setdefault(names[i], int(ids[i]))
    return firsts


_COARSE = "bucket int, chunk bigint, phrases binary, firsts binary"


def _coarse_entries(s: Settings, buckets: int):
    """Per chunk and bucket: the distinct coarse phrases with the chunk's smallest doc_id for each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            firsts = _own_firsts(c := _read(blob, s, fine_too=False), c.coarse_names(s))
            keys = np.frombuffer(b"".join(firsts), "<u8").reshape(-1, 2)
            ids = np.array(list(firsts.values()), np.int64)
            rows += [(b, number, keys[own].tobytes(), ids[own].tobytes()) for b, own in _dealt(keys[:, 0], buckets)]
        b, c, p, f = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), _binary(p), _binary(f)], ["bucket", "chunk", "phrases", "firsts"])

    return per_batch(run)


def _by_bucket(work):
    """Reads rows sorted by bucket and hands on those of one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return run


_COARSE_REPLIES = "chunk bigint, phrases binary, firsts binary"


def _coarse_replies(rows: list[tuple]) -> pa.RecordBatch:
    """To each chunk those of its phrases that a smaller document elsewhere holds, and that document."""
    sizes = [len(r[3]) // 8 for r in rows]
    keys = np.concatenate([np.frombuffer(r[2], "<u8").reshape(-1, 2) for r in rows])
    ids = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
    order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
    fresh = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(1)]
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    out, hi = [], 0
    for r, size in zip(rows, sizes):
        told = np.flatnonzero(least[hi : hi + size] < ids[hi : hi + size]) + hi
        hi += size
        if len(told):
            out.append((r[1], keys[told].tobytes(), least[told].tobytes()))
    c, p, f = zip(*out) if out else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), _binary(p), _binary(f)], ["chunk", "phrases", "firsts"])


def _opened(c: _Chunk, coarse: list, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Which match starts the first exchange has settled as repeats, and which fine phrases have others."""
    names = c.coarse_names(s)
    first = _own_firsts(c, names)
    for r in coarse:
        keys = r["phrases"]
        first.update((keys[16 * i : 16 * i + 16], d) for i, d in enumerate(np.frombuffer(r["firsts"], np.int64).tolist()))
    p = c.parse
    bad = np.fromiter(map(first.__getitem__, names), np.int64, len(names)) < c.ids[p.coarse_doc]
    edge = np.zeros(len(c.text) + 1, np.int8)
    edge[p.coarse[bad]] += 1
    np.subtract.at(edge, p.coarse_stop[bad], 1)
    settled = np.cumsum(edge[:-1], dtype=np.int8) > 0
    free = np.r_[0, np.cumsum(~settled, dtype=np.int32)]
    return settled, free[p.fine_stop] > free[p.fine]


# second exchange: which triggers of open phrases another chunk has


def _short(triggers: np.ndarray) -> np.ndarray:
    """48 bits of a trigger; the bucket holds others. Equal triggers stay equal, a false match only costs work."""
    return triggers >> np.uint64(16)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_FINE = "bucket int, chunk bigint, triggers binary"


def _fine_entries(s: Settings, buckets: int):
    """Per chunk and bucket: the distinct triggers of open phrases."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for number, blob, coarse in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            c = _read(blob, s)
            triggers = np.unique(c.parse.triggers[_opened(c, coarse, s)[1]])
            rows += [(b, number, _six(_short(triggers[own]))) for b, own in _dealt(triggers, buckets)]
        b, c, t = zip(*rows) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), _binary(t)], ["bucket", "chunk", "triggers"])

    return per_batch(run)


_FINE_REPLIES = "chunk bigint, triggers binary"


def _fine_replies(rows: list[tuple]) -> pa.RecordBatch:
    """To each chunk those of its triggers that another chunk has as well."""
    sizes = [len(r[2]) // 6 for r in rows]
    triggers = _from_six(b"".join(r[2] for r in rows))
    ordered = np.sort(triggers, kind="stable")  # each chunk's are sorted already
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    hit = _among(triggers, shared)
    out, hi = [], 0
    for r, size in zip(rows, sizes):
        found = triggers[hi : hi + size][hit[hi : hi + size]]
        hi += size
        if len(found):
            out.append((r[1], _six(found)))
    c, t = zip(*out) if out else ((),) * 2
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), _binary(t)], ["chunk", "triggers"])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


# third exchange: the dictionary of fine phrases that may hold a repeat


def _asked(c: _Chunk, coarse: list, fine: list, s: Settings) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The settled starts, and the fine phrases in question as (start, stop, trigger, doc_id).

    Those are open ones whose trigger another chunk has, or open phrases of
    two documents of this chunk.
    """
    settled, open_ = _opened(c, coarse, s)
    p = c.parse
    at = np.flatnonzero(open_)
    triggers, doc = p.triggers[at], np.searchsorted(c.bounds, p.fine[at], "right") - 1
    shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *[_from_six(r["triggers"]) for r in fine]]))
    order = np.lexsort((doc, triggers))
    t, d = triggers[order], doc[order]
    several = np.unique(t[1:][(t[1:] == t[:-1]) & (d[1:] != d[:-1])])
    mine = at[_among(triggers, several) | _among(_short(triggers), shared)]
    ids = c.ids[np.searchsorted(c.bounds, p.fine[mine], "right") - 1]
    return settled, list(zip(p.fine[mine].tolist(), p.fine_stop[mine].tolist(), p.triggers[mine].tolist(), ids.tolist()))


_PHRASES = "chunk bigint, trigger bigint, name bigint, first bigint, phrase binary"


def _phrases(s: Settings):
    """Per chunk, each fine phrase in question once, with the smallest doc_id of the chunk that has it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for number, blob, coarse, fine in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            c = _read(blob, s)
            found: dict[tuple[int, int], list] = {}
            for a, b, trigger, doc in _asked(c, coarse, fine, s)[1]:
                phrase = c.phrase(a, b, s)
                key = (trigger, xxhash.xxh3_64_intdigest(phrase))
                old = found.get(key)
                if old is None:
                    found[key] = [doc, phrase]
                elif doc < old[0]:
                    old[0] = doc
            rows += [(number, t, k, d, bytes(x)) for (t, k), (d, x) in found.items()]
        c, t, k, d, x = zip(*rows) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [
                pa.array(c, pa.int64()),
                pa.array(np.array(t, np.uint64).view(np.int64)),
                pa.array(np.array(k, np.uint64).view(np.int64)),
                pa.array(d, pa.int64()),
                pa.array(x, pa.binary()),
            ],
            ["chunk", "trigger", "name", "first", "phrase"],
        )

    return per_batch(run)


def suffix_firsts(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, match: int) -> np.ndarray:
    """The smallest of ``docs`` among the suffixes that agree with each one over ``match`` bytes.

    Sorts the suffixes of the dictionary by their first ``match`` bytes, as
    words of eight, and ties by document; runs of equal ones are neighbours.
    """
    offsets = [*range(0, match - 8, 8), match - 8]
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    keys = [np.ascontiguousarray(words[starts + o]).view(">u8").ravel().astype(np.uint64) for o in offsets]
    order = np.lexsort((docs, *reversed(keys)))
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for k in keys:
        fresh[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(docs), np.int64)
    out[order] = docs[order][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return out


_ANSWERS = "chunk bigint, trigger bigint, name bigint, mask bigint"


def _answers(s: Settings, rows_at_once: int = 1 << 16):
    """Reads phrases sorted by trigger; a bit for each start whose string a smaller document has than the phrase's first."""

    def work(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        column = t.column("phrase").cast(pa.large_binary()).combine_chunks()
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        first = t.column("first").to_numpy()
        sizes = np.diff(ends) - s.match + 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        least = suffix_firsts(data, ends[owner] + place, first[owner], s.match)
        bits = (least < first[owner]).astype(np.uint64) << place.astype(np.uint64)
        masks = np.bitwise_or.reduceat(bits, np.cumsum(sizes) - sizes).view(np.int64)
        keep = pa.array(masks != 0)
        return pa.RecordBatch.from_arrays(
            [t.column(n).combine_chunks().filter(keep) for n in ("chunk", "trigger", "name")] + [pa.array(masks).filter(keep)],
            ["chunk", "trigger", "name", "mask"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            triggers = batch.column(1).to_numpy(zero_copy_only=False)
            if count >= rows_at_once:
                # a trigger's phrases are worked on together
                last = held[-1].column(1)[held[-1].num_rows - 1].as_py()
                cut = int(np.searchsorted(triggers, last, "right"))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut == batch.num_rows:
                    count += cut
                    continue
                yield work(held)
                held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield work(held)

    return run


# outcome


def removed_starts(c: _Chunk, coarse: list, fine: list, answers: list, s: Settings) -> np.ndarray:
    """For each match start of a chunk whether its string also starts in a smaller document."""
    masks = {(a["trigger"] & (2**64 - 1), a["name"] & (2**64 - 1)): a["mask"] for a in answers}
    gone, asked = _asked(c, coarse, fine, s)
    names = [(t, xxhash.xxh3_64_intdigest(c.phrase(a, b, s))) for a, b, t, _ in asked]
    # which document of the chunk has a phrase first: all later ones repeat it
    first: dict[tuple[int, int], int] = {}
    for key, (_, _, _, doc) in zip(names, asked):
        if doc < first.get(key, 1 << 63):
            first[key] = doc
    for key, (a, b, _, doc) in zip(names, asked):
        if first[key] < doc:
            gone[a:b] = True
        elif mask := masks.get(key):
            gone[a:b] |= (mask >> np.arange(b - a)) & 1 == 1
    return gone


def spans_of(gone: np.ndarray, n: int, match: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of bytes that the removed strings cover."""
    at = np.flatnonzero(gone)
    if not len(at):
        return at, at
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + match, -1)
    cover = np.r_[0, (np.cumsum(edge[:-1]) > 0).astype(np.int8), 0]
    step = np.diff(cover)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _kept(text: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    edges = [0, *np.c_[starts, stops].ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _whole_characters(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without characters of which they hold only a part."""

    def inside(at: int) -> bool:
        return at < len(text) and 0x80 <= text[at] < 0xC0

    out = []
    for a, b in zip(starts.tolist(), stops.tolist()):
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _bundle(chunks: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """The chunks with the array of their parts; a chunk's parts are bounded by its own phrases."""
    listed = parts.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in parts.columns if c != "chunk"])).alias(name))
    return chunks.join(listed, "chunk", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))


def repeated_spans(docs: DataFrame, finish, schema: str, settings: Settings = Settings()) -> DataFrame:
    """Find every repeated string and hand each row to ``finish``.

    ``docs`` has ``doc_id``, binary ``text`` and any other columns. ``finish``
    gets the rows of a chunk as a record batch and for each row the starts and
    stops of its repeated bytes, and returns a record batch of ``schema``.

    Rows with null text, null doc_id or fewer bytes than a match have no spans,
    and a null doc_id makes nothing a repeat. Rows that share a doc_id are not
    smaller than each other. Hot phrases reach a task once per chunk.
    """
    s = settings
    spark = docs.sparkSession
    chunks = to_chunks(docs, s)
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // s.bucket_bytes))
    def exchanged(entries: DataFrame, work, schema: str, name: str) -> DataFrame:
        path = scratch_dir(spark, name)
        dealt = entries.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
        dealt.mapInArrow(_by_bucket(work), schema).write.parquet(path)
        return spark.read.parquet(path)

    bundle = chunks.select("chunk", "docs")
    coarse = exchanged(bundle.mapInArrow(_coarse_entries(s, buckets), _COARSE), _coarse_replies, _COARSE_REPLIES, "coarse")
    bundle = _bundle(bundle, coarse, "coarse")
    fine = exchanged(bundle.mapInArrow(_fine_entries(s, buckets), _FINE), _fine_replies, _FINE_REPLIES, "fine")
    bundle = _bundle(bundle, fine, "fine")
    phrases = bundle.mapInArrow(_phrases(s), _PHRASES).repartition(parts, "trigger").sortWithinPartitions("trigger")
    path = scratch_dir(spark, "answers")
    phrases.mapInArrow(_answers(s), _ANSWERS).write.parquet(path)
    bundle = _bundle(bundle, spark.read.parquet(path), "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for blob, coarse, fine, answers in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                c = _read(blob, s)
                spans = [(none, none)] * c.rows.num_rows
                if c.at:
                    gone = removed_starts(c, coarse, fine, answers, s)
                    for k in np.flatnonzero(np.logical_or.reduceat(gone, c.bounds[:-1])).tolist():
                        lo, hi = c.bounds[k : k + 2]
                        spans[c.at[k]] = spans_of(gone[lo:hi], int(hi - lo), s.match)
                yield finish(c.rows, spans)

    return bundle.select("docs", "coarse", "fine", "answers").mapInArrow(run, schema)


def _digests(rows: pa.RecordBatch, spans: list) -> pa.RecordBatch:
    texts = [t or b"" for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]
    lost = [int((b - a).sum()) for a, b in spans]
    kept = [hashlib.sha256(_kept(t, a, b)).hexdigest() for t, (a, b) in zip(texts, spans)]
    listed = [list(zip(a.tolist(), b.tolist())) for a, b in spans]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    spans_column = pa.array([[{"start": a, "stop": b} for a, b in x] for x in listed], kind)
    out = [rows.column(rows.schema.get_field_index("doc_id")), pa.array(map(len, texts), pa.int64()), pa.array(lost, pa.int64())]
    out += [pa.array(map(len, listed), pa.int64()), pa.array(kept, pa.string()), spans_column]
    return pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup_report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs(doc_id, text)``.

    ``spans`` are the maximal runs of bytes covered by strings of
    ``settings.match`` bytes that also start in a document with a smaller
    doc_id. Null text counts as empty; see :func:`repeated_spans` for the rest.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
    return repeated_spans(rows, _digests, kind, settings)


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents")).drop("spans")


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """The documents without their repeated strings; those of which nothing is left go.

    A character stays unless all its bytes are repeated, so texts stay valid.
    ``n_chars``, where it is a column, counts what is left.
    """
    columns = docs.columns
    rows = docs.withColumn("text", F.col("text").cast("binary"))

    def finish(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        left = [t if t is None else _kept(t, *_whole_characters(t, *x)).decode("utf-8", "replace") for t, x in zip(texts, spans)]
        stay = pa.array([not t or bool(x) for t, x in zip(texts, left)])
        out = [pa.array(left, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays(out, batch.schema.names).filter(stay)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = repeated_spans(rows, finish, kinds, settings)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
