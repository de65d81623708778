"""SimHash near-duplicates by pigeonring filtering of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import components, durable, local_components, per_batch, query, table

BITS = 64
#: Compared pairs held at once by a task.
PAIR_BLOCK = 1 << 20


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if set in over half the shingle hashes.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer
    words than ``width`` has its whole sequence as the one shingle; one without
    words has the fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        stops = ends[width - 1 :].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; null text has no words. ``fp`` holds the 64 bits as a signed bigint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t or b"", width, seed) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(per_batch(run), "doc_id bigint, fp bigint")


def segments(budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``budget + 1`` segments in a ring; every proportional budget then rounds down to l - 1 for l segments."""
    n = budget + 1
    cuts = [round(bits * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _u64(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64)


def chain_keys(fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the chains of two segments that two linked fingerprints can share.

    A chain's first segment must be equal and its second may differ in one bit.
    Of a pair that differs in the second segment, the one whose bit is set looks
    the other up with that bit cleared, so ``home`` rows stand in their own
    bucket and the others visit. Returns key, fingerprint and home flag.
    """
    ring = segments(budget)
    keys, owners, home = [], [], []
    for i, (at, width) in enumerate(ring):
        to, size = ring[(i + 1) % len(ring)]
        first = (fps >> np.uint64(at)) & np.uint64((1 << width) - 1)
        second = (fps >> np.uint64(to)) & np.uint64((1 << size) - 1)
        base = (np.uint64(i) << np.uint64(56)) | (first << np.uint64(size))
        keys.append(base | second)
        owners.append(fps)
        home.append(np.ones(len(fps), bool))
        for bit in range(size):
            has = (second >> np.uint64(bit)) & np.uint64(1) == 1
            keys.append(base[has] | (second[has] ^ np.uint64(1 << bit)))
            owners.append(fps[has])
            home.append(np.zeros(int(has.sum()), bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(home)


def within_chain(a: np.ndarray, b: np.ndarray, start: np.ndarray, budget: int) -> np.ndarray:
    """Whether every chain from ``start`` stays within its share of the budget, and the whole ring within the budget."""
    ring = segments(budget)
    lows, masks = _u64([at for at, _ in ring]), _u64([(1 << w) - 1 for _, w in ring])
    differing = a ^ b
    total = np.zeros(len(a), np.int64)
    alive = np.ones(len(a), bool)
    for length in range(1, len(ring) + 1):
        seg = (start + length - 1) % len(ring)
        total += np.bitwise_count((differing >> lows[seg]) & masks[seg])
        alive &= total <= budget * length // len(ring)
    return alive


def _linked(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, budget: int, crowd: int):
    """Links within whole buckets sorted by key, and the members of buckets of over ``crowd`` rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    crowded = np.repeat(sizes > crowd, sizes)
    rest = fps[crowded]
    order = np.lexsort((~home, keys))
    keys, fps, home = keys[order], fps[order], home[order]
    inside = np.add.reduceat(home.astype(np.int64), starts)
    row = np.arange(len(keys))
    first = np.repeat(starts, sizes)
    # a home row meets the home rows before it, a visitor all home rows of the bucket
    partners = np.where(home, row - first, np.repeat(inside, sizes))
    partners[crowded] = 0
    left, right = [], []
    cuts = np.searchsorted(np.cumsum(partners), np.arange(0, int(partners.sum()) + PAIR_BLOCK, PAIR_BLOCK))
    for lo, hi in zip(np.r_[0, cuts[1:-1], cuts[-1]], np.r_[cuts[1:-1], cuts[-1], len(keys)]):
        n = partners[lo:hi]
        if not n.sum():
            continue
        a = np.repeat(row[lo:hi], n)
        b = np.repeat(first[lo:hi], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = within_chain(fps[a], fps[b], (keys[a] >> np.uint64(56)).astype(np.int64), budget) & (fps[a] != fps[b])
        left.append(fps[a][near])
        right.append(fps[b][near])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rest
    node, root = local_components(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))
    return node[node != root], root[node != root], rest


def _link_batches(budget: int, crowd: int, rows_at_once: int = 1 << 19):
    """Reads rows sorted by key, holds whole buckets up to a bound and yields their links.

    A bucket beyond the bound is passed on in pieces without being held.
    """

    def out(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, passing = 0, None

        def work(k, f, h):
            a, b, rest = _linked(k, f, h, budget, crowd)
            yield out(a, b)
            rest = np.unique(rest.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64())], ["a", "b"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            h = batch.column(2).to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            held.append((k, f, h))
            count += len(k)
            if count < rows_at_once:
                continue
            k, f, h = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
            if last and passing is not None and k[0] == passing:
                cut = int(np.argmax(k != passing))
                rest = np.unique(f[:cut].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64())], ["a", "b"])
                k, f, h, last = k[cut:], f[cut:], h[cut:], last - cut
                passing = None
            if last:
                yield from work(k[:last], f[:last], h[:last])
            k, f, h = k[last:], f[last:], h[last:]
            if len(k) > crowd:
                rest = np.unique(f.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64())], ["a", "b"])
                passing, held, count = k[0], [], 0
            else:
                held, count = [(k, f, h)], len(k)
        if held:
            k, f, h = (np.concatenate(x) for x in zip(*held))
            if passing is not None and len(k) and k[0] == passing:
                cut = int(np.argmax(k != passing)) if (k != passing).any() else len(k)
                rest = np.unique(f[:cut].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rest), pa.nulls(len(rest), pa.int64())], ["a", "b"])
                k, f, h = k[cut:], f[cut:], h[cut:]
            if len(k):
                yield from work(k, f, h)

    return run


def _near_masks(radius: int) -> list[int]:
    """All 64-bit words of up to ``radius`` set bits, as signed numbers."""
    words = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    return [w - (1 << BITS) if w >= 1 << (BITS - 1) else w for w in words]


def crowd_links(fps: DataFrame, budget: int) -> DataFrame:
    """Links among the fingerprints of crowded buckets, without listing their pairs.

    Two words at distance 4 or less share a word within 2 of both, and all who
    share one are within 4 of each other. So each fingerprint names the words
    within half the budget, and links to the smallest one that names the same.
    Work is linear in the fingerprints.
    """
    half = budget // 2
    named = fps.select("a", F.explode(F.transform(F.lit(_near_masks(half)), lambda m: F.col("a").bitwiseXOR(m))).alias("c"))
    least = named.groupBy("c").agg(F.min("a").alias("b"))
    return named.join(least, "c").where("a != b").select("a", "b").distinct()


def link_fingerprints(distinct: DataFrame, budget: int = 4, crowd: int = 2048) -> DataFrame:
    """(node, root) for all distinct fingerprints ``fp`` that have another within ``budget`` differing bits.

    Pigeonring filter: of ``budget + 1`` segments in a ring, a linked pair has a
    start from which every chain of l segments differs in at most
    budget * l / (budget + 1) bits. Rows are dealt by the chain of two segments
    (27 bits, one of them free), longer chains prune the pairs of a bucket,
    and the whole ring is the Hamming check. Only a spanning forest leaves a
    task. Buckets of over ``crowd`` rows go through :func:`crowd_links`, which
    needs an even budget.
    """
    if budget % 2:
        raise ValueError("the budget must be even")

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, fp, home = chain_keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), budget)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(home)], ["k", "fp", "home"])

    rows = distinct.select("fp").mapInArrow(per_batch(keyed), "k bigint, fp bigint, home boolean")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "k").sortWithinPartitions("k")
    links = durable(dealt.mapInArrow(_link_batches(budget, crowd), "a bigint, b bigint"))
    crowded = links.where("b is null").select("a").distinct()
    edges = links.where("b is not null")
    if not crowded.isEmpty():
        edges = edges.union(crowd_links(crowded, budget))
    return components(edges)


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text, ...)``.

    Equal fingerprints are folded before any search. ``component_id`` is the
    smallest doc_id reachable over links of ``budget`` or fewer differing bits.
    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows appear as often as they come; a null doc_id is never a component's id
    unless nothing else is in it. Other columns are ignored. An empty table
    gives an empty result.
    """
    rows = durable(fingerprints(docs, width, seed))
    folded = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = link_fingerprints(folded, budget)
    named = folded.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group; of rows that share it, one.

    Documents without a doc_id stay: nothing tells them apart.
    """
    groups = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
