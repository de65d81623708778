"""How filters interact: what each removes, repeats and alone catches, for every order of them, per part of a corpus.

A filter's failing rows of a part are a sorted posting list of row ids. Lists are
dealt out by part and id, so a list of any length lies in many id ranges; inside a
range the union of every subset of filters is merged from the lists, the shorter
list's ids galloping through the longer one. Sizes of unions are summed over the
ranges, and everything the audit reports is a difference of two of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import durable, per_batch, query, table, text_buffer

ENTRY = "part string, id bigint, lists bigint"
GALLOP = 64


def places(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each of the sorted ``ids`` stands or would stand in the sorted list ``among``.

    Ids go in runs. From where the last run ended, steps that double find a
    bound for the run's largest id, and only the stretch between is searched.
    """
    out = np.empty(len(ids), np.int64)
    start = 0
    for i in range(0, len(ids), GALLOP):
        run = ids[i : i + GALLOP]
        step = 1
        while start + step < len(among) and among[start + step] < run[-1]:
            step *= 2
        found = np.searchsorted(among[start : start + step + 1], run) + start
        out[i : i + GALLOP] = found
        start = int(found[-1])
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two sorted lists without repeats."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    if not len(short):
        return long
    at = places(short, long)
    new = long[np.minimum(at, len(long) - 1)] != short
    return np.insert(long, at[new], short[new])


def union_sizes(lists: list[np.ndarray]) -> np.ndarray:
    """Sizes of the unions of all subsets of the lists; a subset is the sum of 1 << position of its members.

    A subset's union merges its last member into the union of the others, so
    every k-way merge reuses a shorter one.
    """
    unions = [np.zeros(0, np.int64)]
    for one in lists:
        unions += [merge(u, one) for u in unions]
    return np.array([len(u) for u in unions], np.int64)


def block_sizes(ids: np.ndarray, lists: np.ndarray, n_filters: int, n_marks: int) -> list[np.ndarray]:
    """Union sizes of one block's posting lists: of all ids, then of those in each mark's list."""
    postings = [np.unique(ids[lists >> k & 1 > 0]) for k in range(n_filters + n_marks)]
    out = [union_sizes(postings[:n_filters])]
    for mark in postings[n_filters:]:
        hit = []
        for one in postings[:n_filters]:
            short, long = (mark, one) if len(mark) <= len(one) else (one, mark)
            at = places(short, long)
            hit.append(short[long[np.minimum(at, len(long) - 1)] == short] if len(long) else short[:0])
        out.append(union_sizes(hit))
    return out


def _sizes(n_filters: int, n_marks: int, block: int):
    """Arrow batches of entries sorted by part and id to union sizes of each block of at most ``block`` ids.

    A block ends where a part ends, and never between two entries of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held_ids, held_lists, held = None, [], [], 0

        def flush(upto_id=None):
            """The rows of what is held, ids from ``upto_id`` on staying for the next block."""
            nonlocal held_ids, held_lists, held
            ids, lists = np.concatenate(held_ids), np.concatenate(held_lists)
            end = len(ids) if upto_id is None else int(np.searchsorted(ids, upto_id))
            held_ids, held_lists, held = [ids[end:]], [lists[end:]], len(ids) - end
            found = block_sizes(ids[:end], lists[:end], n_filters, n_marks)
            n = 1 << n_filters
            columns = [pa.array([part] * n, pa.string()), pa.array(np.arange(n))]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], ["part", "subset", *names])

        names = ["size", *[f"mark{k}" for k in range(n_marks)]]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").dictionary_encode()
            codes = np.asarray(parts.indices)
            ids, lists = np.asarray(batch.column("id")), np.asarray(batch.column("lists"))
            edges = np.flatnonzero(np.diff(codes)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(codes)]):
                name = parts.dictionary[int(codes[lo])].as_py()
                if name != part:
                    if held:
                        yield flush()
                    part, held_ids, held_lists, held = name, [], [], 0
                held_ids.append(ids[lo:hi])
                held_lists.append(lists[lo:hi])
                held += hi - lo
                if held >= block:
                    yield flush(ids[hi - 1])
        if held:
            yield flush()

    return run


def subset_unions(entries: DataFrame, n_filters: int, n_marks: int = 0, block: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """(part, subset, size, mark0, ...) summed over id ranges, for ``entries(part, id, lists)``.

    Bit k of ``lists`` says that the id is in list k: the filters' lists first,
    then the marks'. An id may come in several entries of its part. A subset of
    filters is a number with their bits; ``size`` counts the ids in any of its
    lists, ``markK`` those that are in the mark's list too. A hot part is cut by
    id like any other. Parts without entries have no rows.
    """
    n = parts or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartitionByRange(n, "part", "id").sortWithinPartitions("part", "id")
    names = ["size", *[f"mark{k}" for k in range(n_marks)]]
    schema = "part string, subset bigint, " + ", ".join(f"{x} bigint" for x in names)
    found = dealt.mapInArrow(_sizes(n_filters, n_marks, block), schema)
    return found.groupBy("part", "subset").agg(*[F.sum(x).alias(x) for x in names])


def audit(totals: DataFrame, unions: DataFrame, letters: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """A row per part of ``totals(part, n)``, order of the filters and step, from the parts' ``subset_unions``.

    (part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost ..., shapley).
    A part without failing rows has all its rows, zeros included.
    """
    k = len(letters)
    whole = (1 << k) - 1
    sizes = F.struct(F.col("size"), *[F.col(f"mark{i}") for i in range(len(marks))])
    # at most 2^k entries a part
    maps = unions.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", sizes))).alias("u"))
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(letters[x] for x in order), step, f, before))
            before |= 1 << f
    listed = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("filter_order", "step", "f", "before"), s)]) for s in steps]))
    both = totals.join(maps, "part", "left")

    def size(subset, field="size"):
        return F.coalesce(F.col("u")[subset.cast("bigint")][field], F.lit(0)).cast("bigint")

    def alone(f, field="size"):
        return size(F.lit(1 << f), field)

    def shapley(f):
        rest = [s for s in range(1 << k) if not s >> f & 1]
        orders = [math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) for s in rest]
        return sum((F.lit(n).cast("bigint") * (size(F.lit(s | 1 << f)) - size(F.lit(s))) for s, n in zip(rest, orders)), F.lit(0).cast("bigint"))

    told = both.select(
        "part", "n", "u",
        F.array(*[alone(f) for f in range(k)]).alias("fails"),
        F.array(*[size(F.lit(whole)) - size(F.lit(whole & ~(1 << f))) for f in range(k)]).alias("unique"),
        F.array(*[shapley(f) for f in range(k)]).alias("shapleys"),
        listed.alias("s"),
    )
    before = F.col("s.before")
    after = before.bitwiseOR(F.expr("shiftleft(1, s.f)"))
    removed = size(after) - size(before)
    return told.select(
        "part", "s.filter_order", "s.step",
        (F.col("n") - size(after)).alias("kept"),
        removed.alias("removed"),
        (F.col("fails")[F.col("s.f")] - removed).alias("redundant"),
        F.col("unique")[F.col("s.f")].alias("unique_fails"),
        *[(size(after, f"mark{i}") - size(before, f"mark{i}")).alias(f"{m}_lost") for i, m in enumerate(marks)],
        F.col("shapleys")[F.col("s.f")].alias("shapley"),
    )


@dataclass(frozen=True)
class Limits:
    """Bounds of the four filters on a document's own text."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_upper_percent: int = 2
    symbols: str = "#$%&*|"


UPPER = bytes(range(65, 91))
INNER = bytes(range(128, 192))  # bytes that go on a code point


def _marked(limits: Limits) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    symbols = limits.symbols.encode()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column("text"))
        fails = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            points = len(text.translate(None, INNER))
            upper = len(text) - len(text.translate(None, UPPER))
            words = text.split()  # bytes split at the six ASCII blanks only
            fails[i] = (
                (len(words) < limits.min_words)
                + (100 * len(set(words)) < limits.min_distinct_percent * len(words)) * 2
                + (100 * upper > limits.max_upper_percent * points) * 4
                + (len(text.translate(None, symbols)) < len(text)) * 8
            )
        kept = [batch.column(c) for c in ("part", "doc_id", "digest")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(fails)], ["part", "doc_id", "digest", "lists"])

    return run


def filter_entries(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Totals (part, n) and posting entries (part, id, lists) of five filters and two marks.

    ``docs(doc_id, text, source)``, ``labels(doc_id, quality, toxic)``; lists 0 to 4
    are the filters A to E, 5 the rows labelled good, 6 those labelled toxic.
    Null text is empty, a null source is the empty part. Every row is a document
    of its own, also where rows repeat. A row repeats (E) if a row with the same
    text has a smaller doc_id; a null doc_id is neither smaller nor larger than
    another and has no label. Several labels of a document count as one that
    says what any of them says. Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    read = rows.mapInArrow(per_batch(_marked(limits)), "part string, doc_id bigint, digest binary, lists bigint")
    # ids are the rows' places in what is written here
    placed = durable(read.withColumn("id", F.monotonically_increasing_id()))
    totals = placed.groupBy("part").agg(F.count("*").alias("n"))

    copies = placed.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1 and first is not null")
    share = 1000
    enough = placed.count() / share
    copies = durable(copies)
    # texts of at least a thousandth of all rows: no more than a thousand of them
    frequent = F.broadcast(copies.where(F.col("n") >= enough).select("digest", "first"))
    seldom = copies.where(F.col("n") < enough).select("digest", "first")
    known = placed.where("doc_id is not null").join(frequent.withColumnRenamed("first", "often"), "digest", "left")
    repeats = known.where("often < doc_id").select("part", "id")
    rest = known.where("often is null").join(seldom, "digest").where("first < doc_id").select("part", "id")

    told = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    bits = F.col("good").cast("bigint") * 32 + F.col("bad").cast("bigint") * 64
    marked = placed.where("doc_id is not null").select("part", "id", "doc_id").join(told.select("doc_id", bits.alias("lists")), "doc_id")
    entries = (
        placed.where("lists > 0").select("part", "id", "lists")
        .unionByName(repeats.unionByName(rest).withColumn("lists", F.lit(16).cast("bigint")))
        .unionByName(marked.select("part", "id", "lists"))
    )
    return totals, entries


def audit_filters(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), block: int = 1 << 16) -> DataFrame:
    """The audit of the filters A to E over ``docs``, per source; empty tables give no rows."""
    totals, entries = filter_entries(docs, labels, limits)
    return audit(totals, subset_unions(entries, 5, 2, block), "ABCDE", ("good", "toxic"))


def _oracle() -> str:
    steps, letters = [], "ABCDE"
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(f"('{''.join(letters[x] for x in order)}', {step}, {f}, {before})")
            before |= 1 << f
    return rf"""
with words as (
  select *, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
firsts as (select body, min(doc_id) as first from words group by body),
marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad
  from labels where doc_id is not null group by doc_id),
failing as (
  select coalesce(w.source, '') as part, coalesce(m.good, 0) as good, coalesce(m.bad, 0) as bad,
    (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
    + 4 * (100 * (length(w.body) - length(regexp_replace(w.body, '[A-Z]', '', 'g'))) > 2 * length(w.body))::int
    + 8 * regexp_matches(w.body, '[#$%&*|]')::int + 16 * coalesce(f.first < w.doc_id, false)::int as fails
  from words w join firsts f on w.body = f.body left join marks m on w.doc_id = m.doc_id),
steps(filter_order, step, f, before) as (values {', '.join(steps)}),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(bad) as bad from failing group by part, fails),
counted as (
  select part, filter_order, step, f,
    sum(n) filter (fails & (before | (1 << f)) = 0) as kept,
    sum(n) filter (fails & before = 0 and fails & (1 << f) > 0) as removed,
    sum(n) filter (fails & before > 0 and fails & (1 << f) > 0) as redundant,
    sum(n) filter (fails = (1 << f)) as unique_fails,
    sum(good) filter (fails & before = 0 and fails & (1 << f) > 0) as good_lost,
    sum(bad) filter (fails & before = 0 and fails & (1 << f) > 0) as toxic_lost
  from cells, steps group by part, filter_order, step, f, before)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
  coalesce(toxic_lost, 0)::bigint as toxic_lost, sum(coalesce(removed, 0)) over (partition by part, f)::bigint as shapley
from counted
"""


@query("op12_filter_interaction", _oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
