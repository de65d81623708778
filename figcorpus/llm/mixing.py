"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import json
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figcorpus.llm.common import WORD, durable, query, table

HASH_BITS = 48
#: Bits of the seeded hash that are still open after each round of the search for a cut.
OPEN_BITS = (36, 24, 0)


def fill_targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Share the budget by weight; whoever stands above ``most`` times its size stops there and its excess is reshared."""
    out: list[float | None] = [None] * len(sizes)
    while True:
        free = [i for i, t in enumerate(out) if t is None]
        left = budget - sum(t for t in out if t is not None)
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        for i in over:
            out[i] = float(most * sizes[i])
        if not over:
            return [float(left * weights[i] / total) if t is None else t for i, t in enumerate(out)]


class _Network:
    """Directed edges with capacity and cost, for successive shortest augmenting paths."""

    def __init__(self) -> None:
        self.out: dict = defaultdict(list)
        self.to: list = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a, b, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source, sink) -> None:
        """As much as fits, at the least cost."""
        while True:
            best, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and best[a] + self.cost[e] < best.get(b, 1 << 60):
                        best[b], via[b] = best[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if sink not in best:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            n = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= n
                self.room[e ^ 1] += n


def route(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, list[tuple[object, int]]]:
    """Words that each membership pattern gives to its sources.

    Capacity of a pattern is its words, once per repetition; the k-th repetition
    costs k - 1 a word, so words are repeated only where a quota needs it. Each
    group of patterns and sources that touch is a network of its own.
    """
    near = defaultdict(set)
    for p in patterns:
        for s in p:
            near[s].add(p)
    given: dict[tuple, list[tuple[object, int]]] = {p: [] for p in patterns}
    seen: set = set()
    for start in patterns:
        if start in seen:
            continue
        group, stack = [], [start]
        seen.add(start)
        while stack:
            p = stack.pop()
            group.append(p)
            for s in p:
                for q in near[s] - seen:
                    seen.add(q)
                    stack.append(q)
        net, arcs = _Network(), []
        for p in sorted(group, key=repr):
            for k in range(most):
                net.edge("words", ("pattern", p), patterns[p], k)
            for s in p:
                arcs.append((p, s, net.edge(("pattern", p), ("source", s), most * patterns[p], 0)))
        for s in sorted({s for p in group for s in p}, key=repr):
            net.edge(("source", s), "mix", max(0, int(quotas.get(s, 0))), 0)
        net.send("words", "mix")
        for p, s, e in arcs:
            if net.room[e ^ 1]:
                given[p].append((s, net.room[e ^ 1]))
    return given


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded(key: str, seed: int) -> Column:
    """48 bits of a seeded hash that other engines compute as well."""
    written = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(written), 1, HASH_BITS // 4), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Mix:
    """``sizes``: words of each source; ``targets``: of each source; ``rules``: per pattern key, the cuts of its seeded order.

    A cut (round, bound, source) says: copies of an earlier round, and those of
    this round whose hash is below the bound, belong to the source unless an
    earlier cut has them.
    """

    sizes: dict
    targets: dict
    rules: dict[str, list[tuple[int, int, str | None]]]


def _bounds(sized: DataFrame, cuts: list[tuple[int, str, int]]) -> dict[int, int]:
    """For each (cut, key, words): the hash bound below which lie about that many words of the key.

    Rounds of histograms narrow a cut to a slice of the hash range, then to the
    row in which it falls; the row is in if more than half of it is. Every
    round aggregates before it shuffles, and no window holds more than a slice.
    """
    spark = sized.sparkSession
    found = [(cut, key, words, 0) for cut, key, words in cuts]
    before_bits = HASH_BITS
    for bits in OPEN_BITS:
        if not found:
            break
        # a row per cut, and cuts are bounded by the patterns' limit
        at = spark.createDataFrame(found, "cut int, key string, words bigint, slice bigint")
        inside = sized.select("key", "size", F.shiftright("h", before_bits).alias("slice"), F.shiftright("h", bits).alias("bin"))
        wanted = inside.join(F.broadcast(at.select("key", "slice").distinct()), ["key", "slice"])
        bins = wanted.groupBy("key", "slice", "bin").agg(F.sum("size").alias("n"))
        run = bins.join(F.broadcast(at), ["key", "slice"]).withColumn(
            "upto", F.expr("sum(n) over (partition by cut order by bin)")
        )
        hit = run.where("upto - n <= words and words < upto").select("cut", "key", (F.col("words") - F.col("upto") + F.col("n")).alias("words"), "bin", "n")
        rows = hit.collect()
        if bits == 0:
            return {r.cut: r.bin + int(2 * r.words >= r.n) for r in rows}
        found, before_bits = [(r.cut, r.key, r.words, r.bin) for r in rows], bits
    return {}


def plan(sized: DataFrame, weights, share: float = 1.5, most: int = 2, max_patterns: int = 100_000) -> Mix:
    """Targets and cuts for ``sized(key, size, h)``, where key is the JSON array of a row's sources.

    ``weights`` maps the list of sources, by code point and null last, to their
    weights. The driver sees one row per membership pattern; more than
    ``max_patterns`` raise an error.
    """
    totals = sized.groupBy("key").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(json.loads(r.key)): r.n for r in totals}
    keys = {tuple(json.loads(r.key)): r.key for r in totals}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    budget = share * sum(patterns.values())
    wanted = fill_targets([sizes[s] for s in sources], weights(sources), budget, most) if sources else []
    targets = dict(zip(sources, wanted))
    given = route(patterns, {s: round(t) for s, t in targets.items()}, most)
    ends, cuts = [], []
    for p, parts in given.items():
        upto = 0
        for s, n in parts:
            upto += n
            whole, rest = divmod(upto, patterns[p])
            ends.append((keys[p], whole, rest, s))
            if rest:
                cuts.append((len(ends) - 1, keys[p], rest))
    bounds = _bounds(sized, cuts)
    rules: dict = defaultdict(list)
    for i, (key, whole, _, s) in enumerate(ends):
        rules[key].append((whole, bounds.get(i, 0), s))
    for p, n in patterns.items():
        if not n and any(targets.get(s, 0) >= 0 for s in p):
            rules[keys[p]] = [(1, 0, p[0])]  # a pattern without words: every row once
    return Mix(dict(sizes), targets, dict(rules))


def with_copies(rows: DataFrame, mix: Mix, most: int) -> DataFrame:
    """Adds ``copies``: the source that each taken copy of the row counts for, in order; empty if none is taken."""
    spark = rows.sparkSession
    listed = [(k, [(int(w), int(b), s) for w, b, s in cuts]) for k, cuts in mix.rules.items()]
    rules = spark.createDataFrame(listed, "key string, cuts array<struct<round:int, bound:bigint, source:string>>")

    def owner(k):
        mine = F.filter("cuts", lambda c: (c["round"] > k) | ((c["round"] == k) & (F.col("h") < c["bound"])))
        return F.when(F.size(mine) > 0, F.struct(F.get(mine, F.lit(0))["source"].alias("source")))

    owners = F.array(*[owner(k) for k in range(most)])
    found = F.coalesce(F.filter(owners, lambda x: x.isNotNull()), F.array().cast("array<struct<source:string>>"))
    # rules have a row per membership pattern, of which plan() allows a bounded number
    joined = rows.join(F.broadcast(rules), "key", "left")
    return joined.withColumn("copies", F.when(F.col("cuts").isNull(), F.array().cast("array<struct<source:string>>")).otherwise(found)).drop("cuts")


def sized_rows(docs: DataFrame, members: Column, seed: int, *keep) -> DataFrame:
    key = F.to_json(F.array_sort(F.array_distinct(members)))
    return docs.select(*keep, key.alias("key"), word_count().alias("size"), seeded("doc_id", seed).alias("h"))


def cycle_weights(cycle: tuple[float, ...]):
    return lambda sources: [cycle[i % len(cycle)] for i in range(len(sources))]


def mix_sources(docs: DataFrame, members: Column | None = None, weights=cycle_weights((3, 1, 2)), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats, copies) of every row of ``docs(doc_id, text, source)``.

    ``members`` is the array of a row's sources, by default its one ``source``.
    Rows are grouped by membership pattern, a min-cost flow routes the
    patterns' words to the sources' targets, and each pattern's rows are taken
    in a seeded order up to its cuts: whole rows, at most ``most`` times. A
    source's taken words differ from its share of the flow by at most half a
    row at each cut. ``source_size`` and ``target`` are those of the row's first
    source. Null text has size 0; a null source is a source of its own, last in
    order. More than 100,000 membership patterns raise an error. Rows that share a doc_id are taken together. Rows without words are
    taken with their hash like any other, and count nothing. An empty table
    gives an empty result.
    """
    members = F.array("source") if members is None else members
    sized = durable(sized_rows(docs, members, seed, F.col("doc_id")))
    mix = plan(sized, weights, share, most)
    named = [(json.dumps([s], ensure_ascii=False), s, int(mix.sizes[s]), float(t)) for s, t in mix.targets.items()]
    # a row per source, no more than patterns() allows
    sources = sized.sparkSession.createDataFrame(
        [(s, n, t) for _, s, n, t in named], "first_source string, source_size bigint, target double"
    )
    rows = with_copies(sized, mix, most).withColumn("first_source", F.get(F.from_json("key", "array<string>"), F.lit(0)))
    told = rows.join(F.broadcast(sources), rows.first_source.eqNullSafe(sources.first_source), "left")
    return told.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.size("copies") * F.col("size")).alias("taken"), F.size("copies").cast("bigint").alias("repeats"), "copies"
    )


OP8_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5('11:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as n, [3, 1, 2][(row_number() over (order by source nulls last) - 1)::int % 3 + 1] as w
  from sized group by source),
ranked as (
  select *, 2.0 * n / w as stop_at, 1.5 * sum(n) over () as budget, sum(w) over () as all_w,
         coalesce(sum(2 * n) over o, 0) as n_before, coalesce(sum(w) over o, 0) as w_before
  from sources
  window o as (order by 2.0 * n / w, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
  select min_by((budget - n_before) / (all_w - w_before), n_before) as rate
  from ranked where stop_at >= (budget - n_before) / (all_w - w_before)),
targets as (
  select source, n, case when rate is null or w * rate > 2 * n then 2.0 * n else w * rate end as target
  from ranked, level),
blocks as (
  select source, h, sum(size) as block, sum(sum(size)) over (partition by source order by h) as upto
  from sized group by source, h),
cut as (
  select t.*, case when n = 0 then 1 else least(round(target)::bigint, 2 * n) // n end as whole,
         case when n = 0 then 0 else least(round(target)::bigint, 2 * n) % n end as rest
  from targets t)
select s.doc_id, s.size::bigint as size, c.n as source_size, round(c.target::double, 6) as target,
       (s.size * (c.whole + case when c.rest > 0 and 2 * (b.upto - b.block) + b.block <= 2 * c.rest then 1 else 0 end))::bigint as taken
from sized s
join cut c on s.source is not distinct from c.source
join blocks b on s.source is not distinct from b.source and s.h = b.h
"""


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: int = 11, most: int = 2) -> DataFrame:
    """The documents of the mix: a row for each taken copy, with the columns of ``docs``.

    Other columns are carried along whatever their names. Null and empty texts
    count nothing and are taken by their hash; repeated rows are taken together;
    an empty table stays empty.
    """
    members = F.array("source")
    sized = durable(sized_rows(docs, members, seed))
    mix = plan(sized, cycle_weights((3, 1, 2)), most=most)
    # the row is carried whole, so no column of its own can meet one of the mix
    rows = docs.select(F.to_json(members).alias("key"), seeded("doc_id", seed).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = with_copies(rows, mix, most)
    return taken.select("row", F.explode("copies")).select("row.*")
