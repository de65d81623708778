"""A trie of the prefixes that conversations share, with totals of every subtree.

A node is named by the smallest conversation that starts with it and its depth,
so the nodes that one conversation names are the last part of its path: a chain.
Subtree totals come from a centroid decomposition. In a component every node
knows its subtree's size; the nodes with more than half the component stand in
one line from the top, and the last of them is the centroid. Its totals go to
that line, then the centroid leaves and its children's subtrees are components
of their own. Large components split in rounds of aggregates and joins; from a
bounded size on a task splits whole components by the same rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figcorpus.llm.common import durable, query, table
from figcorpus.operators.ranking import with_position

#: Turns of one conversation that are handled together.
BLOCK = 4096


def _block(depth: str) -> Column:
    return F.floor(F.col(depth) / F.lit(BLOCK)).cast("bigint")


def by_block(rows: DataFrame, convs: DataFrame, depth: str, longest: str) -> DataFrame:
    """Join the one row of each conversation to its ``rows``, a block of ``depth`` at a time.

    ``convs`` is repeated once per block up to ``longest``, so a conversation
    with many rows is spread over as many keys.
    """
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), _block(longest)))
    return rows.withColumn("__block", _block(depth)).join(convs.withColumn("__block", blocks), ["conv_id", "__block"]).drop("__block")


def shared_start(conv_id: str = "conv_id", most: int = 6) -> Column:
    """How many turns a conversation takes over from the first one of its hundred."""
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % F.lit(most)


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of all rebuilt conversations and (conv_id, depth, turn, chars, length) of their turns.

    Turns stand by turn number (null first), then role and text. A conversation
    begins with the first ``shared_start`` turns of the first one of its
    ``group`` ids, then its own follow after as many. ``turn`` is a 128-bit
    hash of role and text, null being empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    hashed = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    placed = with_position(rows, [F.col("turn").asc_nulls_first(), "role", "text"], ("conv_id",)).select(
        "conv_id", "position", F.unhex(hashed).alias("turn"), F.length("text").cast("bigint").alias("chars")
    )
    placed = durable(placed)
    ids = placed.groupBy("conv_id").agg(F.max("position").alias("n"))
    ids = ids.select("conv_id", "n", shared_start(most=most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    firsts = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = ids.join(firsts, "base", "left").select(
        "conv_id", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    convs = durable(convs)
    starts = placed.where(F.col("position") < most).select(F.col("conv_id").alias("base"), "position", "turn", "chars")
    over = convs.join(starts, "base").where("position <= taken").select("conv_id", F.col("position").alias("depth"), "turn", "chars", "length")
    own = by_block(placed, convs, "position", "n").where("position > h")
    own = own.select("conv_id", (F.col("taken") + F.col("position") - F.col("h")).alias("depth"), "turn", "chars", "length")
    return convs.select("conv_id", "length"), over.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the 128-bit names (k1, k2) of each turn's prefix and (b1, b2) of the one before it.

    A turn's place and content are hashed together, and a prefix is the exclusive
    or of its turns' hashes, which blocks of a long conversation compute apart.
    """
    rows = turns.withColumns({
        "f1": F.xxhash64("depth", "turn"), "f2": F.xxhash64("turn", "depth"), "__block": _block("depth"),
    })
    rows = durable(rows)
    blocks = rows.groupBy("conv_id", "__block").agg(F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"))
    earlier = W.partitionBy("conv_id").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(
        "conv_id", "__block",
        F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("x2"),
    )
    upto = W.partitionBy("conv_id", "__block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    named = rows.join(before, ["conv_id", "__block"]).withColumns({
        f"k{i}": F.bit_xor(f"f{i}").over(upto).bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)
    })
    befores = {f"b{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"f{i}")) for i in (1, 2)}
    return named.withColumns(befores).drop("__block", "x1", "x2", "f1", "f2", "turn")


def _joined(rows: DataFrame, nodes: DataFrame, keys: list[str], n_rows: int, how: str = "inner", share: int = 10_000) -> DataFrame:
    """Join ``nodes(keys, n_convs, ...)`` to rows, of which a node has at most ``n_convs``.

    Nodes with more than one ``share``-th of all rows, fewer than ``share`` of
    them, are broadcast; the others' rows are dealt by key.
    """
    often = F.col("n_convs") > F.lit(n_rows / share)
    hot = nodes.where(often).drop("n_convs")
    found = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    apart = found.where("__hot").drop("__hot")
    others = [c for c in hot.columns if c not in keys]
    rest = found.where("__hot is null").drop("__hot", *others).join(nodes.where(~often).drop("n_convs"), keys, how)
    return apart.unionByName(rest.select(apart.columns))


def grow(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes (j, d, parent, n_convs, chars) and every conversation's path (conv_id, depth, j, parent, length)."""
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("chars"), "length", *[zero.alias(x) for x in ("k1", "k2", "b1", "b2")])
    members = durable(prefixes(turns).unionByName(roots))
    n_rows = members.count()
    named = members.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("j"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("b1").alias("b1"), F.min("b2").alias("b2")
    )
    named = durable(named)
    above = named.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("j").alias("parent"), "n_convs")
    lower = named.where("depth > 0").withColumnRenamed("n_convs", "members")
    lower = _joined(lower, above, ["depth", "b1", "b2"], n_rows).withColumnRenamed("members", "n_convs")
    tops = named.where("depth = 0").withColumn("parent", F.lit(None).cast("bigint"))
    nodes = durable(lower.unionByName(tops))
    path = _joined(members.drop("b1", "b2", "chars"), nodes.select("depth", "k1", "k2", "j", "parent", "n_convs"), ["depth", "k1", "k2"], n_rows)
    return nodes.select("j", F.col("depth").alias("d"), "parent", "n_convs", "chars"), durable(path.drop("k1", "k2"))


def local_totals(parent: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (a row per node) for a forest, whose parents (-1 at tops) stand before their children.

    ``size`` is each node's number of nodes in its subtree. All components split
    once a round, at most log2 of the largest size rounds.
    """
    n = len(parent)
    top, place, free = np.arange(n), np.zeros(n, np.int64), [0] * n
    ahead, size = 0, size.copy()
    sizes, order = size.tolist(), np.empty(n, np.int64)
    for v, p in enumerate(parent.tolist()):  # places in preorder: a subtree's nodes follow each other
        if p < 0:
            at, ahead = ahead, ahead + sizes[v]
        else:
            at = free[p]
            free[p] += sizes[v]
            top[v] = top[p]
        free[v], order[at] = at + 1, v
        place[v] = at
    full, out = size.copy(), np.zeros_like(values)
    alive = order  # nodes of open components, in preorder
    while len(alive):
        line = alive[2 * size[alive] > size[top[alive]]]
        line = line[np.argsort(-size[line], kind="stable")]
        centroid = np.full(n, -1)
        centroid[top[line]] = line  # the smallest stands last
        c = centroid[top[alive]]
        under = (place[alive] > place[c]) & (place[alive] < place[c] + full[c])
        inside = alive[under | (alive == c)]
        totals = np.zeros_like(values)
        np.add.at(totals, top[inside], values[inside])
        out[line] += totals[top[line]]
        ends = centroid[top[line]]
        lost = size[ends]
        size[line[line != ends]] -= lost[line != ends]
        # a child of the centroid is the top of all that follows it, up to the next child
        below, c = alive[under], c[under]
        by_top = np.argsort(top[below], kind="stable")
        below, c = below[by_top], c[by_top]
        starts = np.maximum.accumulate(np.where(parent[below] == c, np.arange(len(below)), 0))
        top[below] = below[starts]
        alive = alive[~np.isin(alive, ends)]
    return out


def _whole_components(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[pa.Table]:
    """Runs of whole components, from batches sorted by component."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tj, td = np.asarray(batch.column("tj")), np.asarray(batch.column("td"))
        if held and sum(b.num_rows for b in held) >= at_least:
            last = held[-1]
            same = (tj == last.column("tj")[-1].as_py()) & (td == last.column("td")[-1].as_py())
            cut = len(same) if same.all() else int(np.argmin(same))
            held.append(batch.slice(0, cut))
            if cut < len(same):
                yield pa.Table.from_batches(held)
                held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_components(batches, 50_000):
        j, d, up, tj, td = (rows.column(c).to_pylist() for c in ("j", "d", "parent", "tj", "td"))
        at = {key: i for i, key in enumerate(zip(j, d))}
        parent = np.array([-1 if (a, b) == (x, y) else at[p, b - 1] for a, b, p, x, y in zip(j, d, up, tj, td)], np.int64)
        values = np.stack([rows.column("leaf").to_numpy(), rows.column("saved").to_numpy()], axis=1)
        found = local_totals(parent, rows.column("size").to_numpy(), values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(j, pa.int64()), pa.array(d, pa.int64()),
                pa.array(found[:, 0] + rows.column("got_leaf").to_numpy()), pa.array(found[:, 1] + rows.column("got_saved").to_numpy()),
            ],
            ["j", "d", "n_leaves", "saved_tokens"],
        )


def _split(open_: DataFrame, path: DataFrame) -> DataFrame:
    """Split every component at its centroid; the centroids themselves come back without a component (tj null)."""
    key = ["tj", "td"]
    sizes = F.broadcast(open_.groupBy(*key).agg(F.max("size").alias("total")))
    line = open_.join(sizes, key).where("2 * size > total")
    found = line.groupBy(*key).agg(F.min("total").alias("total"), F.min(F.struct("size", "j", "d")).alias("c"))
    found = durable(found.select(*key, "total", F.col("c.size").alias("cs"), F.col("c.j").alias("cj"), F.col("c.d").alias("cd")))
    cents = F.broadcast(found)  # components of more than limit nodes: fewer than nodes / limit
    rows = open_.join(cents, key).withColumn("e", F.col("cd") + 1).withColumn("block", _block("d"))
    # a node's forebear at the depth below the centroid: on its own chain, or on the path of the chain's conversation
    asked = rows.where("d >= e and o > e").select("j", "e", "block").distinct()
    told = asked.join(path.select(F.col("conv_id").alias("j"), F.col("depth").alias("e"), F.col("j").alias("xj"), F.col("parent").alias("xp")), ["j", "e"])
    rows = rows.join(told, ["j", "e", "block"], "left")
    x = F.when(F.col("o") <= F.col("e"), F.col("j")).otherwise(F.col("xj"))
    over = F.when(F.col("o") < F.col("e"), F.col("j")).when(F.col("o") == F.col("e"), F.col("head")).otherwise(F.col("xp"))
    is_c = (F.col("j") == F.col("cj")) & (F.col("d") == F.col("cd"))
    rows = durable(
        rows.withColumn("under", (F.col("d") >= F.col("e")) & F.coalesce(over == F.col("cj"), F.lit(False)))
        .withColumn("x", x)
        .withColumn("is_c", is_c)
        .drop("xj", "xp", "block")
    )
    below = rows.where("under or is_c").groupBy(*key).agg(F.sum("leaf").alias("add_leaf"), F.sum("saved").alias("add_saved"))
    rows = rows.join(F.broadcast(below), key)
    on_line = F.expr("2 * size > total")
    new = {
        "got_leaf": F.col("got_leaf") + F.when(on_line, F.col("add_leaf")).otherwise(0),
        "got_saved": F.col("got_saved") + F.when(on_line, F.col("add_saved")).otherwise(0),
        "size": F.when(on_line & ~F.col("is_c"), F.col("size") - F.col("cs")).otherwise(F.col("size")),
        "tj": F.when(F.col("is_c"), F.lit(None)).when(F.col("under"), F.col("x")).otherwise(F.col("tj")),
        "td": F.when(F.col("is_c"), F.lit(None)).when(F.col("under"), F.col("e")).otherwise(F.col("td")),
    }
    return rows.withColumns(new).select(*open_.columns)


def subtree_totals(nodes: DataFrame, path: DataFrame, limit: int | None = None) -> DataFrame:
    """(j, d, n_leaves, saved_tokens) of every node of ``nodes(j, d, parent, leaf, saved)``, over its subtree.

    ``path`` tells where a node's forebears are. A subtree's size is a sum over
    its conversations of the nodes that each names below the top. ``limit`` is the size from which
    one task takes whole components: by default 50,000, or a
    hundred-thousandth of all nodes, so a round has at most 100,000 components.
    """
    spark = nodes.sparkSession
    chains = path.where("j = conv_id").groupBy("conv_id").agg(F.min("depth").alias("o"), F.max("depth").alias("l"), F.min_by("parent", "depth").alias("head"))
    named = by_block(path.select("conv_id", "depth", "j"), chains, "depth", "l")
    # of those that name none, and of shorter chains, nothing is added
    sizes = named.groupBy("j", F.col("depth").alias("d")).agg(F.sum(F.col("l") - F.greatest("depth", "o") + 1).alias("size"))
    own = by_block(path.where("j = conv_id").select("conv_id", "depth"), chains, "depth", "l")
    own = own.select(F.col("conv_id").alias("j"), F.col("depth").alias("d"), "o", "head")
    top = nodes.where("d = 0").select(F.col("j").alias("tj"), F.col("d").alias("td"))
    zero = F.lit(0).cast("bigint")
    rows = nodes.join(own, ["j", "d"]).join(sizes, ["j", "d"]).join(F.broadcast(top))  # one row: the root
    rows = durable(rows.withColumns({"got_leaf": zero, "got_saved": zero}))
    if limit is None:
        limit = max(50_000, rows.count() // 100_000)
    small, done = [], []
    while True:
        sizes = rows.groupBy("tj", "td").agg(F.max("size").alias("__total"))
        large = durable(sizes.where(F.col("__total") > limit)).drop("__total")
        if large.isEmpty():
            small.append(rows)
            break
        large = F.broadcast(large)  # fewer than nodes / limit
        small.append(rows.join(large, ["tj", "td"], "left_anti"))
        split = durable(_split(rows.join(large, ["tj", "td"]).select(*rows.columns), path))
        done.append(split.where("tj is null").select("j", "d", F.col("got_leaf").alias("n_leaves"), F.col("got_saved").alias("saved_tokens")))
        rows = split.where("tj is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["tj", "td", "j", "d", "parent", "size", "leaf", "saved", "got_leaf", "got_saved"]
    rest = reduce(DataFrame.unionByName, [s.select(*columns) for s in small])
    dealt = rest.repartition(n, "tj", "td").sortWithinPartitions("tj", "td", "d")
    found = dealt.mapInArrow(_finish, "j bigint, d bigint, n_leaves bigint, saved_tokens bigint")
    return reduce(DataFrame.unionByName, [found, *done])


def _runs(batch: pa.RecordBatch):
    """(j, d, start, end) of the rows of one node after another."""
    j, d = np.asarray(batch.column("j")), np.asarray(batch.column("d"))
    edges = np.flatnonzero((np.diff(j) != 0) | (np.diff(d) != 0)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(j)]):
        if hi > lo:
            yield int(j[lo]), int(d[lo]), lo, hi


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node to comma-joined pieces, in which the ids of one batch stand together."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        rows = [(j, d, ids[lo], ",".join(map(str, ids[lo:hi]))) for j, d, lo, hi in _runs(batch)]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["j", "d", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the hash of each node's whole list, holding one piece at a time."""
    node, state = None, None
    out: list[tuple] = []

    def told():
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["j", "d", "ends_sha256"])

    for batch in batches:
        pieces = batch.column("ids")
        for j, d, lo, hi in _runs(batch):
            if (j, d) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (j, d), hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(pieces.slice(lo, hi - lo).to_pylist()).encode())
        if out:
            yield told()
            out = []
    if node:
        out.append((*node, state.hexdigest()))
        yield told()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(j, d, ends_sha256) of ``ends(j, d, conv_id)``: SHA-256 of each node's ids, ascending and comma-joined.

    One hash runs over one node's ids in order. Tasks write the ids into
    pieces first, each up to an Arrow batch of one node, so a node's hasher sees
    few rows and holds one at a time.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = ends.repartitionByRange(n, "j", "d", "conv_id").sortWithinPartitions("j", "d", "conv_id")
    pieces = sorted_.mapInArrow(_written, "j bigint, d bigint, first bigint, ids string")
    return pieces.repartition(n, "j", "d").sortWithinPartitions("j", "d", "first").mapInArrow(_hashed, "j bigint, d bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, group: int = 100, most: int = 6, limit: int | None = None) -> DataFrame:
    """A row per node of the trie of the rebuilt ``turns(conv_id, turn, role, text)``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    Null role or text is empty, a null turn comes first, and equal turn numbers
    stand by role and text. Repeated rows are turns of their own. Rows without conv_id belong to no
    conversation and are left out. A conversation of which no turn is left is a
    member of the root. Without conversations there is no root and no row.
    Other columns are not looked at.
    """
    convs, rows = rebuilt(turns, group, most)
    nodes, path = grow(convs, rows)
    below = nodes.where("d > 0").groupBy(F.col("parent").alias("j"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, ["j", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    leaf = (F.col("n_children") == 0).cast("bigint")
    nodes = durable(nodes.withColumns({"leaf": leaf, "saved": (F.col("n_convs") - 1) * F.col("chars")}))
    totals = subtree_totals(nodes.select("j", "d", "parent", "leaf", "saved"), path, limit)
    ends = end_hashes(path.where("depth = length").select("j", F.col("depth").alias("d"), "conv_id"))
    whole = nodes.join(totals, ["j", "d"]).join(ends, ["j", "d"], "left")
    return whole.select(
        F.col("j").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


OP13_SQL = r"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
convs as (
  select conv_id, count(*) as n, conv_id - conv_id % 100 as base,
    xor(4294967295, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: unicode(x)::ubigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, i: xor(c >> 1, 3988292384::ubigint * (c & 1))))) % 6 as h
  from own group by conv_id),
sized as (
  select c.*, least(c.h, coalesce(b.n, 0)) as taken from convs c left join convs b on b.conv_id = c.base),
turns as (
  select c.conv_id, o.pos as depth, o.role, o.text from sized c join own o on o.conv_id = c.base and o.pos <= c.taken
  union all
  select c.conv_id, c.taken + o.pos - c.h, o.role, o.text from sized c join own o on o.conv_id = c.conv_id and o.pos > c.h),
paths as (
  select conv_id, depth, length(text) as chars,
    md5(string_agg(md5(role) || md5(text), '' ) over (partition by conv_id order by depth)) as node from turns
  union all select conv_id, 0, 0, '' from convs),
linked as (
  select *, lag(node) over (partition by conv_id order by depth) as above,
    lead(depth) over (partition by conv_id order by depth) is null as is_end from paths),
nodes as (
  select depth, node, min(above) as above, min(conv_id) as conv_id, count(*) as n_convs, min(chars) as chars,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends_sha256
  from linked group by depth, node),
wide as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = n.depth + 1 and k.above = n.node) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.node = n.above),
under as (
  select distinct a.depth, a.node, b.depth as below, b.node as lower
  from paths a join paths b on a.conv_id = b.conv_id and b.depth >= a.depth),
summed as (
  select u.depth, u.node, sum((w.n_children = 0)::int) as n_leaves, sum((w.n_convs - 1) * w.chars) as saved
  from under u join wide w on w.depth = u.below and w.node = u.lower group by u.depth, u.node)
select w.conv_id, w.depth::bigint as depth, w.parent_conv_id, w.n_convs::bigint as n_convs, w.n_children::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, w.ends_sha256
from wide w join summed s on s.depth = w.depth and s.node = w.node
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
