"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue, then exact distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figcorpus.llm.common import durable, per_batch, query, table


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` and ``sample_floats`` bound the vectors the trees are grown on.

    A tree is split until a leaf stands for about ``leaf_rows`` rows of the
    table, or for two of the sample. The leaves' number is bounded by the
    sample, so for tables of more than some thousand times its size raise it as
    well. ``block_rows`` bounds the rows of a leaf that meet in one group. How
    many rows a query looks through is measured: ``trials`` vectors are searched
    by brute force, and the effort is what finds the share ``recall`` of their
    neighbours.
    """

    trees: int = 16
    leaf_rows: int = 256
    recall: float = 0.95
    trials: int = 200
    sample_rows: int = 50_000
    sample_floats: int = 8_000_000
    block_rows: int = 20_000
    seed: int = 3


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: a row goes to ``right`` where normal . x > cut; a leaf has ``left`` -1 and its number in ``right``."""

    normal: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split at the hyperplane between two random rows of a node, at the median of its rows' projections."""
    normals, cuts, left, right, rows = [], [], [], [], []
    leaves = 0
    todo = [(np.arange(len(sample)), -1, False)]
    while todo:
        at, parent, is_right = todo.pop()
        me = len(cuts)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        side, normal, cut = None, np.zeros(sample.shape[1], np.float32), 0.0
        if len(at) > leaf:
            for _ in range(4):
                a, b = sample[rng.choice(at, 2, replace=False)]
                normal = (a - b).astype(np.float32)
                norm = float(np.linalg.norm(normal))
                if not norm or not np.isfinite(norm):
                    continue
                normal /= norm
                along = sample[at] @ normal
                cut = float(np.median(along))
                side = along > cut
                if 0 < side.sum() < len(at):
                    break
                side = None
        normals.append(normal)
        cuts.append(cut)
        rows.append(len(at))
        if side is None:
            left.append(-1)
            right.append(leaves)
            leaves += 1
        else:
            left.append(0)
            right.append(0)
            todo += [(at[~side], me, False), (at[side], me, True)]
    return Tree(np.array(normals, np.float32), np.array(cuts, np.float32), np.array(left), np.array(right), np.array(rows))


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(tree.left[at] >= 0)
    while len(open_):
        node = at[open_]
        along = np.einsum("ij,ij->i", x[open_], tree.normal[node])
        at[open_] = np.where(along > tree.cut[node], tree.right[node], tree.left[node])
        open_ = open_[tree.left[at[open_]] >= 0]
    return tree.right[at]


def visiting(forest: list[Tree], x: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(tree, leaf, sample rows seen with it) for a query, most promising leaf first.

    One queue for all trees: a branch's priority is the largest margin by
    which the query missed it on the way.
    """
    queue = [(0.0, t, 0) for t in range(len(forest))]
    heapq.heapify(queue)
    seen = 0.0
    while queue:
        priority, t, node = heapq.heappop(queue)
        tree = forest[t]
        while tree.left[node] >= 0:
            margin = float(x @ tree.normal[node] - tree.cut[node])
            near, far = (tree.right[node], tree.left[node]) if margin > 0 else (tree.left[node], tree.right[node])
            heapq.heappush(queue, (max(priority, abs(margin)), t, int(far)))
            node = near
        seen += float(tree.rows[node])
        yield t, int(tree.right[node]), seen


def probe(forest: list[Tree], x: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs for a query until they hold ``enough`` sample rows."""
    found = []
    for t, leaf, seen in visiting(forest, x):
        found.append((t, leaf))
        if seen >= enough:
            break
    return found


def effort(forest: list[Tree], trials: list[tuple[np.ndarray, np.ndarray]], recall: float) -> float:
    """Sample rows to look through so that the share ``recall`` of the trials' neighbours is met.

    ``trials`` are queries with the vectors of their true neighbours.
    """
    needed = []
    for x, near in trials:
        wanted = np.array([leaves_of(t, near) for t in forest])
        open_ = np.ones(len(near), bool)
        for t, leaf, seen in visiting(forest, x):
            met = open_ & (wanted[t] == leaf)
            needed += [seen] * int(met.sum())
            open_ &= ~met
            if not open_.any():
                break
    if not needed:
        return np.inf
    return float(np.quantile(needed, recall, method="higher"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32, copy=False)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that take part: no null or non-finite component, not all zero, of the most frequent length."""
    fine = vectors.where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    top = fine.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = top[0].dim if top else 0
    return fine.where(F.size("embedding") == dim).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))


def build_forest(folded: DataFrame, n: int, settings: Settings) -> list[Tree]:
    """Grow the trees on a bounded sample of the distinct vectors, taken by a hash of their smallest id."""
    first = folded.select("rep", "embedding").orderBy(F.xxhash64("rep", F.lit(settings.seed)), "rep")
    dim = len(folded.select("embedding").first()[0])
    size = max(2, min(settings.sample_rows, settings.sample_floats // dim))
    rows = first.limit(size).toArrow().column("embedding").combine_chunks()
    sample = _matrix(rows, dim)
    leaf = max(2, round(settings.leaf_rows * len(sample) / n))
    return [grow(sample, leaf, np.random.default_rng([settings.seed, t])) for t in range(settings.trees)]


def trial_searches(folded: DataFrame, k: int, dim: int, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """A bounded number of vectors and the vectors of their ``k`` nearest, by brute force over all rows.

    Each batch is measured against all trials at once and sends its best ``k``.
    """
    picked = folded.select("vid", "embedding").orderBy(F.xxhash64("rep", F.lit(settings.seed + 1)), "rep").limit(settings.trials).toArrow()
    who = picked.column("vid").to_numpy()
    x = _matrix(picked.column("embedding").combine_chunks(), dim).astype(np.float64)
    shared = folded.sparkSession.sparkContext.broadcast((who, x))  # ``trials`` vectors

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        who, x = shared.value
        rows = _matrix(batch.column(1), dim).astype(np.float64)
        vid = batch.column(0).to_numpy(zero_copy_only=False)
        far = (x**2).sum(1)[:, None] - 2 * x @ rows.T + (rows**2).sum(1)
        far[who[:, None] == vid] = np.inf
        best = np.argsort(far, axis=1, kind="stable")[:, :k]
        rank = np.take_along_axis(far, best, 1).ravel()
        fine = np.isfinite(rank)
        trial = np.repeat(np.arange(len(who)), best.shape[1])[fine]
        near = batch.column(1).take(pa.array(best.ravel()[fine]))
        return pa.RecordBatch.from_arrays([pa.array(trial), pa.array(rank[fine]), near], ["trial", "far", "embedding"])

    found = folded.select("vid", "embedding").mapInArrow(per_batch(run), "trial bigint, far double, embedding array<float>")
    order = F.row_number().over(W.partitionBy("trial").orderBy("far"))
    near = found.withColumn("place", order).where(F.col("place") <= k).select("trial", "embedding").toArrow()
    if not near.num_rows:
        return []
    trial, vectors = near.column("trial").to_numpy(), _matrix(near.column("embedding").combine_chunks(), dim)
    return [(x[i].astype(np.float32), vectors[trial == i]) for i in range(len(who)) if (trial == i).any()]


def search(vectors: DataFrame, is_query, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row that ``is_query`` (a Column) picks.

    ``vectors(vec_id, embedding)``; candidates are all rows that take part
    (:func:`usable`) but the query's own; score is the Euclidean distance in
    double precision, ties go to the smaller vec_id, and with fewer than ``k``
    candidates all are returned. Equal vectors are folded first: a vector keeps
    the ``k`` + 1 smallest ids, more can never be among the nearest, and is
    searched once however many queries have it. Rows that share a vec_id are
    one row per distinct vector. Every row is indexed in every tree; the
    candidates of the leaves that a query visits are measured exactly.
    """
    spark = vectors.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors)
    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    kept = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    folded = durable(kept.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    # two vectors can share their smallest id, so a vector goes by its own number
    folded = durable(folded.withColumn("vid", F.monotonically_increasing_id()))
    n = folded.count()
    if not n:
        return spark.createDataFrame([], empty)
    forest = build_forest(folded, n, settings)
    dim = forest[0].normal.shape[1]
    shared = spark.sparkContext.broadcast(forest)  # trees over the bounded sample: at most as large as it
    most_leaves = max(int((t.left < 0).sum()) for t in forest)
    blocks = max(1, -(-n // (most_leaves * settings.block_rows)))
    enough = effort(forest, trial_searches(folded, k, dim, settings), settings.recall)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(1), dim)
        vid = batch.column(0).to_numpy(zero_copy_only=False)
        slot = np.concatenate([(leaves_of(t, x) + i * most_leaves) * blocks + vid % blocks for i, t in enumerate(shared.value)])
        again = pa.array(np.tile(np.arange(len(x)), len(shared.value)))
        return pa.RecordBatch.from_arrays([pa.array(slot), *[c.take(again) for c in batch.columns]], ["slot", "vid", "embedding", "ids"])

    index = folded.select("vid", "embedding", "ids").mapInArrow(
        per_batch(assign), "slot bigint, vid bigint, embedding array<float>, ids array<bigint>"
    )
    asked = rows.where(is_query).join(folded.select("embedding", "vid"), "embedding").select(F.col("vec_id").alias("query_id"), "vid").distinct()
    asked = durable(asked)
    queries = folded.join(asked.select("vid").distinct(), "vid").select("vid", "embedding")

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(1), dim)
        slots, who = [], []
        for i in range(len(x)):
            for t, leaf in probe(shared.value, x[i], enough):
                slots += [(leaf + t * most_leaves) * blocks + b for b in range(blocks)]
                who += [i] * blocks
        who = pa.array(who, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *[c.take(who) for c in batch.columns]], ["slot", "vid", "embedding"])

    visits = queries.mapInArrow(per_batch(visit), "slot bigint, vid bigint, embedding array<float>")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["q", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        x = _matrix(left.column("embedding").combine_chunks(), dim).astype(np.float64)
        ids = left.column("ids").to_pylist()
        least = left.column("ids").combine_chunks()
        first = least.flatten().to_numpy(zero_copy_only=False)[np.r_[0, np.cumsum(least.value_lengths().to_numpy(zero_copy_only=False))[:-1]]]
        out = []
        for q, v in zip(right.column("vid").to_pylist(), _matrix(right.column("embedding").combine_chunks(), dim).astype(np.float64)):
            d = np.sqrt(((x - v) ** 2).sum(1))
            top = np.lexsort((first, d))[: k + 1]
            near = sorted((float(d[i]), c) for i in top for c in ids[i])[: k + 1]
            out += [(q, c, s) for s, c in near]
        q, c, s = zip(*out)
        return pa.table([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names)

    near = index.groupBy("slot").cogroup(visits.groupBy("slot")).applyInArrow(measure, "q bigint, vec_id bigint, score double")
    # a vector is found in several trees at the same distance
    once = near.groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    best = once.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    told = asked.join(best.drop("place"), asked.vid == best.q).where("query_id != vec_id")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
