"""Near-duplicate pairs of vectors and signatures, and what to delete.

Every listed pair is checked exactly. Signatures and grid cells miss none; projection
bands find each pair with a chosen probability, and their work grows with the table
instead of its square. Identical rows are folded into the one with the smallest id first, so a group of copies costs one row in the pair join and is listed as links to
that row rather than as all its pairs.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import vectors as vec
from figcorpus.session import durable


def fold_copies(df: DataFrame, id_col: str, value: str, derived: dict[str, Column] | None = None):
    """(one row per distinct value with its smallest id, links from that id to the other copies).

    The smallest id is found with a map-side aggregate and written once with what is
    ``derived`` from the value. Only values with copies are joined back; that side holds
    one row per value, so a hot value is split by the skew join without repeats.
    """
    folded = df.groupBy(value).agg(F.min(id_col).alias("rep"), F.count("*").alias("_n"))
    reps = durable(folded.withColumns(derived or {}))
    copied = reps.where("_n > 1").drop("_n")
    links = df.join(copied, value).where(F.col(id_col) != F.col("rep")).withColumnRenamed(id_col, "copy")
    return reps.drop("_n"), links


# ---- cosine ----------------------------------------------------------------------------


def _cells(unit: Column, dims: list[int], width: float) -> list[Column]:
    return [F.floor(F.get(unit, F.lit(d)) / width) for d in dims]


def _spread_dims(units: DataFrame, n: int) -> list[int]:
    """The ``n`` components with the largest variance."""
    spread = units.select(F.posexplode("u").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("v"))
    return [r["d"] for r in spread.orderBy(F.desc("v"), "d").limit(n).collect()]


def _meetings(own: DataFrame, cells: list[str], offsets: list[tuple[int, ...]], tile: int) -> DataFrame:
    """Per cell with rows of its own: the tiles of its left rows (``_lts``) and of all rows that come to it as right ones (``_rts``)."""
    n = own.groupBy(*cells).agg(F.count("*").alias("_n"))
    coming = _moved(n, cells, offsets).groupBy(*cells).agg(F.sum("_n").alias("_m"))
    tiles = [F.ceil(F.col(c) / tile).cast("int").alias(t) for c, t in (("_n", "_lts"), ("_m", "_rts"))]
    return n.join(coming, cells).select(*cells, *tiles)


def _moved(rows: DataFrame, cells: list[str], offsets: list[tuple[int, ...]]) -> DataFrame:
    """Each row once per offset, filed in the cell that lies there; ``_home`` marks its own cell."""
    steps = F.array(*[F.array(*[F.lit(x) for x in o]) for o in offsets])
    out = rows.withColumn("_step", F.explode(steps)).withColumn("_home", F.forall("_step", lambda x: x == 0))
    return out.withColumns({c: F.col(c) + F.col("_step")[k] for k, c in enumerate(cells)}).drop("_step")


def _tile_products(threshold: float, semi: bool):
    """Products of one tile of left and one of right vectors, as a matrix."""

    def run(rows: pa.Table) -> pa.Table:
        side = rows["_side"].to_numpy()
        ids = rows["rep"].to_numpy()
        home = rows["_home"].to_numpy()
        flat = rows["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        u = flat.reshape(len(ids), -1)
        left, right = side == 0, side == 1
        i, j = ids[left], ids[right]
        score = u[left] @ u[right].T
        # rows of one cell stand on both sides and meet twice, rows of two cells once
        hit = (score >= threshold) & (~home[right][None, :] | (i[:, None] < j[None, :]))
        a, b = np.nonzero(hit)
        score, a, b = score[a, b], i[a], j[b]
        lower, upper = np.where(a < b, a, b), np.where(a < b, b, a)
        kind = rows.schema.field("rep").type
        if semi:
            return pa.table({"id": pa.array(np.unique(upper), kind)})
        return pa.table({"i": pa.array(lower, kind), "j": pa.array(upper, kind), "similarity": score})

    return run


def similar_units(
    units: DataFrame, threshold: float, grid_dims: int = 2, tile: int = 2048, how: str = "inner"
) -> DataFrame:
    """Pairs rep_i < rep_j of unit vectors with cosine >= threshold.

    cosine >= t means the vectors lie at most r = sqrt(2 - 2t) apart, so every component
    differs by at most r. Vectors are filed in grid cells of width r over their widest
    components; the right side goes to its own cell and to half of the adjacent ones, so
    two cells meet once and no pair is missed. Both sides are counted where they meet and
    cut into tiles by a hash of the id, every left tile meeting every right tile in a
    group of its own: whatever the cells look like, a group holds about two tiles. Cells
    without a left row are left out. Each meeting is one matrix product; only matching
    pairs leave it. ``left_semi`` keeps the right ids with some partner and lists no pairs.
    """
    r = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    grid = _spread_dims(units, grid_dims)
    kind = units.schema["rep"].dataType.simpleString()
    semi = how == "left_semi"
    out = f"id {kind}" if semi else f"i {kind}, j {kind}, similarity double"
    if not grid:
        return units.sparkSession.createDataFrame([], out)
    met = meeting_rows(units, grid, r, tile).groupBy(*_names(grid), "_lt", "_rt").applyInArrow(_tile_products(threshold, semi), out)
    return met.distinct() if semi else met


def _names(grid: list[int]) -> list[str]:
    return [f"_c{k}" for k in range(len(grid))]


def meeting_rows(units: DataFrame, grid: list[int], r: float, tile: int) -> DataFrame:
    """The rows (rep, u, side) of every meeting (cells, _lt, _rt) of a left and a right tile."""
    names = _names(grid)
    own = units.withColumns(dict(zip(names, _cells(F.col("u"), grid, r))))
    offsets = [o for o in product((-1, 0, 1), repeat=len(grid)) if o >= (0,) * len(grid)]
    meetings = _meetings(own, names, offsets, tile)

    def tiled(rows, side):
        """Rows of one side: their own tile, repeated for every tile of the other side."""
        mine, theirs = ("_lts", "_rts") if side == 0 else ("_rts", "_lts")
        at = F.pmod(F.xxhash64("rep"), F.col(mine)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        pair = (at.alias("_lt"), every.alias("_rt")) if side == 0 else (every.alias("_lt"), at.alias("_rt"))
        return rows.join(meetings, names).select("rep", "u", *names, F.lit(side).alias("_side"), "_home", *pair)

    return tiled(own.withColumn("_home", F.lit(True)), 0).unionByName(tiled(_moved(own, names, offsets), 1))


def band_layout(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(sign bits of a band, bands) for ``n`` vectors.

    A band has so many bits that evenly spread vectors fill its buckets with about
    ``bucket`` of them, and there are so many bands that a pair at the threshold shares
    one with probability ``recall``. A bit differs with probability angle / pi.
    """
    bits = max(1, min(62, math.ceil(math.log2(max(2.0, n / bucket)))))
    same = min(1 - 1e-12, (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits)
    return bits, max(1, math.ceil(math.log(max(1e-300, 1 - recall)) / math.log1p(-same)))


def _signs(bits: int, bands: int, seed: int):
    """Adds ``keys``: in each band the signs of a vector's projections on seeded random directions, as one number."""

    def run(batches):
        planes = None
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(u.shape[1], bits * bands))
            keys = ((u @ planes >= 0).reshape(-1, bits) @ weights).astype(np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands), pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("u"), rows], ["rep", "u", "keys"])

    return run


def _bucket_products(threshold: float, semi: bool):
    """Similar pairs of one bucket (side 2: all its rows) or of a left and a right tile of it (0 and 1).

    A pair counts in the first band that it shares.
    """

    def run(rows: pa.Table) -> pa.Table:
        side, band = rows["_side"].to_numpy(), rows["_band"][0].as_py()
        ids = rows["rep"].to_numpy()
        u, keys = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c in ("u", "keys"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        a, b = np.nonzero((u[left] @ u[right].T >= threshold) & (ids[left][:, None] < ids[right][None, :]))
        a, b = left[a], right[b]
        first = (keys[a] == keys[b]).argmax(axis=1) == band
        a, b = a[first], b[first]
        kind = rows.schema.field("rep").type
        if semi:
            return pa.table({"id": pa.array(np.unique(ids[b]), kind)})
        return pa.table({"i": pa.array(ids[a], kind), "j": pa.array(ids[b], kind), "similarity": np.einsum("ij,ij->i", u[a], u[b])})

    return run


def bucket_rows(units: DataFrame, bits: int, bands: int, tile: int = 2048, seed: int = 7) -> DataFrame:
    """The rows (rep, u, keys, _band, _key, _lt, _rt, _side) of every bucket of two vectors or more.

    A vector is in one bucket of each band. Buckets are counted first: a bucket up to
    ``tile`` rows is one group with each row once; a larger one is cut by a hash of the id,
    its left tiles meeting its right tiles.
    """
    kind = units.schema["rep"].dataType.simpleString()
    signed = units.select("rep", "u").mapInArrow(_signs(bits, bands, seed), f"rep {kind}, u array<double>, keys array<bigint>")
    filed = signed.select("rep", "u", "keys", F.posexplode("keys").alias("_band", "_key"))
    tiles = filed.groupBy("_band", "_key").agg(F.count("*").alias("_n")).where("_n > 1")
    tiles = tiles.select("_band", "_key", F.ceil(F.col("_n") / tile).cast("int").alias("_tiles"))
    met = filed.join(tiles, ["_band", "_key"])
    mine, every = F.pmod(F.xxhash64("rep"), F.col("_tiles")).cast("int"), F.sequence(F.lit(0), F.col("_tiles") - 1)

    def placed(side: int, lt, rt):
        return F.struct(F.lit(side).alias("_side"), lt.alias("_lt"), rt.alias("_rt"))

    zero = F.lit(0)
    both = F.concat(F.transform(every, lambda t: placed(0, mine, t)), F.transform(every, lambda t: placed(1, t, mine)))
    places = F.when(F.col("_tiles") == 1, F.array(placed(2, zero, zero))).otherwise(both)
    return met.withColumn("_place", F.explode(places)).select("rep", "u", "keys", "_band", "_key", "_place.*")


def similar_by_bands(
    units: DataFrame, threshold: float, recall: float = 0.9999, bucket: int = 64, tile: int = 2048, how: str = "inner", seed: int = 7
) -> DataFrame:
    """Pairs rep_i < rep_j of unit vectors with cosine >= threshold that share a band of projection signs.

    Each true pair is found with at least the probability ``recall``, each listed pair is
    checked on the vectors, and each counts once. The number of buckets grows with the
    table, so a vector meets about ``bucket`` others in each band. ``left_semi``
    keeps the right ids with some partner.
    """
    semi = how == "left_semi"
    kind = units.schema["rep"].dataType.simpleString()
    bits, bands = band_layout(units.count(), threshold, recall, bucket)
    out = f"id {kind}" if semi else f"i {kind}, j {kind}, similarity double"
    groups = bucket_rows(units, bits, bands, tile, seed).groupBy("_band", "_key", "_lt", "_rt")
    met = groups.applyInArrow(_bucket_products(threshold, semi), out)
    return met.distinct() if semi else met


def _unit_reps(df: DataFrame, id_col: str, vector: str):
    folded, links = fold_copies(df.select(id_col, vector), id_col, vector, {"u": vec.unit(vector)})
    # zero vectors have no unit vector and are similar to nothing
    known = "u IS NOT NULL"
    return folded.select("rep", "u").where(known), links.where(known).select("rep", "copy")


def _similar(units: DataFrame, threshold: float, recall: float | None, how: str = "inner") -> DataFrame:
    return similar_units(units, threshold, how=how) if recall is None else similar_by_bands(units, threshold, recall, how=how)


def similar_pairs_cosine(df: DataFrame, id_col: str, vector: str, threshold: float = 0.98, recall: float | None = 0.9999) -> DataFrame:
    """(left_id, right_id, similarity): pairs of distinct vectors, and one link per copy.

    ``recall`` is the probability with which a pair at the threshold is found by
    projection bands; closer ones are found more surely. None takes grid cells, which
    miss none and cost the square of what a crowded cell holds.
    """
    units, links = _unit_reps(df, id_col, vector)
    pairs = _similar(units, threshold, recall).select(
        F.col("i").alias("left_id"), F.col("j").alias("right_id"), "similarity"
    )
    return pairs.unionByName(
        links.select(F.col("rep").alias("left_id"), F.col("copy").alias("right_id"), F.lit(1.0).alias("similarity"))
    )


def cosine_delete_set(df: DataFrame, id_col: str, vector: str, threshold: float = 0.98, recall: float | None = 0.9999) -> DataFrame:
    """Ids that are the right member of some pair, without listing the pairs.

    A copy always is; a vector's smallest id is if some smaller id is close, which is
    decided among the smallest ids.
    """
    units, links = _unit_reps(df, id_col, vector)
    close = _similar(units, threshold, recall, how="left_semi")
    return close.select("id").unionByName(links.select(F.col("copy").alias("id")))


# ---- Hamming -----------------------------------------------------------------------------


def _bands(bands: int) -> list[tuple[int, int]]:
    """(first bit, width) of each band of a 64-bit signature."""
    edges = [round(64 * b / bands) for b in range(bands + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _band(sig: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(sig, lo).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, errors: int) -> list[int]:
    """All masks with up to ``errors`` bits set: what a band may differ by."""
    masks = [0]
    layer = [(0, -1)]
    for _ in range(errors):
        layer = [(m | 1 << b, b) for m, last in layer for b in range(last + 1, width)]
        masks += [m for m, _ in layer]
    return masks


def similar_signatures(reps: DataFrame, max_distance: int = 5, bands: int = 3, how: str = "inner") -> DataFrame:
    """Pairs rep_i < rep_j of signatures that differ in at most ``max_distance`` bits.

    With d errors over m bands some band has at most floor(d / m) of them. The left side
    is filed under its band values, the right side looks up every value that few bits away:
    an equi-join that misses nothing. More bands mean fewer look-ups but shorter, more
    crowded keys; 3 bands of 21 bits suit large tables. A pair counts in the first band
    where it meets, so no later duplicate removal is needed.
    """
    errors = max_distance // bands
    layout = _bands(bands)
    sides = F.array(
        *[F.struct(F.lit(k).alias("band"), _band(F.col("sig"), lo, w).alias("value")) for k, (lo, w) in enumerate(layout)]
    )
    def probe(k, lo, width):
        value = _band(F.col("sig"), lo, width)
        masks = F.array(*[F.lit(m).cast("bigint") for m in _flips(width, errors)])
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("band"), value.bitwiseXOR(m).alias("value")))

    probes = F.flatten(F.array(*[probe(k, lo, w) for k, (lo, w) in enumerate(layout)]))
    left = reps.select(F.col("rep").alias("i"), F.col("sig").alias("si"), F.explode(sides).alias("l"))
    right = reps.select(F.col("rep").alias("j"), F.col("sig").alias("sj"), F.explode(probes).alias("r"))
    distance = F.bit_count(F.col("si").bitwiseXOR(F.col("sj")))
    cond = (
        (F.col("l.band") == F.col("r.band"))
        & (F.col("l.value") == F.col("r.value"))
        & (F.col("i") < F.col("j"))
        & (distance <= max_distance)
    )
    if how == "left_semi":
        return right.join(left, cond, "left_semi").select(F.col("j").alias("id")).distinct()
    diff = F.col("si").bitwiseXOR(F.col("sj"))
    first_band = F.array_position(
        F.array(*[F.bit_count(_band(diff, lo, w)) <= errors for lo, w in layout]), True
    )
    return left.join(right, cond).where(first_band == F.col("l.band") + 1).select("i", "j", distance.alias("distance"))


def similar_pairs_hamming(
    df: DataFrame, id_col: str, signature: str, max_distance: int = 5, bands: int = 3
) -> DataFrame:
    """(left_id, right_id, distance): pairs of distinct signatures, and one link per copy."""
    reps, links = fold_copies(df.select(id_col, F.col(signature).alias("sig")), id_col, "sig")
    pairs = similar_signatures(reps, max_distance, bands).select(
        F.col("i").alias("left_id"), F.col("j").alias("right_id"), "distance"
    )
    return pairs.unionByName(
        links.select(F.col("rep").alias("left_id"), F.col("copy").alias("right_id"), F.lit(0).alias("distance"))
    )


def hamming_delete_set(
    df: DataFrame, id_col: str, signature: str, max_distance: int = 5, bands: int = 3
) -> DataFrame:
    """Ids that are the right member of some pair, without listing the pairs."""
    reps, links = fold_copies(df.select(id_col, F.col(signature).alias("sig")), id_col, "sig")
    return similar_signatures(reps, max_distance, bands, "left_semi").unionByName(
        links.select(F.col("copy").alias("id"))
    )


# ---- plans ---------------------------------------------------------------------------------


def delete_set(pairs: DataFrame) -> DataFrame:
    """Automatic mode: every right member of a matching pair, once."""
    return pairs.select(F.col("right_id").alias("id")).distinct()


def review_pairs(pairs: DataFrame, score: str) -> DataFrame:
    """Review mode: unique unordered pairs with their score."""
    return pairs.select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), score
    ).dropDuplicates(["left_id", "right_id"])


def survivors(df: DataFrame, id_col: str, deleted: DataFrame) -> DataFrame:
    return df.join(deleted.select(F.col("id").alias(id_col)), id_col, "left_anti")
