"""Human review: linking records, applying edits, text forms of typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def link_fields(main: DataFrame, others: dict[str, DataFrame], fields: list[str]) -> dict[str, list[str]]:
    """Which of the chosen fields each other source has in common with the main one."""
    have = [f for f in fields if f in main.columns]
    return {name: [f for f in have if f in df.columns] for name, df in others.items()}


def link_records(main: DataFrame, other: DataFrame, fields: dict[str, str], within: list[str]) -> DataFrame:
    """Records of another source that belong to each main record.

    Mapped fields must be equal as text, a field missing on either side counts as equal.
    ``within`` are key columns both sides always have (the book, or book and image).

    Whether a field takes part depends on both rows, so each row is filed once for every
    pattern of missing fields that occurs on the other side; rows that meet agree on the
    pattern and on all fields it leaves. That is one equi-join without a cross product,
    and a large book spreads over the values of its fields. The patterns come from one
    aggregate of each side, at most 2 to the number of fields.
    """
    pairs = list(fields.items())

    def mask(cols):
        m = F.lit(0)
        for i, c in enumerate(cols):
            m = m + F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(0)
        return m

    def key(cols, both: Column):
        return F.array(
            *[F.when(both.bitwiseAND(F.lit(1 << i)) != 0, F.col(c).cast("string")).otherwise("") for i, c in enumerate(cols)]
        )

    def occurring(df: DataFrame, cols) -> Column:
        found = sorted(r[0] for r in df.select(mask(cols).alias("m")).distinct().collect())
        return F.array(*[F.lit(p) for p in found]).cast("array<int>")

    left = (
        main.withColumn("_m", mask([a for a, _ in pairs]))
        .withColumn("_o", F.explode(occurring(other, [b for _, b in pairs])))
        .withColumn("_key", key([a for a, _ in pairs], F.col("_m").bitwiseAND(F.col("_o"))))
    )
    right = other.select(*[F.col(c).alias(f"other_{c}") for c in other.columns])
    right = (
        right.withColumn("_ro", mask([f"other_{b}" for _, b in pairs]))
        .withColumn("_rm", F.explode(occurring(main, [a for a, _ in pairs])))
        .withColumn("_rkey", key([f"other_{b}" for _, b in pairs], F.col("_rm").bitwiseAND(F.col("_ro"))))
    )
    on = (F.col("_m") == F.col("_rm")) & (F.col("_o") == F.col("_ro")) & (F.col("_key") == F.col("_rkey"))
    for w in within:
        on = on & (F.col(w) == F.col(f"other_{w}"))
    return left.join(right, on).drop("_m", "_o", "_key", "_rm", "_ro", "_rkey", *[f"other_{w}" for w in within])


def class_of(fields: list[str]) -> Column:
    """The class of a record among those of its ``within`` keys: its field values as text."""
    return F.to_json(F.array(*[F.col(f).cast("string") for f in fields]), {"ignoreNullFields": "false"})


def _classes(df: DataFrame, fields: list[str], within: list[str], *aggs: Column) -> DataFrame:
    given = [F.col(w) for w in within] + [F.col(f).cast("string").alias(f) for f in fields if f not in within]
    grouped = df.groupBy(*given, class_of(fields).alias("_class"))
    return grouped.agg(*aggs) if aggs else grouped.agg(F.count("*").alias("n")).drop("n")


def link_classes(main: DataFrame, other: DataFrame, fields: dict[str, str], within: list[str]) -> DataFrame:
    """The links of :func:`link_records` between classes of equal records, not record by record.

    One row per linked pair of classes: ``within``, ``main_class``, ``other_class`` and the records
    in each, n_main and n_other. A record's class is ``class_of`` its fields, so copies, and
    records that lack every field and match all of their book, cost one row a class.
    Both sides are counted before anything is filed by pattern.
    """
    m = _classes(main, list(fields), within, F.count("*").alias("n_main")).withColumnRenamed("_class", "main_class")
    o = _classes(other, list(fields.values()), within, F.count("*").alias("n_other"))
    linked = link_records(m, o, fields, within)
    return linked.select(*within, "main_class", F.col("other__class").alias("other_class"), "n_main", F.col("other_n_other").alias("n_other"))


def link_counts(main: DataFrame, links: DataFrame, fields: list[str], within: list[str]) -> DataFrame:
    """Every main record with its class and the number of records it is linked to, 0 if none."""
    n = links.groupBy(*within, F.col("main_class").alias("class")).agg(F.sum("n_other").alias("n_links"))
    found = main.withColumn("class", class_of(fields)).join(n, [*within, "class"], "left")
    return found.select(*main.columns, "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def apply_review(main: DataFrame, edits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Records with the edits written over them; edits of unknown records are added.

    Of several edits of a record the latest counts; at one time the one with the
    larger index, then the larger reviewer. Edited records carry review_info(reviewer, timestamp, original_index).
    """
    info = F.struct("reviewer", "timestamp", "original_index")
    written = F.struct(*[F.col(f).alias(f"_e_{f}") for f in fields], info.alias("review_info"))
    e = edits.groupBy(*keys).agg(F.max_by(written, F.struct("timestamp", "original_index", "reviewer")).alias("_e")).select(*keys, "_e.*")
    joined = main.join(e, keys, "full")
    out = [F.when(F.col("review_info").isNotNull(), F.col(f"_e_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    kept = [c for c in main.columns if c not in keys and c not in fields]
    return joined.select(*keys, *out, *kept, "review_info")


def carried_edits(
    main: DataFrame, other: DataFrame, edits: DataFrame, keys: list[str], other_id: str, fields: dict[str, str], within: list[str]
) -> DataFrame:
    """Another source's records with the edits of the main records that they are linked to.

    Links are those of the unedited values (:func:`link_records`). An edited main
    record writes its mapped ``fields`` over those of every linked record; where several edited records
    reach one, the latest edit counts, at one time the larger index, then the
    larger reviewer. Records that are reached carry review_info(reviewer, timestamp,
    original_index) of that edit, the others null. Each source is merged by
    its own id, so repeating the same edits changes nothing.
    """
    info = F.struct("reviewer", "timestamp", "original_index")
    version = F.struct("timestamp", "original_index", "reviewer")
    values = F.struct(*[F.col(a).alias(f"_e_{b}") for a, b in fields.items()])
    latest = edits.groupBy(*keys).agg(F.max_by(F.struct(values.alias("v"), info.alias("info"), version.alias("at")), version).alias("_e"))
    touched = main.join(latest, keys)
    newer = F.max_by(F.col("_e"), F.col("_e.at")).alias("_e")
    # classes of edited records meet classes of the other source; of a class the latest edit counts
    edited = _classes(touched, list(fields), within, newer)
    reached = _classes(other, list(fields.values()), within)
    links = link_records(edited.drop("_class"), reached, fields, within)
    newest = links.groupBy(*within, F.col("other__class").alias("_class")).agg(newer)
    joined = other.withColumn("_class", class_of(list(fields.values()))).join(newest, [*within, "_class"], "left")
    hit = F.col("_e").isNotNull()
    mapped = [F.when(hit, F.col(f"_e.v._e_{b}")).otherwise(F.col(b)).alias(b) for b in fields.values()]
    kept = [c for c in other.columns if c != other_id and c not in fields.values()]
    return joined.select(other_id, *mapped, *kept, F.col("_e.info").alias("review_info"))


def apply_linked_review(
    main: DataFrame, edits: DataFrame, keys: list[str], fields: list[str], others: dict[str, tuple[DataFrame, str, dict[str, str]]], within: list[str]
) -> dict[str, DataFrame]:
    """The reviewed main records (under ``main``) and those of every linked source, by its name.

    ``others`` gives each source's records, id and mapped fields.
    """
    out = {"main": apply_review(main, edits, keys, fields)}
    return out | {name: carried_edits(main, df, edits, keys, id_, mapped, within) for name, (df, id_, mapped) in others.items()}


def _stringify(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.struct(*[_stringify(c[f.name], f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _stringify(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _stringify(v, t.valueType))
    return F.coalesce(F.btrim(c.cast("string")), F.lit(""))


def stringify_leaves(df: DataFrame) -> DataFrame:
    """Every leaf as trimmed text, missing values as the empty text, whatever the nesting."""
    return df.select(*[_stringify(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def _restore(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.struct(*[_restore(c[f.name], f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _restore(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _restore(v, t.valueType))
    return c if isinstance(t, T.StringType) else F.nullif(c, F.lit("")).try_cast(t)


def restore_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text leaves back to the types of the original schema, unreadable ones NULL."""
    return df.select(*[_restore(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields])
