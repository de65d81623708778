"""Records of differing shape: VARIANT values to leaves, to text, and back to typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.session import durable

PATH = "array<struct<name:string,pos:int>>"


def shape(df: DataFrame, record: str = "record") -> DataFrame:
    """The one type that all records fit in, as text; fields of differing types are VARIANT there."""
    return df.agg(F.schema_of_variant_agg(record).alias("shape"))


def path_text(path="path") -> Column:
    """A path as it is written: ``a.b[0]``."""
    steps = F.transform(path, lambda s: F.when(s["name"].isNull(), F.concat(F.lit("["), s["pos"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), s["name"])))
    return F.ltrim(F.array_join(steps, ""), F.lit("."))


def variant_leaves(df: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """One row per leaf of every record: keys, ``path``, ``kind``, ``value`` as text.

    ``path`` lists the steps from the record, each with its name (null in lists) and place; ``kind`` is
    the leaf's type; a JSON null is VOID without a value; empty objects and lists are
    leaves with the values ``{}`` and ``[]``. Records that are SQL null have no leaves. All records go down one level a round, so there are as many
    rounds as the deepest record has levels, and only what is still nested goes on.
    """
    spark = df.sparkSession
    front = df.select(*keys, F.array().cast(PATH).alias("path"), F.col(record).alias("node")).where("node IS NOT NULL")
    found = None
    while True:
        seen = durable(front.withColumns({"kind": F.schema_of_variant("node"), "value": F.col("node").cast("string")}))
        nested = (F.col("kind").startswith("OBJECT<") & (F.col("kind") != "OBJECT<>")) | (
            F.col("kind").startswith("ARRAY<") & (F.col("value") != "[]")
        )
        leaves = seen.where(~nested).drop("node")
        found = leaves if found is None else found.unionByName(leaves)
        deeper = seen.where(nested)
        if deeper.isEmpty():
            return found
        step = "named_struct('name', e.key, 'pos', e.pos)"
        named = ", ".join(f"f.`{k}`" for k in keys)
        front = spark.sql(
            f"SELECT {named}, CAST(concat(f.path, array({step})) AS {PATH}) AS path, e.value AS node FROM {{f}} f, LATERAL variant_explode(f.node) e",
            f=deeper,
        )


def _quoted(c: Column) -> Column:
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def leaf_error(kind="kind", value="value") -> Column:
    """Why a leaf's text can no longer be read as its kind, null where it can."""
    k, v = F.col(kind), F.col(value)
    number = k.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    whole = k.rlike("^(TINYINT|SMALLINT|INT|BIGINT)$")
    bad = (
        (whole & ~F.coalesce(v.rlike(r"^-?\d+$"), F.lit(False)))
        | (number & ~F.coalesce(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.lit(False)))
        | ((k == "BOOLEAN") & ~F.coalesce(v.isin("true", "false"), F.lit(False)))
    )
    return F.when(bad, F.concat(F.lit("no "), k, F.lit(": "), F.coalesce(v, F.lit("null"))))


def rebuild_variants(leaves: DataFrame, keys: list[str], as_text: bool = False) -> DataFrame:
    """The records of leaf rows: keys, ``record`` (VARIANT), ``errors``.

    Leaves take their kind again, so leaves nobody edited give the same record. A text that is not of its kind
    any more stays in the record as text and is named in ``errors``, with its path. ``as_text`` makes every leaf
    trimmed text instead, missing values the empty text. Keys must tell records apart; levels are
    put together from the deepest up, one grouping each.
    """
    leaves = durable(leaves)
    error = F.lit(None).cast("string") if as_text else leaf_error()
    v = F.col("value")
    if as_text:
        whole = F.col("kind").startswith("OBJECT<") | F.col("kind").startswith("ARRAY<")
        made = F.when(whole, v).otherwise(_quoted(F.coalesce(F.btrim(v), F.lit(""))))
    else:
        made = (
            F.when(F.col("kind") == "VOID", F.lit("null"))
            .when((F.col("kind") == "STRING") | error.isNotNull(), F.coalesce(_quoted(v), F.lit("null")))
            # JSON numbers have no leading zeros, which edited ones may
            .otherwise(F.regexp_replace(v, r"^(-?)0+(?=\d)", "$1"))
        )
    told = F.when(error.isNotNull(), F.array(F.concat(path_text(), F.lit(": "), error))).otherwise(F.array().cast("array<string>"))
    cells = leaves.select(*keys, "path", made.alias("json"), told.alias("errors"))
    depth = leaves.agg(F.max(F.size("path")).alias("d")).first()["d"] or 0
    current = cells.where(F.size("path") == depth)
    for level in range(depth - 1, -1, -1):
        step = F.element_at("path", -1)
        part = F.struct(step["pos"].alias("pos"), step["name"].alias("name"), "json", "errors")
        above = current.withColumn("_part", part).withColumn("path", F.slice("path", 1, level)) if level else current.withColumns({"_part": part, "path": F.array().cast(PATH)})
        parts = above.groupBy(*keys, "path").agg(F.array_sort(F.collect_list("_part")).alias("p"))
        entry = lambda x: F.when(x["name"].isNull(), x["json"]).otherwise(F.concat(_quoted(x["name"]), F.lit(":"), x["json"]))
        inside = F.array_join(F.transform("p", entry), ",")
        listed = F.get("p", F.lit(0))["name"].isNull()
        text = F.when(listed, F.concat(F.lit("["), inside, F.lit("]"))).otherwise(F.concat(F.lit("{"), inside, F.lit("}")))
        built = parts.select(*keys, "path", text.alias("json"), F.flatten(F.transform("p", lambda x: x["errors"])).alias("errors"))
        current = cells.where(F.size("path") == level).unionByName(built)
    return current.select(*keys, F.parse_json("json").alias("record"), "errors")
