"""Queries of near-duplicate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import vectors as vec
from figcorpus.operators import dedup as dd
from figcorpus.plans.registry import query, table
from figcorpus.session import spread

# Every tenth vector comes again with its first component moved by 0.001, every seventh as it is.
VECTORS = """vecs AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings
  UNION ALL SELECT vec_id+1000000, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i=1 THEN x+0.001 ELSE x END) FROM embeddings WHERE vec_id%10=0
  UNION ALL SELECT vec_id+2000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id%7=0),
reps AS (SELECT e, min(vec_id) rep FROM vecs GROUP BY e),
links AS (SELECT rep, vec_id AS copy FROM vecs JOIN reps USING (e) WHERE vec_id<>rep),
pairs AS (SELECT a.rep i, b.rep j, list_cosine_similarity(a.e, b.e) s FROM reps a JOIN reps b ON a.rep<b.rep WHERE list_cosine_similarity(a.e, b.e)>=0.98),
listed AS (SELECT i left_id, j right_id, round(s,6) similarity FROM pairs UNION ALL SELECT rep, copy, 1.0 FROM links)"""


def _vectors(spark, sf):
    e = spread(table(spark, sf, "embeddings").select("vec_id", vec.to_double("embedding").alias("e")))
    moved = F.transform("e", lambda x, i: F.when(i == 0, x + 0.001).otherwise(x))
    near = e.where("vec_id % 10 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), moved.alias("e"))
    same = e.where("vec_id % 7 = 0").select((F.col("vec_id") + 2000000).alias("vec_id"), "e")
    return e.unionByName(near).unionByName(same)


# Sign bits of the vectors; planted copies with p = 0..6 flipped bits.
SIGNS = """base AS (SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN x>0 AND i<64 THEN CAST(pow(2,i-1) AS HUGEINT) WHEN x>0 THEN -CAST(pow(2,63) AS HUGEINT) ELSE 0::HUGEINT END))::BIGINT sig FROM embeddings),
sigs AS (SELECT vec_id, sig FROM base UNION ALL SELECT vec_id+1000000, xor(sig, ((1::BIGINT<<CAST(vec_id%7 AS INT))-1)<<CAST(vec_id%50 AS INT)) FROM base WHERE vec_id%3=0),
srep AS (SELECT sig, min(vec_id) rep FROM sigs GROUP BY sig),
slink AS (SELECT rep, vec_id AS copy FROM sigs JOIN srep USING (sig) WHERE vec_id<>rep),
spair AS (SELECT a.rep left_id, b.rep right_id, bit_count(xor(a.sig,b.sig))::BIGINT distance FROM srep a JOIN srep b ON a.rep<b.rep WHERE bit_count(xor(a.sig,b.sig))<=5
  UNION ALL SELECT rep, copy, 0 FROM slink)"""


def _signs(spark, sf):
    base = spread(table(spark, sf, "embeddings")).select(
        "vec_id",
        F.aggregate(
            F.transform("embedding", lambda x, i: F.call_function("shiftleft", (x > 0).cast("bigint"), i)),
            F.lit(0).cast("bigint"),
            lambda a, b: a.bitwiseOR(b),
        ).alias("sig"),
    )
    flip = F.expr("shiftleft(shiftleft(1L, CAST(vec_id % 7 AS INT)) - 1, CAST(vec_id % 50 AS INT))")
    planted = base.where("vec_id % 3 = 0").select(
        (F.col("vec_id") + 1000000).alias("vec_id"), F.col("sig").bitwiseXOR(flip).alias("sig")
    )
    return base.unionByName(planted)


@query("c16_similar_pairs_cosine", f"WITH {VECTORS} SELECT * FROM listed")
def c16(spark, sf):
    return dd.similar_pairs_cosine(_vectors(spark, sf), "vec_id", "e").withColumn(
        "similarity", F.round("similarity", 6)
    )


@query("c17_similar_pairs_hamming", f"WITH {SIGNS} SELECT * FROM spair")
def c17(spark, sf):
    return dd.similar_pairs_hamming(_signs(spark, sf), "vec_id", "sig")


@query(
    "g02_duplicate_plan",
    f"""WITH {VECTORS} SELECT DISTINCT v.vec_id FROM vecs v WHERE v.vec_id NOT IN
    (SELECT b.vec_id FROM vecs a JOIN vecs b ON a.vec_id<b.vec_id WHERE list_cosine_similarity(a.e, b.e)>=0.98)""",
)
def g02(spark, sf):
    vectors = _vectors(spark, sf)
    return dd.survivors(vectors, "vec_id", dd.cosine_delete_set(vectors, "vec_id", "e")).select("vec_id")


@query(
    "g02_duplicate_plan_hamming",
    f"""WITH {SIGNS} SELECT DISTINCT b.vec_id AS id FROM sigs a JOIN sigs b ON a.vec_id<b.vec_id WHERE bit_count(xor(a.sig,b.sig))<=5""",
)
def g02h(spark, sf):
    return dd.hamming_delete_set(_signs(spark, sf), "vec_id", "sig")


@query(
    "g02_review_pairs",
    f"WITH {SIGNS} SELECT DISTINCT least(left_id,right_id) left_id, greatest(left_id,right_id) right_id, distance FROM spair",
)
def g02r(spark, sf):
    return dd.review_pairs(dd.similar_pairs_hamming(_signs(spark, sf), "vec_id", "sig"), "distance")


@query(
    "i03_signature",
    """SELECT vec_id,
    list_sum(list_transform(e, lambda x, i: CASE WHEN x>list_sum(e)/len(e) AND i<64 THEN CAST(pow(2,i-1) AS HUGEINT) WHEN x>list_sum(e)/len(e) THEN -CAST(pow(2,63) AS HUGEINT) ELSE 0::HUGEINT END))::BIGINT mean_signature,
    list_sum(list_transform(e, lambda x, i: CASE WHEN x>e[i%len(e)+1] AND i<64 THEN CAST(pow(2,i-1) AS HUGEINT) WHEN x>e[i%len(e)+1] THEN -CAST(pow(2,63) AS HUGEINT) ELSE 0::HUGEINT END))::BIGINT next_signature
    FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)""",
)
def i03(spark, sf):
    return spread(table(spark, sf, "embeddings")).select(
        "vec_id",
        vec.signature("embedding", "mean").alias("mean_signature"),
        vec.signature("embedding", "next").alias("next_signature"),
    )
