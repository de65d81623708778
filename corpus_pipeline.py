"""A corpus from raw documents to packed training windows, by operators of ``figcorpus.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from figcorpus.llm.common import table
from figcorpus.llm.langid import stage_language
from figcorpus.llm.mixing import stage_mixing
from figcorpus.llm.packing import stage_packing
from figcorpus.llm.simhash import stage_near_dedup
from figcorpus.llm.suffix_dedup import stage_suffix_dedup
from figcorpus.session import scratch_dir

#: Each stage works on all that the one before it kept; all but the last return the columns of documents.
STAGES = [
    ("language", stage_language),
    ("near_duplicates", stage_near_dedup),
    ("repeated_strings", stage_suffix_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: No stage can be told in SQL: the first holds a trained model, the second XXH64, the last a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
