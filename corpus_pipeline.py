"""Five stages from raw documents to packed sequences, for a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to the
``documents`` table one after another and writes each result as Parquet, which the next reads; a
result goes when the next is written, as does what a stage staged, and the last one stays.

Nulls, ties and repeated rows: a null or empty text has no words, so the quality rules drop it. A
null doc_id never names a group; such a row stays in exact dedup only if no row of its group has
an id, and always in near dedup. Of rows that are repeated one stays. Rows without a source are
mixed as "other". Empty tables give empty results, and further columns pass through the first
four stages whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import remove, shared_dir, temporary
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.mixing import WEIGHTS, mix
from lodestone.llm.packing import packed
from lodestone.llm.quality import quality_filter
from lodestone.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the base and the limits on repetition."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with the largest doc_id, of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of near texts."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the schedule."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, placed in sequences that follow the mix."""
    return packed(docs, weights=WEIGHTS)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixing), ("packing", packing)]
#: SQL has no XXH64 and no tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
