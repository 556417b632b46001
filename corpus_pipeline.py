"""The corpus pipeline: documents -> packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result
as Parquet in the shared folder (``spark.checkpoint.dir``) and rereads it as the next one's input.
All stages but the last return the columns of ``documents``:

1. quality classifier: documents below ``LEAST_QUALITY`` go.
2. language ID: documents without a language, or with a score below ``LEAST_LANGUAGE``, go.
3. n-gram Jaccard join: of documents linked by five-word shingles at 0.8, the one with the least id stays.
4. suffix-array dedup: passages of ``LEAST_REPEAT`` bytes or more that start more than once go
   everywhere (a passage of over 50 words is longer); ``n_chars`` follows.
5. best-fit packing: rows of document pieces and their bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featuremart.llm import op2_langid, op3_jaccard_join, op4_packing, op6_quality, op9_suffix_dedup
from featuremart.llm.common import materialize, read_table

LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.3
LEAST_REPEAT = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled rows of the stage's input."""
    model = op6_quality.train(docs, read_table(spark, sf_dir, "labels"), op6_quality.train_fold)
    return op6_quality.passing(docs, model, LEAST_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the stage's input."""
    return op2_langid.identified(docs, op2_langid.train(docs, op2_langid.train_fold), LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_jaccard_join.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_suffix_dedup.remove(docs, length=LEAST_REPEAT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_packing.pack(docs)


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates),
          ("suffix-array dedup", repeats), ("best-fit packing", packing)]

#: Trained models and packing can't be stated in SQL; the tests hold each stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
