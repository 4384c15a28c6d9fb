"""The corpus pipeline: documents -> packed training sequences.

Stages, in order: language ID (documents without a recognised language go),
near duplicates (one document of each class of similar texts stays), benchmark
decontamination (documents that overlap with a benchmark item go), packing.
Each stage is (spark, docs, sf_dir) -> DataFrame, works on whatever ``docs``
holds and keeps its columns; the last returns the pieces of the sequences.

Defined results, for every stage: nulls in any column are kept as they are; an
empty table gives an empty table; columns of any other name pass through, whatever
they are called. Reruns, and tasks repeated after a lost executor, give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import decontaminate, jaccard_join, language_id, packing
from kestrel.llm.common import fresh, shared_folder, small_batches, table
from kestrel.session import ship_package

# Below this likeness to every language profile a text is in none of them. Clean
# texts of the learned languages lie above 0.4; other scripts have next to none.
LEAST_LIKENESS = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised. A null or empty text, or one
    without a letter, has none and goes. Of equally near languages the smaller name
    counts; repeated rows are judged alike. Long texts are counted whole."""
    ship_package(spark)
    small_batches(spark)
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out("doc_id")))
    p = fresh(docs, "p")
    judged = docs.withColumn(p, language_id.classifier(profiles)("text"))
    return judged.where((F.col(f"{p}.lang_pred") != language_id.UNDETERMINED)
                        & (F.col(f"{p}.score") >= LEAST_LIKENESS)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: the smallest id, and of
    rows that repeat id and text one, by a hash of their other columns. Texts without
    a word are no near duplicates of anything; of these, rows with equal id and text
    count once."""
    ship_package(spark)
    small_batches(spark)
    return jaccard_join.first_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item. Null and empty texts or items
    overlap with nothing; repeated rows go or stay alike."""
    ship_package(spark)
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' token ids into sequences. A null or empty text is one id,
    the end; repeated rows are packed each; ties of length go in a fixed order."""
    ship_package(spark)
    small_batches(spark)
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("packing", pack)]

# SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
