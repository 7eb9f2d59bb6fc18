"""A training corpus from raw documents: five stages, each a table in Parquet.

Every stage works on all documents that the one before it kept, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicrate.llm.decontaminate import decontaminate
from lexicrate.llm.jaccard import jaccard_classes
from lexicrate.llm.line_dedup import dedup_lines
from lexicrate.llm.packing import pack
from lexicrate.llm.shared import documents, fresh_names, staged
from lexicrate.llm.toxicity import fit, score_toxicity, training_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.  The model learns from the labelled ones that are not held out."""
    model = fit(training_rows(docs, documents(spark, sf_dir, "labels")))
    score, flag = fresh_names(docs.columns, "toxicity", "toxic")
    scored = score_toxicity(docs, model, score_col=score, flag_col=flag)
    return scored.where(~F.col(flag)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of words go; so does a document of which nothing is left."""
    out = dedup_lines(docs)  # columns of documents have other names than its results
    changed = F.col("removed_words") > 0
    left = out.where(~(changed & (F.trim("text") == ""))).withColumn(
        "n_chars",
        F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")),
    )
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays.

    Rows without a doc_id stay; rows of one doc_id are one document.
    """
    classes = jaccard_classes(docs)
    gone = classes.where("doc_id is not null and doc_id != component_id").select("doc_id")
    return docs.join(staged(gone.distinct(), "copies"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs, documents(spark, sf_dir, "benchmark"))
    hit_id, hit_hash = fresh_names(docs.columns, "hit_id", "hit_hash")
    hit = staged(
        found.where("contaminated").select(
            F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash)
        ).distinct(),
        "hit",
    )
    same = F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_hash))
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Token ids, a fitted classifier and a packing plan are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
