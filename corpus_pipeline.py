"""A corpus from documents to packed sequences: filter, deduplicate, mix, pack.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns what the next one gets as docs, all but the last with the columns
of documents. run() applies them to the documents of sf_dir, each stage's rows
being written to the shared folder before the next stage reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import common, mixing, near_dedup, packing, quality, toxicity
from quillmark.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a toxicity score under 0.5."""
    model = toxicity.fit(docs, common.table(ship(spark), sf_dir, "labels"))
    common.given_back()  # what the fit took in the driver's Python
    score = common.OWN + "toxic"
    return docs.withColumn(score, toxicity.score("text", model)).where(F.col(score) < 0.5).drop(score)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes."""
    common.cleaned(ship(spark))
    return quality.selected(docs, common.table(ship(spark), sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    common.cleaned(ship(spark))
    return near_dedup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by their sources' weights, repeated ones as often as they are drawn."""
    ship(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    out = packing.pack_documents(docs)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Compression, hashed models and alignment have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
