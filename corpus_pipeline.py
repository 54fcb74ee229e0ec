"""The corpus pipeline: quality classifier, near-duplicate removal, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet
in the folder the executors share and rereads it as the next one's docs. All but the last stage return the
columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import mixing, ngram_join, packing, quality_classifier, suffix_dedup
from cairn.llm.common import lean, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows without a doc_id cannot be joined and stay."""
    scored = quality_classifier.classify_quality(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("predicted = 0").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, stays of each class of documents linked by 5-word shingles at similarity 0.8."""
    classes = ngram_join.near_duplicates(docs, shingle=5, percent=80)
    extra = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(COLUMNS)


def _as_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string()), b.column("lang"), b.column("source"), b.column("n_removed"), b.column("n_bytes")], names=["doc_id", "text", "lang", "source", "n_removed", "n_bytes"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings that start earlier go (cut characters with them); a document that loses all its text goes."""
    cut = suffix_dedup.remove_repeats(docs, ["doc_id", "lang", "source"])
    kind = "doc_id bigint, text string, lang string, source string, n_removed bigint, n_bytes bigint"
    left = cut.mapInArrow(lean(_as_text), kind).where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_removed") == 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row comes as often as its doc_id is drawn from its source; nulls are values like others."""
    return mixing.draw(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row per piece of a document."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing sources to target weights", mix), ("packing", pack)]

#: Models, similarity classes and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
