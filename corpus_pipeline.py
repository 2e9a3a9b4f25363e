"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads
it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorline import storage
from sensorline.llm import credentials, decontamination, near_copies, packing, quality
from sensorline.llm.common import table
from sensorline.llm.registry import QUALITY_THRESHOLD, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component linked by five-word shingles of Jaccard 0.8 or more."""
    return near_copies.without_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts give way to their kind in brackets."""
    return credentials.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their ids and their place in packed sequences."""
    return packing.pack(docs, tokenizer_path(), end_id=1, with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_redaction),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints, the classifier and the tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's intermediate tables, and its input, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = storage.fresh_path(spark, name.replace(" ", "-"))
        with storage.run(spark):
            docs = storage.written(stage(spark, docs, sf_dir), path)
        if before:
            storage.remove(spark, before)
        before = path
    return docs
