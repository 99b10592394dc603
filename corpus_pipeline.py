"""The corpus pipeline: documents through quality rules, near-copy removal, decontamination, PII surrogates and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and gives what is read back to the next. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.common import table, written
from driftgrid.llm.decontamination import drop_contaminated
from driftgrid.llm.jaccard_join import keep_one_of_each
from driftgrid.llm.packing import pack_documents
from driftgrid.llm.pii import replace_pii
from driftgrid.llm.quality_rules import keep_good
from driftgrid.llm.queries import TOKENIZER, pii_key, trusted_ids


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with the threshold that the trusted ones give."""
    return keep_good(docs, trusted_ids(spark, sf_dir), threshold=None)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars is that of the new text."""
    replaced = replace_pii(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long"))
    return replaced.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document."""
    packed = pack_documents(docs, TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL can't express token ids; the tests hold the Jaccard stage against brute force and the others to planted cases.
ORACLE_SQL = None
