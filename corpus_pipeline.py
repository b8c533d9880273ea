"""A corpus pipeline over `documents`: quality rules, toxicity, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared
folder as Parquet and reads again for the next one. All but the last return the columns of
documents, as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, quality, simhash, toxicity
from ledgerloom.llm.common import stage, table
from ledgerloom.llm.queries import encoded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or fall under the ratio's threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.measure(docs, model).filter("quality.kept").select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The classifier learns from labelled rows of documents."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest doc_id stays."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated as often as the mix takes it as a whole, or not at all."""
    return mixing.materialize(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash near-dedup", near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", bpe_encoding),
]

#: The digests of token ids can't be had in SQL; tests/llm/test_pipeline.py holds run() against plain
#: Python stage by stage, with the fitted models of operators 5 and 8.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
