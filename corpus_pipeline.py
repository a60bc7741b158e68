"""A corpus pipeline over ``documents``: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns packed pieces.
``doc_id`` names a document: rows that repeat an id are one document for the duplicate stage. Rows with a null id
are kept by every filter that cannot judge them. Null and empty texts have no language, so the first stage drops them; very long
texts are read whole by every stage. An empty table gives no rows. Columns that an operator would add under a clashing name are
the documents' own again at the end of each stage; ties between copies go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import decontaminate, jaccard, langid, packing, pii
from stowage.llm.common import materialize, split_by_filter, table
from stowage.llm.queries import tokenizer_path
from stowage.session import ship

LEAST_LANG_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter, or too uncertain, go."""
    model = langid.fit(docs, F.lit(True))
    judged = langid.identify(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANG_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of documents linked by their shingles.

    Only texts whose id may be dropped or repeated, by a filter of fixed size, are dealt out by their id; all others stay where they lie.
    """
    found = materialize(jaccard.join(docs), "pipeline-groups").where("doc_id is not null")
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest, touched = split_by_filter(docs, dropped.union(repeated), "doc_id", F.col("doc_id"))
    judged = touched.where("doc_id is not null").join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return rest.unionByName(judged.select(*docs.columns)).unionByName(touched.where("doc_id is null"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = materialize(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "pipeline-leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of tokens."""
    return packing.digest(packing.pack(docs, tokenizer_path()))


def _shipped(stage: Callable) -> Callable:
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [(stage.__name__, _shipped(stage)) for stage in (language, near_duplicates, leaks, private_data, packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
