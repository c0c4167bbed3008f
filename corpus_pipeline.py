"""The corpus pipeline: five stages, each written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir), docs being all that the stage before
it kept, and returns rows with the columns of documents; the last adds copy and
shuffle_key.  A stage judges documents on the docs that it gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.llm.decontaminate import contamination
from timbral.llm.jaccard_join import jaccard_components
from timbral.llm.language_id import UNKNOWN, held_out, identify, train
from timbral.llm.mixing import mix_sources
from timbral.llm.shared import stored, table
from timbral.llm.suffix_dedup import remove_repeats

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if one language has this share of it at least.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters, or without a main language, go."""
    found = identify(docs, train(docs.where(~held_out())))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group linked by a Jaccard similarity of 0.8 over five words."""
    groups = jaccard_components(docs, width=5, at_least=80, of=100)
    later = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document has; a document of which nothing is left goes."""
    kept = remove_repeats(docs).select("doc_id", F.col("kept_text").alias("text"), "n_removed")
    rest = docs.drop("text", "n_chars").dropDuplicates(["doc_id"]).join(kept, "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    return rest.where("n_removed = 0 or n_chars > 0").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item occurs; one of a few words, which any text may hold, says nothing."""
    leaks = contamination(docs, table(spark, sf_dir, "benchmark")).where("not short_item").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at an equal share of the bytes, in one random order."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL has no form for the first stage, nor for those that follow it on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, with a table in the shared folder between them."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
