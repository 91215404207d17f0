"""The corpus pipeline: language ID, exact and near de-duplication, mixing to target weights, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refaudit.llm.common import shared_folder, table
from refaudit.llm.exact_dedup import deduplicate
from refaudit.llm.language import known_language
from refaudit.llm.mixing import mixed
from refaudit.llm.packing import packed_documents
from refaudit.llm.simhash import RADIUS, near_deduplicate


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the text model is fitted on these documents' own declared languages."""
    return known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of operator 1: SimHash fingerprints of three-word shingles, linked at three or fewer differing bits."""
    return near_deduplicate(docs, radius=RADIUS, prints=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; the last stage."""
    return packed_documents(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: SimHash, entropy balancing and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
