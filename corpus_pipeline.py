"""The corpus pipeline: stages that each read what the one before kept.

Each stage is called with the session, the documents that the one before returned, and the data
folder.  All but the last return the columns of ``documents``.

Defined results: null, empty and letterless texts go with the first stage.  Repeated rows and rows
without doc_id pass it like any others; of equal or near texts one row stays, that of the least
doc_id, and a row without one counts as having the largest.  Very long texts stay whole in all stages;
packing cuts them into pieces.  An empty table passes through all stages as an empty table.  Further
columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, language_id, line_dedup, near_dedup, packing
from lodestar.llm.common import stored, table

#: Language identification compresses texts, signatures are hashed and packing is sequential within
#: its blocks: DuckDB has no words for these, so tests hold all stages together against a plain version.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin."""
    return language_id.keep_identified(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds too."""
    return line_dedup.without_repeated_lines(docs)


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near duplicates."""
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each document or, if it is longer than a bin, of each of its pieces."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
