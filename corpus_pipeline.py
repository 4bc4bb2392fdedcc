"""The training-corpus pipeline: five stages, each one of the operators of ``shelfwise.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read again as the next stage's documents. All but the last return the columns
of the documents.
"""

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import exact_dedup, langid, mixing, pieces, simhash
from shelfwise.llm.common import file_row, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too), or in no known language, go; if no row
    has a language, only the former. Repeated rows stay or go together."""
    return langid.keep_identified(docs, row=file_row(docs))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space stays, repeated rows included: the
    smallest id, null ids last, then the first in the files. Null texts count as empty."""
    return exact_dedup.deduplicate(docs, row=file_row(docs))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, chosen as above: groups reach each other by pairs whose
    sets of five-word shingles are similar to 0.8 or more. Null, empty and blank texts are one group."""
    return simhash.keep_one_of_each(docs, row=file_row(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture. Null sources are one source; repeated rows and
    null or empty texts are placed like any others."""
    return mixing.mix(docs, key=mixing.random_key(docs))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the pieces, of the decoded text and of the spans, one row per document, repeated
    ones too. Null texts count as empty. An empty table gives no rows in any stage; columns with
    other names pass through all but this one unchanged."""
    return pieces.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece_encoding),
]

#: SQL can express neither the trigram model nor the pieces; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
