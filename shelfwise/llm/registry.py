"""Queries and SQL of the corpus operators, for the driver contract."""

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import shelfwise
from shelfwise.llm import collocations, embeddings, exact_dedup, langid, mixing, packing, pages, pieces, sharding, simhash, token_counts, toxicity, whitening


_ROOT = str(Path(shelfwise.__file__).resolve().parent.parent)


@functools.cache
def _ship(application: str) -> None:
    """Hand the package to the Python workers of an application that cannot find it themselves."""
    folder = tempfile.mkdtemp(prefix="shelfwise-")  # Spark serves the file to every executor
    archive = shutil.make_archive(f"{folder}/shelfwise", "zip", _ROOT, "shelfwise")
    SparkSession.active().sparkContext.addPyFile(archive)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            _ship(spark.sparkContext.applicationId)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # it imports this package in turn

    found = {
        "op1_mixing": mixing.op1_mixing,
        "op2_simhash": simhash.op2_simhash,
        "op3_sharding": sharding.op3_sharding,
        "op4_language_id": langid.op4_language_id,
        "op5_html_extraction": pages.op5_html_extraction,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_embeddings": embeddings.op10_embeddings,
        "op11_collocations": collocations.op11_collocations,
        "op12_packing": packing.op12_packing,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": collocations.OP11_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op10_embeddings": embeddings.OP10_SQL}
