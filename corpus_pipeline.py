"""A corpus pipeline of five stages, each of which calls one operator of ``lodestrata.llm``.

Every stage but the last returns the columns of its input and keeps what its operator decides: rejected
documents are gone and texts are the cleaned ones. Stages hand over Parquet tables in the
session's shared work folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.decontaminate import decontaminate
from lodestrata.llm.langid import fit, identify
from lodestrata.llm.linededup import drop_repeated_lines
from lodestrata.llm.neardup import near_duplicates
from lodestrata.llm.packing import pack
from lodestrata.llm.shared import drop_dir, work_dir, work_scope

#: A language is rejected below this posterior, and where the text fits it so badly (nats an n-gram) that it is in none that was learnt.
LEAST_SCORE, LEAST_FIT = 0.5, -3.5


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under column names that no result column has, and the new name of each column."""
    names = {c: f"in_{i}_{c}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.select(*[F.col(v).alias(k) for k, v in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, with one that is not clear, or in none of those learnt (gibberish too), go."""
    model = fit(docs)
    table, n = apart(docs)
    found = identify(table, model, text_col=n["text"])
    return back(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("fit") >= LEAST_FIT)), n)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go, and documents that nothing is left of; n_chars follows the text."""
    table, n = apart(docs)
    found = drop_repeated_lines(table, id_col=n["doc_id"], text_col=n["text"])
    found = found.filter(F.coalesce((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")), F.lit(True)))
    if "n_chars" in n:
        found = found.withColumn(n["n_chars"], F.length(n["text"]).cast(docs.schema["n_chars"].dataType))
    return back(found, n)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    table, n = apart(docs)
    return back(near_duplicates(table, id_col=n["doc_id"], text_col=n["text"], shingle=5, percent=80).filter("first"), n)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    table, n = apart(docs)
    return back(decontaminate(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=n["text"]).filter(~F.col("contaminated")), n)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024: one row a piece, with its ids, sequence and offset."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"], end_id=0, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Language scores and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"stage-{k}")
        with work_scope(spark):  # what the stage kept for itself goes once its result is written
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            drop_dir(spark, before)
        before = path
    return docs
