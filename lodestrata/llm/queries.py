"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .htmlextract import extract
from .langid import fit, identify
from .linededup import drop_repeated_lines
from .neardup import near_duplicates
from .packing import pack
from .pii import sanitise
from .quality import quality
from .shared import documents, work_dir
from .tokenfile import read_token_files, write_token_files
from .warc import read_archives, write_archives


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(documents(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    found = read_archives(spark, archives, payloads=False)
    gap = F.raise_error(F.concat_ws(" ", F.lit("a gap in an archive just written:"), "file", "start", "end", "reason"))
    found = found.withColumn("payload_bytes", F.when(F.col("reason").isNull(), F.col("payload_bytes")).otherwise(gap.cast("long")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()))
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), keep=["doc_id"], shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("spans", lambda x: x["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("flagged"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), keep=["doc_id"], end_id=0, capacity=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(documents(spark, sf_dir), work_dir(spark, "token-files"), tokenizer("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir), keep=["doc_id"], texts=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
