"""The queries of the text operators, one opN_<name> each, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import edit_prints, line_dedup, mixing, ngram_join, packing, quality, rans, secrets, token_counts, windows
from marlstone.llm.common import documents
from marlstone.llm.oracle import SQL


def op1_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = rans.round_trip(documents(spark, sf_dir))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(documents(spark, sf_dir))
    return planned.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken", "source", "copies")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    first = ["doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans")]
    return found.select(*first, "n_owned", "n_shared")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.print_with_edits(documents(spark, sf_dir))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(documents(spark, sf_dir))


def op7_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = windows.dedup_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, "n_lines", "n_stop_words", *(f"fails_{r.name}" for r in quality.THRESHOLDS))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir)))


def op10_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
