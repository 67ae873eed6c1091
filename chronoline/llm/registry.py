"""Queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm import bpe, divergence_audit, html_extract, license_scan, line_dedup, media_audio, packing, periodic_runs, quality_classifier, quality_rules, set_join, simhash, url_filter
from chronoline.llm.common import table


def vocabulary_path() -> str:
    """The public byte-level vocabulary that the driver's machine offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path: source, language and a block of a thousand ids stand for the directories."""
    part = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    block = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", part("source"), part("lang"), block, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan_licences(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"), notices_give=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_audio.media_features(table(spark, sf_dir, "documents"))
    seconds = lambda spans: F.transform(spans, lambda s: F.concat(F.round(s["start"], 3).cast("string"), F.lit("-"), F.round(s["end"], 3).cast("string")))
    shown = {
        "frames": F.col("n_frames"), "span": F.element_at(seconds("spans"), -1), "tensors": F.size("spans"), "stored": F.lower(F.hex(F.xxhash64("tensors"))),
        "mean_db": F.array_join(F.transform("mean_db", lambda v: F.bround(v, 1).cast("string")), ","), "segments": F.array_join(seconds("segments"), ","),
    }
    feature = F.concat_ws(" ", *(F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in shown.items()))
    digests = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return found.select(*digests, feature.alias("feature"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit_sources(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    form = docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(form))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_sets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_media_audio": op4_media_audio,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_url_filters": op8_url_filters,
    "op9_bpe": op9_bpe,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_set_join": op13_set_join,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_quality_rules": quality_rules.oracle(),
    "op8_url_filters": url_filter.oracle(),
    "op11_divergence_audit": divergence_audit.oracle(),
    "op12_periodic_runs": periodic_runs.ORACLE,
    "op13_set_join": set_join.ORACLE,
}
