"""One query for each operator of the training-data pipeline, and SQL where SQL can express it.

A query reads whole tables, applies its operator with production parameters and
derives the columns that are compared elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, langid, packing, pii, quality_rules, simhash, suffix_dedup, toxicity, warc
from .common import crc_mod, table


def held_out(mod: int, remainder: int):
    """Whether a document may not be learned from; one without an id is not held out (it is not learned from where ids are needed)."""
    return F.coalesce(crc_mod("doc_id", mod) == remainder, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a field that has seen no document with remainder 2."""
    docs = table(spark, sf_dir, "documents")
    found = langid.with_language(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte windows of documents with smaller ids."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50, keep_bytes=False).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back, and report each record."""
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, counted, digested and listed."""
    d = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ranks = "array('" + "', '".join(pii.BASE) + "')"
    shown = lambda x: f"concat({x}.kind, ':', {x}.start, ':', {x}.end)"
    base = f"array_join(transform(filter(pii, x -> array_contains({ranks}, x.kind)), x -> {shown('x')}), ',')"
    return d.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE),
        F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(pii, x -> {shown('x')}), ',')").alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a machine that has seen no document with remainder 0."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.with_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and the learned list's verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    q = quality_rules.apply_rules(docs, rules)
    return q.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_decontamination, op4_warc, op5_packing, op6_pii, op7_toxicity, op8_simhash, op9_html_text, op10_quality_rules)}
ORACLE_SQL = {"op3_decontamination": decontam.SQL}
