"""The operators over their whole tables, as the driver runs them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import alignment, byte_bpe, chat_format, decontaminate, hnsw, language, oracles, packing, periodic_runs, quality, simhash, substring_dedup, suffix_dedup, toxicity
from canvass.llm.common import read
from canvass.llm.samples import fold


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _predicted(scores: DataFrame, parts: int, held_out: int) -> DataFrame:
    return scores.select("doc_id", (fold(parts) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), parts=3, held_out=1)
    return _predicted(quality.score(docs, model), 3, 1)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_format.turns_as_messages(read(spark, sf_dir, "conversations"))
    placed = chat_format.ordered(chat_format.link(messages, chat_format.REPLY))
    return placed.select("conv_id", "place", "position", "call_id", "depth", "status", "n_results", F.array_join("errors", "; ").alias("errors"), "json")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    network = toxicity.fit(docs, read(spark, sf_dir, "labels"), parts=5, held_out=0)
    return _predicted(toxicity.score(docs, network), 5, 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=13)
    words = F.trim(F.regexp_replace("kept", r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs, parts=4, held_out=2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, most=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096)
    return packing.pack(pieces, capacity=4096)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(read(spark, sf_dir, "documents"), change=periodic_runs.planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_byte_bpe, op3_quality, op4_chat_format, op5_toxicity, op6_substring_dedup, op7_hnsw, op8_language, op9_decontaminate, op10_simhash, op11_best_fit_packing, op12_alignment, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": oracles.SUFFIX_DEDUP, "op4_chat_format": oracles.CHAT_FORMAT, "op6_substring_dedup": oracles.SUBSTRING_DEDUP}
