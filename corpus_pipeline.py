"""A corpus from raw documents to tokens, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the
stage before kept.  All but the last return the columns of ``documents``, and other
columns of these, whatever their names, don't come through.

In every stage a null text counts as an empty one (and is empty in what the
substring stage returns); rows without doc_id are left out.  Repeated rows of one
doc_id are judged alike: they all stay or all go.  Texts that the substring stage
empties stay as empty documents.  An empty table gives an empty table.  Ties go to
the smaller doc_id.  Labels or benchmark items that are absent reject nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import byte_bpe, decontaminate, near_copies, quality, substring_dedup
from canvass.llm.common import Scratch, read, released

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=COLUMNS[1:])
    return scored.where("score >= 0.5").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of
    0.8 or more; proposed by SimHash and by rare shingles, decided by whole sets)
    the document with the smallest doc_id stays."""
    first = near_copies.near_copies(docs, width=5).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 13-word windows that a document with a smaller doc_id has too."""
    kept = substring_dedup.remove_repeats(docs, window=13, keep=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with released():
            before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs


#: The quality classifier and the latent-semantic search can't be put in SQL;
#: tests hold the pipeline against a brute-force version instead.
ORACLE_SQL = None
