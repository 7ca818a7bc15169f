"""A corpus pipeline of five stages over ``documents``. Belongs to the optional subpackage pricelens.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import decontam, linededup, quality, sentencepieces, simhash
from pricelens.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; nulls, repeated rows, empty tables and other columns as ``drop_rejected`` says."""
    return quality.drop_rejected(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that five or more of them share; n_chars, where there is one, follows the text.

    Null texts become empty, repeated rows stay, an empty table stays empty; other columns come through, whatever they are called.
    """
    kept = linededup.drop_shared_lines(docs, carry=[c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_chars")])
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; nulls, repeated rows, empty tables and other columns as ``one_of_each`` says."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; nulls, repeated rows, empty tables and other columns as ``drop_contaminated`` says."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of what is left, a row each, repeated ones too. Null text: no tokens. Other columns end here."""
    out = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: SQL cannot express robust outliers, SimHash components or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored in the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
