"""Token counts (operator 4): an exact histogram of encoded lengths, whose suffix sums answer for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Lengths whose sums are first added up among themselves.
BLOCK = 1024

_LOADED: dict[str, object] = {}


def encoding(rank_file: str, pattern: str):
    """A byte-level merge vocabulary from a rank file, once per worker."""
    if rank_file not in _LOADED:
        import tiktoken

        with open(rank_file, "rb") as lines:  # a tokenizer installed with every executor, not data
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[rank_file] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[rank_file]


def lengths(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length): tokens of every whole text; null and empty texts have none. Repeated rows stay, other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "length"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, length long")


def histogram(measured: DataFrame) -> DataFrame:
    """(length, n_docs, n_tokens, docs_longer, tokens_longer, truncated_tokens, share_within) per distinct length, each also a context limit.

    docs_longer and tokens_longer: documents over the limit and their tokens; truncated_tokens: all tokens if every
    document were cut at the limit; share_within: the part of the documents that fit, so quantiles are read off. One
    aggregation with map-side combine leaves a row per distinct length; suffix sums are taken within blocks of 1,024
    lengths and over the blocks' sums, so no task holds the whole histogram. Null lengths are left out. Empty table: empty result.
    """
    hist = measured.where("length is not null").groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    hist = settled(hist)  # used twice below; the encoding isn't to run twice
    hist = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_block", F.floor(F.col("length") / BLOCK))
    blocks = hist.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    after = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("_block", zero(F.sum("_d").over(after)).alias("_d"), zero(F.sum("_t").over(after)).alias("_t"),
                           F.sum("_d").over(whole).alias("_docs"), F.sum("_t").over(whole).alias("_tokens"))
    above = Window.partitionBy("_block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    out = hist.join(blocks, "_block").withColumn("docs_longer", F.col("_d") + zero(F.sum("n_docs").over(above))).withColumn(
        "tokens_longer", F.col("_t") + zero(F.sum("n_tokens").over(above)))
    return out.select(
        "length", "n_docs", "n_tokens", "docs_longer", "tokens_longer",
        (F.col("_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("_docs") - F.col("docs_longer")) / F.col("_docs")).alias("share_within"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the least length within which a share ``q`` of the documents lies."""
    return hist.where(F.col("share_within") >= q).agg(F.min("length").alias("length"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: all tokens if every document were cut at any ``limit``, also one that no document's length equals."""
    return hist.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))
