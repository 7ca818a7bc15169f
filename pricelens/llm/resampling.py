"""Importance resampling towards a target distribution (operator 12): hashed n-gram features over a head-tail vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Words and pairs of the head, and the longest word in it (bytes): they bound what is broadcast, all other features are hashed directly.
HEAD, HEAD_PAIRS, LONGEST = 65_536, 65_536, 64
#: Different words and pairs counted in a task before it hands them on.
HELD = 1 << 18
#: Bytes 0-9, a-z and all of 0x80 on are word characters, A-Z are lower-cased, all others part words.
_TABLE = bytes((k if chr(k) in "0123456789abcdefghijklmnopqrstuvwxyz" or k >= 128 else k + 32 if 65 <= k <= 90 else 32) for k in range(256))
#: Words looked at together, so that a very long text isn't held as one list.
PART = 1 << 16


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return (text or b"").translate(_TABLE).split()


class States(dict):
    """CRC states by word; a word outside the head is hashed when asked for and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class Pairs(dict):
    """Buckets by pair; a pair outside the head continues the CRC state of its first word."""

    def __init__(self, items: dict[tuple[bytes, bytes], int] | tuple = (), states: States | None = None, buckets: int = BUCKETS):
        super().__init__(items)
        self.states, self.buckets = states, buckets

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(pair[1], crc32(b" ", self.states[pair[0]])) % self.buckets


class Vocabulary:
    """Buckets of the runs of 1 to ``longest`` words: frequent words bring their CRC state, frequent pairs their bucket."""

    def __init__(self, states: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], longest: int = 1, buckets: int = BUCKETS):
        self.states, self.longest, self.buckets = States(states), longest, buckets
        self.pairs = Pairs(pairs, self.states, buckets)

    def of(self, ws: list[bytes]) -> Iterator[np.ndarray]:
        """Buckets of all features of a text's words, in parts."""
        for at in range(0, len(ws), PART):
            part = ws[at: at + PART]
            yield np.fromiter(map(self.states.__getitem__, part), np.int64, len(part)) % self.buckets
            if self.longest > 1:
                after = ws[at + 1: at + 1 + PART]
                yield np.fromiter(map(self.pairs.__getitem__, zip(part, after)), np.int64, min(len(part), len(after)))
            for n in range(3, self.longest + 1):
                runs = zip(*(ws[at + k: at + k + PART] for k in range(n)))
                yield np.array([crc32(b" ".join(run)) % self.buckets for run in runs], np.int64)


def frequent(texts: DataFrame, pairs: bool, head: int, longest: int = LONGEST) -> list[tuple[bytes, ...]]:
    """The words (or pairs of neighbouring words) of the column ``text`` that make up at least one in ``head`` of all, so ``head`` at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                ws = words(text.as_py())
                for at in range(0, len(ws), PART):
                    part = ws[at: at + PART]
                    seen.update(map(b" ".join, zip(part, ws[at + 1: at + 1 + PART])) if pairs else part)
                    if len(seen) > HELD:
                        yield flushed()
        if seen:
            yield flushed()

    counted = settled(texts.mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    short = F.octet_length("feature") <= (2 * longest if pairs else longest)
    # at most ``head`` features can have this share
    return [tuple(bytes(r[0]).split(b" ")) for r in counted.where(short & (F.col("n") * head >= total)).select("feature").collect()]


def vocabulary(texts: DataFrame, longest: int, buckets: int, head: int = HEAD, head_pairs: int = HEAD_PAIRS) -> Vocabulary:
    """The head of ``texts``: at most ``head`` words and ``head_pairs`` pairs, each of bounded length."""
    states = {w: crc32(w) for (w,) in frequent(texts, False, head)}
    pairs = {p: crc32(b" ".join(p)) % buckets for p in frequent(texts, True, head_pairs)} if longest > 1 else {}
    return Vocabulary(states, pairs, longest, buckets)


def bucket_totals(texts: DataFrame, voc: Vocabulary) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket; one row per bucket and task crosses the network."""
    shared = texts.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros(v.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in v.of(words(text.as_py())):
                    total += np.bincount(found, minlength=v.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(voc.buckets, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed bucket shares, target against source, rounded down."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + k) / (float(a + 1) * float(t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, voc: Vocabulary, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((voc, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, g = shared.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column(1)):
                ws = words(text.as_py())
                out[0, row] = len(ws)
                for found in v.of(ws):
                    out[1, row] += len(found)
                    out[2, row] += g[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(ident: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the first eight hex digits of the SHA-256 of ``seed:id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place, from 1, in a total order: sorted by ranges, numbered within, plus the rows of earlier ranges."""
    cut = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = cut.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per task
    before = sizes.withColumn("_before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).select("_part", "_before")
    placed = cut.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row: its importance weight, that plus Gumbel noise, and its place
    among the drawn, null if it isn't drawn. ``percent`` of the rows with at least ``least_words`` words are drawn.

    Features are the runs of 1 to ``longest`` words, hashed into buckets by CRC-32. The most frequent words and pairs are counted
    over all of ``docs`` and broadcast with their CRC states and buckets; the rest continue or compute the CRC. ``target`` is any
    table of texts, read by as many tasks as it has splits.

    Null or empty text: no words, weight 0, never drawn. Null doc_id: noise of the empty id, after all others among ties. Repeated
    rows are rows of their own, with neighbouring ranks. Empty ``docs``: empty result; empty ``target``: weights from the smoothing
    alone. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    wanted = target.select(F.col(text_col).cast("binary").alias("text"))
    voc = vocabulary(rows.select("text"), longest, buckets)
    gain = gains(bucket_totals(rows.select("text"), voc), bucket_totals(wanted, voc))
    scored = stored(weighed(rows, voc, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    may = scored.where(F.col("n_words") >= least_words)
    drawn = may.count() * percent // 100
    placed = ranked(may, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return placed.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
