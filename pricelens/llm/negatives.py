"""Hard-negative mining (operator 13): inner products bounded by segment summaries, refined before exact scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored

POSITIVES, NEGATIVES = 5, 3
#: Segments a vector is cut into, coarse to fine; a level finer than the vector is left out.
SEGMENTS = (4, 16, 32)
#: Bytes of anchors in a task, rows that one task scores them against, rows of one product, least number of row chunks.
ANCHOR_BYTES, CHUNK, STRIP, LEAST_CHUNKS = 32 << 20, 1 << 18, 1024, 12
#: Share of pairs left open above which the next level is computed as one product for all of them.
DENSE = 0.125


def usable(vector: Column) -> Column:
    """True for a vector without null, infinite or NaN components."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x)."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level (means, deviations) of a vector's segments, both times the square root of a segment's length.

    So the product of two vectors is the product of their means, plus or minus at most the product of their deviations.
    """
    out = []
    for count in SEGMENTS:
        if count >= x.shape[1]:
            break
        starts = np.arange(count) * x.shape[1] // count
        size = np.diff(np.r_[starts, x.shape[1]])
        mean = np.add.reduceat(x, starts, axis=1) / size
        spread = (x - np.repeat(mean, size, axis=1)) ** 2
        out.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(spread, starts, axis=1))))
    return out


def exact(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Integer products of rows of ``a`` and ``b``: all of them, or of the pairs given. Doubles while they hold every partial sum."""
    largest = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[1])
    kind = np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object
    if pairs is None:
        out = a.astype(kind) @ b.astype(kind).T
    else:
        out = (a[pairs[0]].astype(kind) * b[pairs[1]].astype(kind)).sum(1)
    return out.astype(np.int64)


class Strip:
    """Rows (or anchors) of one length with their summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x, self.levels = ids, labels, x, summaries(x.astype(np.float64))


def survivors(anchors: Strip, rows: Strip, open_: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs marked in ``open_`` whose score is from ``least`` to ``most`` of its anchor.

    Level by level the bounds close pairs; while many are open a level is one matrix product, later it is computed for the
    open pairs alone. What no level closes is scored exactly.
    """
    i = j = None
    for (ma, da), (mb, db) in zip(anchors.levels, rows.levels):
        if i is None:
            mean, spread = ma @ mb.T, da @ db.T
            slack = 1e-9 * (np.abs(mean) + spread) + 1e-6
            open_ = open_ & (mean + spread + slack >= least[:, None]) & (mean - spread - slack <= most[:, None])
            if open_.mean() <= DENSE:
                i, j = np.nonzero(open_)
        else:
            mean, spread = (ma[i] * mb[j]).sum(1), (da[i] * db[j]).sum(1)
            slack = 1e-9 * (np.abs(mean) + spread) + 1e-6
            left = (mean + spread + slack >= least[i]) & (mean - spread - slack <= most[i])
            i, j = i[left], j[left]
    if i is None:
        score = exact(anchors.x, rows.x)
        i, j = np.nonzero(open_ & (score >= least[:, None]) & (score <= most[:, None]))
        return i, j, score[i, j]
    score = exact(anchors.x, rows.x, (i, j))
    left = (score >= least[i]) & (score <= most[i])
    return i[left], j[left], score[left]


class Best:
    """The first ``k`` (score descending, id ascending) of each of n lists."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.at, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: A new entry below this can't be among the first k.
        self.least = np.full(n, -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ident = np.r_[self.at, at], np.r_[self.score, score], np.r_[self.id, ident]
        order = np.lexsort((ident, -score, at))
        at, score, ident = at[order], score[order], ident[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        kept = rank < self.k
        self.at, self.score, self.id = at[kept], score[kept], ident[kept]
        full = rank == self.k - 1
        self.least[at[full]] = score[full]


INFINITE = np.iinfo(np.int64).max


def _strips(part: pd.DataFrame) -> Iterator[Strip]:
    for at in range(0, len(part), STRIP):
        rows = part.iloc[at: at + STRIP]
        yield Strip(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), np.stack(rows["vector"]).astype(np.int64).reshape(len(rows), -1))


def _sides(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(anchors, rows) of a cell, by length of their vectors."""
    for _, part in pdf.groupby(pdf["vector"].map(len)):
        anchors, rows = part[part["is_anchor"]], part[~part["is_anchor"]]
        if len(anchors) and len(rows):
            yield anchors, rows


def _positives(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for ours, rows in _sides(pdf):
        for anchors in _strips(ours):
            best = Best(len(anchors.ids), POSITIVES)
            for strip in _strips(rows):
                may = (anchors.labels[:, None] == strip.labels[None]) & (anchors.ids[:, None] != strip.ids[None])
                i, j, score = survivors(anchors, strip, may, best.least, np.full(best.n, np.inf))
                best.add(i, score, strip.ids[j])
            out.append(pd.DataFrame({"anchor_id": anchors.ids[best.at], "positive_id": best.id, "positive_score": best.score}))
    return pd.concat(out).astype("int64") if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype="int64")


def _negatives(low: int, high: int):
    """Negatives of the anchor's positives; positive p takes scores with low * p <= 100 * score <= high * p."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ours, rows in _sides(pdf):
            ours = ours[ours["positives"].map(len) > 0]
            for at in range(0, len(ours), STRIP):
                part = ours.iloc[at: at + STRIP]
                anchors = next(_strips(part))
                sizes = part["positives"].map(len).to_numpy()
                # one list per (anchor, positive), the lists of an anchor side by side
                owner = np.repeat(np.arange(len(part)), sizes)
                ids = np.array([p["positive_id"] for ps in part["positives"] for p in ps], np.int64)
                score = [int(p["positive_score"]) for ps in part["positives"] for p in ps]
                floor_, ceil_ = np.array([-(-low * s // 100) for s in score], np.int64), np.array([high * s // 100 for s in score], np.int64)
                first, best = np.r_[0, np.cumsum(sizes)[:-1]], Best(len(ids), NEGATIVES)
                for strip in _strips(rows):
                    least = np.minimum.reduceat(np.where(floor_ <= ceil_, np.maximum(floor_, best.least), np.inf), first)
                    most = np.maximum.reduceat(np.where(floor_ <= ceil_, ceil_, -np.inf), first)
                    i, j, found = survivors(anchors, strip, anchors.labels[:, None] != strip.labels[None], least, most)
                    # to each list of its anchor
                    times = sizes[i]
                    to = np.repeat(first[i], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    j, found = np.repeat(j, times), np.repeat(found, times)
                    fits = (found >= floor_[to]) & (found <= ceil_[to]) & (found >= best.least[to])
                    best.add(to[fits], found[fits], strip.ids[j[fits]])
                out.append(pd.DataFrame({"anchor_id": anchors.ids[owner[best.at]], "positive_id": ids[best.at], "negative_id": best.id,
                                         "positive_score": np.array(score, np.int64)[best.at], "negative_score": best.score}))
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pd.concat(out).astype("int64") if out else pd.DataFrame({k: [] for k in names}, dtype="int64")

    return run


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """Every block of anchors with every chunk of rows, as groups (block, chunk); ``anchors`` has one column more than ``rows``."""
    a = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    r = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = a.withColumn("is_anchor", F.lit(True)).unionByName(r.withColumn("is_anchor", F.lit(False)), allowMissingColumns=True)
    return both.repartition(min(blocks * chunks, 4096), "block", "chunk").groupBy("block", "chunk")


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label", low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows of integer vectors (see ``integers``).

    Scores are inner products. ``is_anchor`` marks anchors, in terms of the column ``vec_id``. An anchor's positives are its first
    five other rows of the same label; the negatives of a positive with score p are the first three rows of other labels with
    low * p <= 100 * score <= high * p. First means higher score, then smaller id.

    Blocks of anchors (ANCHOR_BYTES) meet chunks of rows (CHUNK): an anchor is written once per chunk and a row once per block,
    a task keeps a few candidates per anchor, and these are merged per anchor, so no label and no anchor is one task's work.

    Rows without id, label or vector, or with a null component, take no part. Rows that repeat an id count once, as the least
    (label, vector). Vectors of different lengths have no score. Empty table or no anchors: empty result. Other columns are ignored.
    """
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("vector"))
    given = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    once = given.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v")).select("vec_id", "v.label", "v.vector")
    every = stored(once)
    anchors = every.where(is_anchor)
    n, (m, width) = every.count(), anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    blocks = max(1, math.ceil(m * 8 * max(1, width) / ANCHOR_BYTES))
    chunks = max(LEAST_CHUNKS, math.ceil(n / CHUNK))

    def first(found: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), ident)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = _meet(anchors, every, blocks, chunks).applyInPandas(_positives, "anchor_id long, positive_id long, positive_score long")
    positives = first(found, ["anchor_id"], "positive_score", "positive_id", POSITIVES)
    positives = settled(positives.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))
    asking = anchors.join(positives.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _meet(asking, every, blocks, chunks).applyInPandas(
        _negatives(low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    best = first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
