"""SimHash near-duplicates (operator 3): candidates by pigeonring filtering over the segments of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import fresh, settled

SHINGLE, BITS_APART, SEED = 4, 4, 42
#: Widths of the segments on the ring; one more than the bits apart, so that a chain of n segments may differ in n * 4 / 5 bits.
WIDTHS = (13, 13, 13, 13, 12)
M = len(WIDTHS)
OFFSETS = np.cumsum((0, *WIDTHS[:-1])).tolist()
BUDGETS = [(n * BITS_APART) // M for n in range(1, M + 1)]  # 0, 1, 2, 3, 4
#: Pairs compared at a time, and edges held before they are thinned.
PAIRS, EDGES = 1 << 20, 1 << 18
#: Fingerprints of a bucket that one task takes as its index; a larger bucket is dealt over several tasks.
BLOCK = 20_000


def fingerprint(text: str) -> int:
    """64 bits: bit k is set if it is in over half the shingles' XXH64 (seed 42). No words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, n, digest, seed = np.zeros(64, np.int64), len(words) - SHINGLE + 1, xxhash.xxh64_intdigest, SEED
    for at in range(0, n, 1 << 16):
        part = words[at: at + (1 << 16) + SHINGLE - 1]
        h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[k:] for k in range(SHINGLE))))], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every whole text, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or "") for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(OFFSETS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def _mask(ring: int, n: int) -> int:
    return sum(((1 << WIDTHS[i % M]) - 1) << OFFSETS[i % M] for i in range(ring, ring + n))


MASKS = np.array([[_mask(r, n) for n in range(1, M + 1)] for r in range(M)], np.uint64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fingerprint and start on the ring: an index row under the first two segments, and a probe under each key that has
    one more bit set in the second segment. Two fingerprints whose chain of two segments is within its budget (first equal,
    second at most one bit apart) so meet under exactly one key per start."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(fp), 50_000):
            part, keys, kinds, fps = fp[start: start + 50_000], [], [], []
            for r in range(M):
                a, b = _segment(part, r), _segment(part, (r + 1) % M)
                head = (np.uint64(r) << np.uint64(32)) | (a << np.uint64(13))
                keys.append(head | b)
                kinds.append(np.zeros(len(part), np.int8))
                fps.append(part)
                for t in range(WIDTHS[(r + 1) % M]):
                    clear = (b >> np.uint64(t)) & np.uint64(1) == 0
                    keys.append((head | b)[clear] | np.uint64(1 << t))
                    kinds.append(np.ones(len(keys[-1]), np.int8))
                    fps.append(part[clear])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(fps).view(np.int64))], names=["key", "probe", "fp"])


def thinned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the smallest node that it is connected with: as many as nodes at most, the same components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, probe): pairs of each bucket, chain by chain, then the full distance; what links is thinned before it leaves."""
    held_a, held_b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def buckets() -> Iterator[tuple[np.ndarray, ...]]:
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            now = now if rest is None else tuple(map(np.concatenate, zip(rest, now)))
            cut = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))
            if len(cut):
                yield tuple(x[: cut[-1] + 1] for x in now)
                rest = tuple(x[cut[-1] + 1:] for x in now)
            else:
                rest = now
        if rest is not None and len(rest[0]):
            yield rest

    for key, block, probe, fp in buckets():
        fp = fp.view(np.uint64)
        first = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        index = np.add.reduceat((probe == 0).astype(np.int64), np.flatnonzero(first))[np.cumsum(first) - 1]
        # a row meets the index rows before it in its bucket
        meets = np.minimum(np.arange(len(key)) - start, index)
        done = np.cumsum(meets)
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            n = meets[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + start[left]
            x, ring = fp[left] ^ fp[right], (key[left] >> 32).astype(np.int64)
            near = np.flatnonzero(x != 0)
            for chain in range(2, M):  # three, four, all segments
                near = near[np.bitwise_count(x[near] & MASKS[ring[near], chain]) <= BUDGETS[chain]]
            held_a, held_b = np.concatenate([held_a, fp[left[near]]]), np.concatenate([held_b, fp[right[near]]])
            if len(held_a) > EDGES:
                held_a, held_b = thinned(held_a, held_b)
                if len(held_a) > EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held_a.view(np.int64)), pa.array(held_b.view(np.int64))], names=["a", "b"])
                    held_a, held_b = held_a[:0], held_b[:0]
            at = to
    if len(held_a):
        held_a, held_b = thinned(held_a, held_b)
        yield pa.RecordBatch.from_arrays([pa.array(held_a.view(np.int64)), pa.array(held_b.view(np.int64))], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges among the distinct fingerprints ``fps`` (fp) that connect all those at most four bits apart.

    Pigeonring: if two fingerprints differ in at most 4 bits, then from some segment on every chain of n consecutive
    segments differs in at most n * 4 / 5 bits. The chain of two is the join key; the longer ones prune pairs before the
    full distance. Keys are sorted, not collected, and pairs are made a million at a time; a task gives out at most one edge
    per fingerprint and thinning, never all pairs of a bucket. A bucket of over BLOCK index rows is dealt: each of its blocks
    meets all of the bucket's rows, in a task of its own.
    """
    rows = fps.select("fp").mapInArrow(_keys, "key long, probe byte, fp long")
    hot = fps.select(F.explode(F.array(*[_native_key(r) for r in range(M)])).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    hot = settled(hot)
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # elsewhere than in its own block a row is a probe only; each pair of index rows is then met once or twice, never missed
        rows = dealt.select("key", "block", F.when(F.col("block") == own, F.col("probe")).otherwise(1).cast("byte").alias("probe"), "fp")
    else:
        rows = rows.select("key", F.lit(0).alias("block"), "probe", "fp")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "probe").mapInArrow(_links, "a long, b long")


def _native_key(r: int):
    def seg(i: int):
        return F.shiftrightunsigned("fp", OFFSETS[i]).bitwiseAND((1 << WIDTHS[i]) - 1)

    return F.lit(r << 32).cast("long").bitwiseOR(F.shiftleft(seg(r), 13)).bitwiseOR(seg((r + 1) % M))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): every document's SimHash and the smallest doc_id that it reaches over links of at most four differing bits.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are four words (a shorter text is one shingle).
    Null or empty text: fingerprint 0, linked like any other. Equal fingerprints are one node, so copies cost one row per
    task. Null doc_id: linked, but never a component's id unless it is all that the component has. Repeated rows stay.
    Empty table: empty result. Other columns are ignored.
    """
    fps = settled(fingerprints(docs, id_col, text_col))
    nodes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = settled(links(nodes).distinct())
    stars = edges.select(F.col("a").alias("row"), F.col("b").alias("key")).unionByName(edges.select(F.col("b").alias("row"), F.col("b").alias("key")))
    roots = components(stars, "row", "key").select(F.col("row").alias("fp"), F.col("component").alias("root"))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = settled(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever these are called, whose doc_id is its component's.

    Rows without a doc_id stay. Null and empty texts are near copies of each other. Repeated rows of the doc_id that stays all stay.
    Empty table: empty result.
    """
    name = fresh(docs, "_gone")
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
