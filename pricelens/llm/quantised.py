"""Embedding near-duplicates (operator 11): int8 tile products with error bounds, full precision only where the bound leaves it open."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import settled
from .simhash import thinned

THRESHOLD = 0.95
#: Bytes of vectors in a block; a task holds two blocks. Vectors of a tile. Open pairs computed at a time.
BLOCK_BYTES, TILE, PAIRS = 32 << 20, 512, 1 << 18
#: The cut tree: about as many vectors it is fitted on, directions it cuts along, and most levels. It decides which block a vector is in, never what links.
SAMPLE, DIRECTIONS, LEVELS = 8_192, 8, 12
#: Least levels, so that small tables are dealt over several tasks too.
LEAST_LEVELS = 3


def usable(vector: Column) -> Column:
    """True for a vector of finite components that aren't all zero."""
    number = vector.cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(number, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of unit vectors: u = scale * codes + r, with codes of int8 and the length of r at most ``error``."""
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.sqrt(((u - scale[:, None] * codes) ** 2).sum(1)) + 1e-12
    return codes, scale, error


class CutTree:
    """A k-d tree of fixed depth over the leading principal directions of a bounded sample.

    The directions are orthonormal, so distances of projections are at most the distances of the vectors: boxes of
    projections that lie further apart than ``reach`` hold no pair that links.
    """

    def __init__(self, sample: np.ndarray, levels: int):
        u = unit(sample) if len(sample) else np.zeros((1, 1))
        _, _, axes = np.linalg.svd(u - u.mean(0), full_matrices=False)
        self.dims, self.axes, self.levels = u.shape[1], axes[:DIRECTIONS], levels
        self.axis, self.cut = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        p, node = u @ self.axes.T, np.ones(len(u), np.int64)
        for level in range(levels):
            for k in range(1 << level, 2 << level):
                mine = p[node == k]
                if len(mine):
                    self.axis[k] = np.argmax(mine.max(0) - mine.min(0))
                    self.cut[k] = np.median(mine[:, self.axis[k]])
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])

    def place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, projections) of unit vectors."""
        p, node = u @ self.axes.T, np.ones(len(u), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])
        return node - (1 << self.levels), p


def gap(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Distances between boxes of the first list (rows) and of the second (columns)."""
    apart = np.maximum(0, np.maximum(low2[None] - high[:, None], low[:, None] - high2[None]))
    return np.sqrt((apart ** 2).sum(2))


def reach(threshold: float) -> float:
    """Largest distance of two unit vectors with this cosine, and some room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6


class _Side:
    """The vectors of one block in tiles: neighbours along the directions stand together."""

    def __init__(self, node: np.ndarray, copies: np.ndarray, x: np.ndarray, p: np.ndarray):
        u = unit(x)
        order = self._sorted(p, np.arange(len(u)))
        self.node, self.copies, self.u, p = node[order], copies[order], u[order], p[order]
        codes, self.scale, self.error = quantised(self.u)
        self.starts = np.arange(0, len(u), TILE)
        self.low, self.high = np.minimum.reduceat(p, self.starts), np.maximum.reduceat(p, self.starts)
        self.codes, self.degree = codes, np.zeros(len(u), np.int64)

    def _sorted(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= TILE:
            return rows
        axis = np.argmax(p[rows].max(0) - p[rows].min(0))
        rows, half = rows[np.argsort(p[rows, axis], kind="stable")], (len(rows) // TILE + 1) // 2 * TILE
        return np.concatenate([self._sorted(p, rows[:half]), self._sorted(p, rows[half:])])

    def tile(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = slice(self.starts[at], self.starts[at] + TILE)
        return self.codes[s], self.scale[s], self.error[s]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: single precision holds sums of up to 1,024 products exactly, longer rows are cut."""
    out = a[:, :1024].astype(np.float32) @ b[:, :1024].astype(np.float32).T
    for k in range(1024, a.shape[1], 1024):
        out = out.astype(np.float64) + a[:, k: k + 1024].astype(np.float32) @ b[:, k: k + 1024].astype(np.float32).T
    return out


def open_pairs(left: _Side, right: _Side, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i of left, j of right) of all pairs whose cosine the error bounds don't put below ``threshold``.

    With u = s q + r and v = t w + z: u.v = s t (q.w) + s q.z + r.v, and the last two are at most |s q||z| + |r||v|
    <= (1 + |r|) |z| + |r|. A first test with the tile's largest scale and error costs one comparison a pair.
    """
    far = gap(left.low, left.high, right.low, right.high) > reach(threshold)
    for a in range(len(left.starts)):
        qa, sa, ea = left.tile(a)
        for b in np.flatnonzero(~far[a]):
            if same and b < a:
                continue
            qb, sb, eb = right.tile(b)
            products = _products(qa, qb)
            least = (threshold - (1 + ea) * eb.max() - ea - 1e-9) / (sa * sb.max())
            i, j = np.nonzero(products >= least[:, None])
            if same and a == b:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            likely = products[i, j] * sa[i] * sb[j] + (1 + ea[i]) * eb[j] + ea[i] >= threshold - 1e-9
            i, j = i[likely] + left.starts[a], j[likely] + right.starts[b]
            for k in range(0, len(i), PAIRS):
                yield i[k: k + PAIRS], j[k: k + PAIRS]


def _cell(pdf: pd.DataFrame, tree: CutTree, kind: str, threshold: float) -> pd.DataFrame:
    """One pair of blocks: (kind, x, y) with kind 0 = vector x has y links here, 1 = an edge of a forest over the links."""
    out = []
    for _, rows in pdf.groupby(pdf["vector"].str.len()):
        sides = []
        for _, part in rows.groupby("side"):
            x = np.frombuffer(b"".join(part["vector"]), kind).astype(np.float64).reshape(len(part), -1)
            p = unit(x) @ tree.axes.T if x.shape[1] == tree.dims else np.zeros((len(x), 1))
            sides.append(_Side(part["node"].to_numpy(), part["copies"].to_numpy(), x, p))
        if len(sides) == 1 and pdf["side"].nunique() == 2:
            continue
        left, right, same, ends = sides[0], sides[-1], len(sides) == 1, []
        for i, j in open_pairs(left, right, same, threshold):
            linked = (left.u[i] * right.u[j]).sum(1) >= threshold
            i, j = i[linked], j[linked]
            left.degree += np.bincount(i, right.copies[j], len(left.degree)).astype(np.int64)
            right.degree += np.bincount(j, left.copies[i], len(right.degree)).astype(np.int64)
            ends.append(thinned(left.node[i], right.node[j]))
            if sum(len(e[0]) for e in ends) > PAIRS:
                ends = [thinned(*map(np.concatenate, zip(*ends)))]
        for side in sides:
            some = side.degree > 0
            out.append(pd.DataFrame({"kind": 0, "x": side.node[some], "y": side.degree[some]}))
        if ends:
            a, b = thinned(*map(np.concatenate, zip(*ends)))
            out.append(pd.DataFrame({"kind": 1, "x": a, "y": b}))
    return pd.concat(out).astype("int64") if out else pd.DataFrame({"kind": [], "x": [], "y": []}, dtype="int64")


def _cells(tree: CutTree, blocks: np.ndarray, near: np.ndarray, kind: str):
    """Rows (node, copies, vector, leaf): each goes to the pair of its own block with every block of a near leaf."""
    first = np.cumsum(np.r_[0, blocks])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a block of its own leaf by number, so that a leaf of near copies is split evenly
            own = first[batch["leaf"]] + batch["node"].to_numpy() % blocks[batch["leaf"]]
            for leaf, rows in batch.assign(own=own).groupby("leaf"):
                partners = np.concatenate([np.arange(first[k], first[k + 1]) for k in np.flatnonzero(near[leaf])])
                for at in range(0, len(rows), max(1, (1 << 16) // len(partners))):
                    part = rows.iloc[at: at + max(1, (1 << 16) // len(partners))]
                    mine, other = np.repeat(part["own"].to_numpy(), len(partners)), np.tile(partners, len(part))
                    yield pd.DataFrame({
                        "cell": (np.minimum(mine, other) << 31) | np.maximum(mine, other), "side": (mine > other).astype(np.int8),
                        "node": np.repeat(part["node"].to_numpy(), len(partners)), "copies": np.repeat(part["copies"].to_numpy(), len(partners)),
                        "vector": np.repeat(part["vector"].to_numpy(), len(partners))})

    return run


def _leaves(tree: CutTree, kind: str):
    """Adds the leaf, the projections and the bytes of the vector; vectors of another length than the sample's have the last leaf."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            other, size = 1 << tree.levels, batch["vector"].map(len)
            leaf, p = np.full(len(batch), other, np.int64), np.zeros((len(batch), len(tree.axes)))
            fits = (size == tree.dims).to_numpy()
            if fits.any():
                leaf[fits], p[fits] = tree.place(unit(np.stack(batch["vector"][fits]).astype(np.float64)))
            yield pd.DataFrame({"node": batch["node"], "copies": batch["copies"], "leaf": leaf, "p": list(p),
                                "vector": [np.asarray(v, kind).tobytes() for v in batch["vector"]]})

    return run


def links(nodes: DataFrame, threshold: float = THRESHOLD, block_bytes: int | None = None) -> DataFrame:
    """(kind, x, y) over ``nodes`` (node, copies, vector): kind 0 gives numbers of links to sum per node, kind 1 edges that connect
    all nodes with cosine at least ``threshold``.

    Vectors go to the leaves of a cut tree; a leaf of more than a block is split into several. Two leaves meet unless their boxes
    of projections are too far apart; a task multiplies one pair of blocks, tile by tile, skipping tiles whose boxes are too far
    apart. A row is written once per near block, so the shuffle grows with rows times blocks (a block is BLOCK_BYTES of vectors);
    products are as many as pairs of near tiles, quadratic where the boxes exclude nothing.
    """
    kind = "<f4" if dict(nodes.dtypes)["vector"] == "array<float>" else "<f8"
    n = nodes.count()
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n))) < SAMPLE).select("vector").toPandas()["vector"]
    usual = sample.map(len).mode()
    dims = int(usual.iloc[0]) if len(usual) else 1
    held = max(TILE, (block_bytes or BLOCK_BYTES) // (dims * int(kind[-1])))
    levels = int(np.clip(math.ceil(math.log2(max(1, n) / held)) if n > held else 0, LEAST_LEVELS, LEVELS))
    tree = CutTree(np.stack([np.asarray(v, np.float64) for v in sample if len(v) == dims]) if len(sample) else np.zeros((0, dims)), levels)
    placed = settled(nodes.select("node", "copies", "vector").mapInPandas(_leaves(tree, kind), "node long, copies long, leaf int, p array<double>, vector binary"))
    k = len(tree.axes)
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *(f(F.get("p", F.lit(d))).alias(f"{f.__name__}{d}") for d in range(k) for f in (F.min, F.max))).toPandas()
    # at most 4,097 rows, whatever the input
    leaves = (1 << levels) + 1
    blocks, low, high = np.zeros(leaves, np.int64), np.zeros((leaves, k)), np.zeros((leaves, k))
    blocks[boxes["leaf"]] = -(-boxes["n"] // held)
    for d in range(k):
        low[boxes["leaf"], d], high[boxes["leaf"], d] = boxes[f"min{d}"], boxes[f"max{d}"]
    near = (gap(low, high, low, high) <= reach(threshold)) & (blocks > 0)[None]
    near[-1, :-1] = near[:-1, -1] = False
    cells = placed.select("node", "copies", "vector", "leaf").mapInPandas(
        _cells(tree, np.maximum(blocks, 1), near, kind), "cell long, side byte, node long, copies long, vector binary")
    return cells.groupBy("cell").applyInPandas(lambda pdf: _cell(pdf, tree, kind, threshold), "kind long, x long, y long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block_bytes: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many other vectors have a cosine of at least ``threshold`` with it, the
    smallest id that it reaches by such links, and whether that is its own.

    Vectors that are null, empty or zero or hold null or infinite components or NaN link with nothing; neither do vectors of
    different lengths. Equal vectors are one node and link with each other. Null ids are linked, but never name a component unless
    it has no other (then null, not kept). Repeated rows are rows of their own. Empty table: empty result. Other columns are ignored.
    """
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    ok = usable(F.col("vector"))
    keys = (F.xxhash64(F.lit(1), "vector"), F.xxhash64(F.lit(2), "vector"))
    used = given.where(ok).select("vec_id", "vector", keys[0].alias("h1"), keys[1].alias("h2"))
    distinct = used.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.any_value("vector").alias("vector"))
    nodes = settled(distinct.withColumn("node", F.monotonically_increasing_id()))
    found = settled(links(nodes, threshold, block_bytes))
    degree = found.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("degree"))
    edges = found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))
    stars = edges.select(F.col("a").alias("row"), F.col("b").alias("key")).unionByName(edges.select(F.col("b").alias("row"), F.col("b").alias("key")))
    roots = components(stars, "row", "key").select(F.col("row").alias("node"), F.col("component").alias("root"))
    rooted = nodes.select("node", "h1", "h2", "copies", "least").join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = settled(named.select("h1", "h2", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = used.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = given.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
