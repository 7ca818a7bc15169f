import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import negatives, quantised

NAN, INF = float("nan"), float("inf")


def brute_links(rows, threshold=0.95):
    """{row number: (links, least id reached)} by all pairs."""
    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    n = len(rows)
    near = [[j for j in range(n) if j != i and ok(rows[i][1]) and ok(rows[j][1]) and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return out


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, dims))
    x = centres[r.integers(0, len(centres), n)] + r.normal(size=(n, dims)) * r.choice([0.05, 0.15, 0.3, 1.0], (n, 1))
    return (x * r.uniform(0.01, 50, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("block", [None, 4096])
def test_links_equal_brute_force(spark, block):
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(clustered(700, 12, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in quantised.near_duplicates(df, block_bytes=block).collect()]
    assert sorted(got) == sorted(brute_links(rows))
    assert sum(r[1] > 0 for r in got) > 100


def test_small_blocks_with_very_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(quantised, "TILE", 16)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(clustered(400, 5, 6))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in quantised.near_duplicates(df, block_bytes=2000).collect()]
    assert sorted(got) == sorted(brute_links(rows))


def test_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(9, a), (3, a), (3, a), (5, b), (None, b), (1, None), (2, []), (4, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [NAN, 1.0, 1.0]), (8, [INF, 1.0, 1.0]),
            (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [1e-300, 2e-300, 3e-300]), (13, [-1.0, -2.0, -3.0]), (None, [5.0, 0.0, 0.0]), (14, [1e300, 2e300, 3e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS node", "1 AS copies", "2 AS h1", "'y' AS kept", "0 AS n_links")
    # brute force squares components: the same directions with components of about one
    tame = [(i, [x / max(v) for x in v] if i in (12, 14) else v) for i, v in rows]
    got = [tuple(r) for r in quantised.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted(brute_links(tame), key=repr)
    assert quantised.near_duplicates(df.limit(0)).count() == 0


def test_error_bound_holds():
    x = quantised.unit(clustered(300, 40, 7).astype(float))
    codes, scale, error = quantised.quantised(x)
    rough = scale[:, None] * scale[None] * (codes.astype(int) @ codes.astype(int).T)
    bound = (1 + error[:, None]) * error[None] + error[:, None]
    off = np.abs(rough - x @ x.T)
    assert (off <= bound).all() and bound.max() < 0.1 and off.max() > 1e-4
    assert (quantised._products(codes, codes) == codes.astype(int) @ codes.astype(int).T).all()
    long = np.full((2, 5000), 127, np.int8)
    assert (quantised._products(long, long) == 5000 * 127 * 127).all()


def brute_negatives(rows, anchor, low=50, high=95):
    out = []
    for i, label, v in rows:
        if not anchor(i):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j, l) for j, l, w in rows if j != i))
        positives = [(j, -s) for s, j, l in scored if l == label][:5]
        for p, ps in positives:
            found = [(j, -s) for s, j, l in scored if l != label and low * ps <= -100 * s <= high * ps][:3]
            out += [(i, p, k + 1, j, ps, s) for k, (j, s) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("dims,scale", [(3, 4), (24, 200), (70, 1 << 24)])
def test_negatives_equal_brute_force(spark, monkeypatch, dims, scale):
    monkeypatch.setattr(negatives, "STRIP", 64)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 8 * dims * 20)
    r = np.random.default_rng(dims)
    x = np.floor(r.normal(size=(500, 1)) * 0.3 * scale + r.normal(size=(500, dims)) * scale).astype(int)
    x[100:130] = x[0]  # ties
    rows = [(i, int(r.integers(0, 4)), [int(y) for y in x[i]]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    got = sorted(tuple(t) for t in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute_negatives(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_summaries_bound_the_product():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(40, 67)) + 1, r.normal(size=(50, 67)) * 3
    for (m, d), (n, e) in zip(negatives.summaries(x), negatives.summaries(y)):
        assert (np.abs(x @ y.T - m @ n.T) <= d @ e.T + 1e-9).all()
    assert len(negatives.summaries(x)) == 3 and negatives.summaries(x[:, :3]) == []


def test_large_products_are_exact():
    a = np.array([[(1 << 30) + 1, -(1 << 30)]])
    assert negatives.exact(a, a)[0, 0] == ((1 << 30) + 1) ** 2 + (1 << 60)
    assert negatives.exact(a, a, (np.array([0]), np.array([0])))[0] == ((1 << 30) + 1) ** 2 + (1 << 60)


def test_odd_rows_of_negatives(spark):
    rows = [(0, 1, [4, 0]), (1, 1, [4, 1]), (1, 1, [4, 1]), (2, 2, [3, 0]), (3, 2, [3, 0]), (4, 1, [1, 0]), (5, None, [9, 9]), (6, 2, None), (7, 2, [None, 1]), (None, 2, [3, 3]), (8, 2, [3, 0, 0]), (9, 2, []), (50, 3, [1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").selectExpr("*", "'x' AS block", "'y' AS chunk", "'z' AS is_anchor", "1 AS rank")
    got = sorted(tuple(t) for t in negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())
    # 0 has positives 1 (16) and 4 (4); 2 and 3 score 12 each; 50 has none
    assert got == [(0, 1, 1, 2, 16, 12), (0, 1, 2, 3, 16, 12), (0, 1, 3, 50, 16, 4)][:2]
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
