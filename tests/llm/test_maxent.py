import math
import re
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from pricelens.llm import maxent

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learn_from():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


def brute(texts, learn):
    toks = {i: WORD.findall((t or "").translate(LOW)) + [None] for i, t in texts}
    c = Counter()
    for (i, _), n in Counter(texts).items():
        for _ in range(n if i in learn else 0):
            c.update(toks[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in toks.items()}


def test_base(spark, hard, texts, empty):
    learn = {r["doc_id"] for r in hard.where(learn_from()).select("doc_id").collect()}
    want = brute(texts, learn)
    rows = maxent.score(hard, learn_from()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-6 * max(1, -base)
        assert math.isfinite(r["score"]) and r["score"] <= 1e-9
    assert maxent.score(empty, learn_from()).count() == 0
    nothing = maxent.score(hard, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)


def test_beats_the_base_on_texts_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = maxent.score(docs, learn_from()).where(~learn_from()).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.2 * held[2]  # a fifth of a decade per token


def by_hand(v, flat, tails, totals, counts):
    """(probability of a token after two tokens) in plain Python, from the weights."""
    index, size = {w: k for k, w in enumerate(v.words)}, maxent.sizes(v.rows)[0]
    cls, word = flat[:size].reshape(-1, maxent.CLASSES).astype(float), flat[size:].reshape(-1, maxent.WIDTH).astype(float)
    last, mask = maxent.CLASSES - 1, (1 << 64) - 1

    def symbol(w):
        return maxent.BEGIN if w is None else index[w] if index.get(w, maxent.HEAD) < maxent.HEAD else maxent.HEAD + zlib.crc32(w[-2:]) % maxent.ENDINGS

    def place(x):
        return ((x * 0x9E3779B97F4A7C15 & mask) >> 36) % v.rows

    def softmax(x):
        e = [math.exp(y - max(x)) for y in x]
        return [y / sum(e) for y in e]

    def probability(two, one, w):
        a, b = symbol(one), symbol(two)
        p = softmax((cls[0] + cls[1 + a] + cls[1 + maxent.SYMBOLS + b] + cls[1 + 2 * maxent.SYMBOLS + place(a * maxent.SYMBOLS + b)]).tolist())
        k = index.get(w, maxent.HEAD)
        if k < maxent.HEAD:
            c = k // maxent.WIDTH
            return p[c] * softmax((word[c] + word[maxent.CLASSES - 1 + place(a * maxent.CLASSES + c)]).tolist())[k % maxent.WIDTH]
        if w not in counts:
            return p[last] * v.unknown()
        c = zlib.crc32(w[-3:]) % v.tails
        return p[last] * (1 - v.unknown()) * math.exp(tails[a, c]) * counts[w] / totals[c]

    return probability


def test_scores_equal_the_model_by_hand(spark, monkeypatch):
    monkeypatch.setattr(maxent, "KNOWN", 2200)
    rng = np.random.default_rng(4)
    draw = lambda n: " ".join(f"w{k}" if k % 3 else f"x{k}é" for k in np.minimum(rng.zipf(1.15, n), 9000))
    rows = [(i, draw(int(n))) for i, n in enumerate(rng.integers(0, 900, 60))] + [(100, "never seen WORDS w1 w2"), (101, ""), (102, None), (102, None), (103, "w1 a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") < 50
    counts = {bytes(r["tok"]): r["n"] for r in maxent.word_counts(docs.where(learn)).collect()}
    v = maxent.vocabulary(maxent.word_counts(docs.where(learn)))
    totals = maxent.class_totals(maxent.word_counts(docs.where(learn)), v)
    assert v.distinct > 2500 and totals.sum() == v.rest and totals.min() >= 0
    probability = by_hand(v, *maxent.train(docs.where(learn), v, totals), totals, counts)
    for two, one in ((None, None), (None, b"w1"), (b"w1", b"x8999zz"), (b"a", b"w2")):
        assert abs(sum(probability(two, one, w) for w in counts) + probability(two, one, b"not met") - 1) < 1e-3
    got = sorted((r["doc_id"], r["score"]) for r in maxent.score(docs, learn).collect())
    want = []
    for i, text in rows:
        toks = [None, None, *((text or "").translate(LOW).encode().split()), b""]
        want.append((i, sum(math.log10(probability(*toks[k - 2: k + 1])) for k in range(2, len(toks)))))
    assert [i for i, _ in got] == sorted(i for i, _ in want)
    for (_, x), (_, y) in zip(got, sorted(want)):
        assert abs(x - y) < 2e-3 * max(1, -y)
    # the context tells something about words beyond the head, too
    some = [w for w in v.words[maxent.HEAD:][:200]]
    assert max(abs(math.log(probability(None, b"w1", w) / probability(None, b"w2", w))) for w in some) > 0.01


def test_gradient_is_that_of_the_likelihood():
    """Observed minus expected equals the numeric derivative of the log likelihood of a few statistics."""
    import pyarrow as pa

    key = np.array([(3 * maxent.SYMBOLS + 7) * maxent.CLASSES + 2, (3 * maxent.SYMBOLS + 9) * maxent.CLASSES + 4, 3 * maxent.HEAD + 70], np.int64)
    n = np.array([5, 2, 4])
    packed = pa.Table.from_batches([*maxent._packed(0, key[:2], n[:2]), *maxent._packed(1, key[2:], n[2:])]).combine_chunks()
    batch = packed.to_batches()[0]
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 0.1, sum(maxent.sizes(1024))).astype(np.float32)

    class Sent:
        value = (flat, False)

    out = next(iter(maxent._gradient(Sent)(iter([batch]))))
    grad = np.concatenate([np.frombuffer(zstandard.decompress(x.as_py()), np.float32) for _, x in sorted(zip(out.column(0).to_pylist(), out.column(1)), key=lambda p: p[0])])

    def likelihood(f):
        w = maxent.Weights(f.astype(np.float64))
        a = w.classes(key[:2] // maxent.CLASSES)
        b = w.words(np.array([3]), np.array([1]))
        return 5 * a[0, 2] + 2 * a[1, 4] + 4 * b[0, 6]

    for at in (2, maxent._PREVIOUS * 32 + 3 * 32 + 2, (maxent._SKIP + 7) * 32 + 1, maxent.sizes(1024)[0] + 64 + 6):
        up, down = flat.astype(np.float64), flat.astype(np.float64)
        up[at] += 1e-4
        down[at] -= 1e-4
        assert abs((likelihood(up) - likelihood(down)) / 2e-4 - grad[at]) < 1e-2
