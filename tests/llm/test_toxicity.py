import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pricelens.llm import toxicity


def brute_kernel(a, b):
    def maps(word):
        word, out = toxicity.START + word, {}
        for at in combinations(range(len(word)), toxicity.ORDER):
            u = tuple(word[k] for k in at)
            out[u] = out.get(u, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = maps(a), maps(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return (sum(v * y.get(u, 0.0) for u, v in x.items()) / norm) ** toxicity.POWER if norm else 0.0


def test_kernel():
    words = ["idiot", "idxiot", "moron", "aa", "éß日本語", "banana", "x" * 19]
    rows = toxicity.Landmarks(words).against(words + ["", "a"])
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(rows[i][j] - brute_kernel(a, b)) < 1e-5 and abs(toxicity.kernel(a, b) - brute_kernel(a, b)) < 1e-9
    assert rows[-1].max() == rows[-2].max() == 0.0


def test_long_words_take_their_best_window():
    rows = toxicity.Landmarks(["idiot"]).against(["z" * 50 + "idiot" + "z" * 50, "z" * 100])
    assert rows[0][0] > 0.0 and rows[1][0] == 0.0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ed", "nd"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for k in range(600):
        w = [rng.choice(words) for _ in range(40)]
        if k % 3 == 0:
            w[rng.randint(0, 39)] = rng.choice(["idiot", "moron", "scumbag"])
        rows.append((" ".join(w) + f" {k}.", int(k % 3 == 0)))
    return toxicity.fit(rows[:400]), rows[400:]


def test_held_out(model):
    m, rows = model
    scores = toxicity.Scorer(m).scores([t for t, _ in rows])
    assert all((s >= toxicity.THRESHOLD) == bool(y) for s, (_, y) in zip(scores, rows))


def test_disguises(model):
    m, _ = model
    s = toxicity.Scorer(m).scores(["then id.iot there", "then i d i o t there", "then I-D-I-O-T there", "then there", ""])
    assert min(s[:3]) >= toxicity.THRESHOLD > max(s[3:])


def test_table(spark, model, hard, empty):
    m, _ = model
    got = toxicity.score(hard, m).collect()
    assert len(got) == hard.count() and all(0.0 <= r["score"] <= 1.0 for r in got)
    assert toxicity.score(empty, m).count() == 0


def test_nothing_to_learn(spark, hard):
    labels = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.train(hard, labels, F.lit(False))
    assert all(r["score"] < toxicity.THRESHOLD for r in toxicity.score(hard, m).collect())


def test_insults_inside_other_text(model):
    """Insults that no white space sets off: joined by punctuation, written together, or disguised in a text without blanks."""
    m, rows = model
    bad = ["then fool/idiot,moron there", "then hello...idiot", "moron-then", "then_idiot_then", "then helloidiot there", "thereidiotthereandthenagainthere",
           "and" * 40 + "scumbag" + "then" * 40, "thenandthere" * 3 + "idxiot" + "thenandthere" * 3]
    clean = ["then/there,and", "thenandthere" * 20, "".join(w for t, y in rows[:60] if not y for w in t.split())]
    scores = toxicity.Scorer(m).scores(bad + clean)
    assert all(s >= toxicity.THRESHOLD for s in scores[: len(bad)]), list(zip(bad, scores))
    assert all(s < toxicity.THRESHOLD for s in scores[len(bad):]), scores[len(bad):]


@pytest.mark.parametrize("sf,recall", [("0.01", 0.7), ("0.1", 0.85)])
def test_given_labels(spark, sf, recall):
    """Rows held out: about one in fifteen labelled 1 holds no insult at all, so not all can be found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.train(docs, labels, held)
    known = docs.join(labels, "doc_id").where(held)
    got = toxicity.score(known, model).join(labels, "doc_id").groupBy("toxic").agg(F.avg((F.col("score") >= toxicity.THRESHOLD).cast("int"))).collect()
    share = dict(tuple(r) for r in got)
    assert share[1] >= recall and share[0] <= 0.02, share


def test_calibration_settles():
    import numpy as np

    rng = np.random.default_rng(0)
    f = np.r_[rng.normal(-3, 1, 2000), rng.normal(15, 9, 60)]
    y = np.r_[np.zeros(2000, bool), np.ones(60, bool)]
    slope, offset = toxicity._platt(f, y)
    p = 1 / (1 + np.exp(-(slope * f + offset)))
    assert slope > 0 and p[y].mean() > 0.8 and p[~y].mean() < 0.05
