import re
from collections import Counter

from pricelens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k: k + 8]) for k in range(len(w) - 7))
    covered = set()
    for k in range(len(w) - 7):
        if windows[tuple(w[k: k + 8])] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(hard, texts, empty):
    more = ["a b c d e f g h a b c d e f g h a b", "a\x1cb  c d", "x\nx\n\n\nx ", "# * $ % & | < > é日本"]
    for t in [t for _, t in texts] + more:
        assert quality.statistics_of(t or "")[:5] == brute(t)
    rows = quality.assess(hard).collect()
    assert len(rows) == len(texts)
    want = Counter((i, *brute(t)) for i, t in texts)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:  # too few rows for a verdict beyond the limits
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert quality.assess(empty).count() == 0


def test_outliers(spark):
    """Planted outliers among clean rows, a fifth of them, in a hot source and in small ones that are pooled."""
    import random

    rng = random.Random(5)
    rows = []
    for k in range(3000):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        bad = k % 10 == 0
        text = " ".join(x + "%%%" for x in w) if bad else " ".join(w)
        rows.append((k, text, "en", "hot" if k % 3 else f"s{k % 40}", bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    got = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
    assert all(got[i] == (not bad) for i, _, _, _, bad in rows)
    assert {r["doc_id"] for r in quality.drop_rejected(docs).collect()} == {i for i, _, _, _, bad in rows if not bad}


def test_each_statistic_rejects_alone(spark):
    """Rows that differ from the clean ones in one statistic, and in it only, are rejected; the clean ones are not."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for k in range(2000):
        lines = [[word() for _ in range(6)] for _ in range(12)]
        kind = k % 100
        if kind == 0:  # double lines; of six words, so that no window of eight repeats
            lines = lines[:6] + lines[5::-1]
        elif kind == 1:  # a quarter of the characters are digits
            lines = [[w if i % 3 else "1" * len(w) for i, w in enumerate(x)] for x in lines]
        elif kind == 2:  # a tenth are symbols
            lines = [[w if i % 2 else w + "#" for i, w in enumerate(x)] for x in lines]
        rows.append((k, "\n".join(" ".join(x) for x in lines), "en", "a", kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind int")
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    for kind in (0, 1, 2):
        assert not any(got[i]["kept"] for i, *_, k in rows if k == kind), kind
    assert sum(not got[i]["kept"] for i, *_, k in rows if k > 2) <= 20
