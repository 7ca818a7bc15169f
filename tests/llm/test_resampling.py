import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from pricelens.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, longest, buckets, percent, least, seed):
    def words(t):
        return WORD.findall((t or "").translate(LOW))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i: i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for total, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text):
                total[f] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets)))) for k in range(buckets)]
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in features(text))
        rows.append([i, len(words(text)), len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("longest,head", [(1, 1), (1, 65_536), (2, 40), (3, 10_000)])
def test_equals_brute_force(spark, hard, texts, monkeypatch, longest, head):
    monkeypatch.setattr(resampling, "PART", 100)
    monkeypatch.setattr(resampling, "vocabulary", lambda t, n, b, f=resampling.vocabulary: f(t, n, b, head, head))
    target = ["Words of the second text, don't stand here", None, "", "wort ENDE äÄ"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(hard, bench, longest=longest, buckets=97, percent=60, least_words=4, seed="7").collect()
    assert sorted(map(tuple, got), key=repr) == brute(texts, target, longest, 97, 60, 4, "7")


def test_empty_tables(spark, hard, texts, empty):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, hard).count() == 0
    assert sorted(map(tuple, resampling.resample(hard, none, least_words=1, percent=100).collect()), key=repr) == brute(texts, [], 1, 10_000, 100, 1, "2024")


def test_head_is_bounded(spark):
    df = spark.createDataFrame([(("a " * 50 + "b " * 30 + " ".join(f"w{k}" for k in range(400)) + " " + "x" * 100 + " ").encode(),)] * 3, "text binary")
    assert sorted(resampling.frequent(df, False, 20)) == [(b"a",), (b"b",)]
    assert len(resampling.frequent(df, True, 20)) <= 20 and (b"a", b"a") in resampling.frequent(df, True, 20)
    voc = resampling.Vocabulary({b"a": zlib.crc32(b"a")}, {}, 2, 1000)
    assert [int(x) for part in voc.of([b"a", b"zz"]) for x in part] == [zlib.crc32(b"a") % 1000, zlib.crc32(b"zz") % 1000, zlib.crc32(b"a zz") % 1000]


def test_ranks_over_many_partitions(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).repartition(7).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 13).alias("score"))
    got = resampling.ranked(rows, [F.col("score").desc(), F.col("doc_id").asc()]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)
    assert np.unique([r["doc_id"] for r in got]).size == 5000
