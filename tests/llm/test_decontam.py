import re

from pyspark.sql import functions as F

from pricelens.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    out = set()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            x = words(x)
            n = min(13, len(x))
            for o in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p: p + n] == x[o: o + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        out.add((i, len(w), len(hit), tuple(sorted(f for f in found if f is not None))))
    return out


def test_windows(spark, hard, texts, empty):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = [(1, passage), (2, "Own WORDS of the first"), (3, "wort wort"), (4, "alpha"), (5, None), (6, "..."), (None, "nobody s"), (7, passage), (8, "a b c wort ende")]
    more = [(100, f"before {passage}, {passage} after"), (101, passage[4:]), (102, passage[8:]), (103, "x " * 200 + passage), (106, "x " * 300 + passage), (104, "thirteen " + passage.replace("seven", "7")), (105, "ALPHA, alpha")]
    docs = hard.select("doc_id", "text", "n", "w", "t", "sid").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("sid", F.lit(1))
    got = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.find_items(docs, bench).collect()}
    assert got == brute(texts + more, items)
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).select("doc_id").collect()}
    assert not kept & {100, 101, 102, 103} and {104, 106} <= kept
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_items(empty, bench).count() == 0
    assert decontam.find_items(docs, none).agg(F.sum("n_hit")).first()[0] == 0


def test_shuffled_join_gives_the_same(spark, hard, monkeypatch):
    bench = spark.createDataFrame([(1, "same words in the same order but for"), (2, "stands in many documents and is long enough to count")], "item_id long, text string")
    one = sorted(map(repr, decontam.find_items(hard, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert sorted(map(repr, decontam.find_items(hard, bench).collect())) == one
