import zlib
from collections import defaultdict

from pricelens.llm import shards


def test_shards(spark, hard, texts, empty):
    rows, nodes = shards.kd_shards(hard)
    rows = rows.collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len(s) == 1 for s in where.values())
    assert shards.kd_shards(empty)[0].count() == 0


def test_near_equal_bytes(spark):
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "CASE WHEN id < 300 THEN repeat('copy ', 40) ELSE repeat('x', cast(pmod(hash(id), 400) AS int)) || id END AS text",
        "if(id % 3 = 0, 'en', 'de') AS lang", "concat('s', id % 7) AS source")
    rows, nodes = shards.kd_shards(docs)
    total = defaultdict(int)
    for r in rows.collect():
        total[r["shard"]] += r["size"]
    assert len(nodes) == 15 and len(total) == 16
    assert max(total.values()) < 1.03 * min(total.values())
