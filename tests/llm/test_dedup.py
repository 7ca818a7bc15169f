import re
from collections import defaultdict

import numpy as np
import xxhash

from pricelens.llm import linededup, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lines(hard, texts, empty):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert len(shared) == 1
    expected = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in shared or (i is not None and i == shared[key(x)])]
        expected.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = [tuple(r) for r in linededup.drop_shared_lines(hard).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert linededup.drop_shared_lines(empty).count() == 0


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[k: k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, least.get(find(i))) for i, (doc, _) in enumerate(pairs)]


def test_simhash(hard, texts, empty):
    expected = [(i, brute_fingerprint(t)) for i, t in texts]
    got = simhash.near_duplicates(hard).collect()
    assert sorted(((r["doc_id"], r["fp"] % 2**64) for r in got), key=repr) == sorted(expected, key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted(brute_components(expected), key=repr)
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.one_of_each(hard).select("doc_id").collect()]
    assert 12 not in kept and 11 in kept and kept.count(5) == 2  # a repeated row is the same document


def test_links_of_dense_groups(spark, monkeypatch):
    """Fingerprints in clouds around centres: dense buckets, chains, and pairs just beyond the limit."""
    rng = np.random.default_rng(7)
    fps = []
    for centre in rng.integers(0, 2**63, 6, dtype=np.uint64):
        for _ in range(250):
            x = int(centre)
            for k in rng.integers(0, 64, rng.integers(0, 9)):
                x ^= 1 << int(k)
            fps.append(x)
    fps = sorted(set(fps))
    pairs = list(enumerate(fps))
    want = brute_components(pairs)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")

    def components_of(edges):
        at = {int(np.uint64(x).view(np.int64)): i for i, x in enumerate(fps)}
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in edges:
            a, b = sorted((find(at[e["a"]]), find(at[e["b"]])))
            parent[b] = a
        return [(i, find(i)) for i in range(len(fps))]

    assert components_of(simhash.links(df).collect()) == want
    monkeypatch.setattr(simhash, "BLOCK", 40)  # buckets beyond the block are dealt over tasks
    assert components_of(simhash.links(df).collect()) == want
