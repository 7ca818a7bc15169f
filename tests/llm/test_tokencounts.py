from collections import Counter

import public_tokenizers

from pricelens.llm import tokencounts

FILE, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_histogram(spark, hard, texts, empty):
    enc = tokencounts.encoding(FILE, PATTERN)
    n = [len(enc.encode_ordinary(t or "")) for _, t in texts]
    measured = tokencounts.lengths(hard, FILE, PATTERN)
    assert sorted(((r["doc_id"], r["length"]) for r in measured.collect()), key=repr) == sorted(((i, k) for (i, _), k in zip(texts, n)), key=repr)
    hist = tokencounts.histogram(measured)
    rows = {r["length"]: r for r in hist.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(n)
    for limit, r in rows.items():
        assert r["docs_longer"] == sum(k > limit for k in n) and r["tokens_longer"] == sum(k for k in n if k > limit)
        assert r["truncated_tokens"] == sum(min(k, limit) for k in n) and abs(r["share_within"] - sum(k <= limit for k in n) / len(n)) < 1e-12
    for limit in (0, 7, 5000):
        assert tokencounts.truncated_total(hist, limit).first()["tokens"] == sum(min(k, limit) for k in n)
    assert tokencounts.quantile(hist, 0.5).first()["length"] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert tokencounts.histogram(tokencounts.lengths(empty, FILE, PATTERN)).count() == 0
