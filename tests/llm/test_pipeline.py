import re

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from pricelens.llm import decontam, linededup, quality, simhash
from pricelens.llm.common import table

from .test_decontam import brute as windows
from .test_dedup import brute_components, brute_fingerprint

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, DIR, "documents")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    items = [(r["item_id"], r["text"]) for r in table(spark, DIR, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DIR).collect()
        after = {r["doc_id"] for r in out}
        if name == "quality rules":
            verdict = {r["doc_id"]: r["kept"] for r in quality.assess(docs).collect()}
            assert after == {i for i in before if verdict[i]}
        elif name == "line dedup":
            assert {r["doc_id"]: r["text"] for r in out} == {r["doc_id"]: r["text"] for r in linededup.drop_shared_lines(docs).collect()}
        elif name == "SimHash near-dedup":
            assert after == {i for i, c in brute_components([(i, brute_fingerprint(t)) for i, t in before.items()]) if i == c}
        elif name == "benchmark decontamination":
            assert after == {i for i, n, hit, _ in windows(list(before.items()), items) if not (hit and 20 * hit >= n)}
        else:
            assert {r["doc_id"]: r["ids"] for r in out} == {i: library.encode(t) for i, t in before.items()}
            break
        assert [f.name for f in stage(spark, docs, DIR).schema] == docs.columns
        docs = spark.createDataFrame(out, docs.schema)


def test_run(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 100


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))


def test_hard_rows_go_through(spark, hard):
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.select(F.count("*")).first()[0] >= 0
    assert simhash.one_of_each(hard.limit(0)).count() == 0 and decontam.drop_contaminated(hard.limit(0), table(spark, DIR, "benchmark")).count() == 0


def test_clashing_names_and_empty_tables(spark, hard):
    """Every stage that returns documents keeps columns called like its own private ones, and the rows it keeps without them."""
    names = ["_id", "_tk", "n_lines", "n_dropped", "_gone", "_bad_id", "_bad_t", "_d", "_t", "a.b"]
    plain = hard.select("doc_id", "text", "lang", "source", "n_chars")
    wide = plain.selectExpr("*", *[f"'{k}' AS `{n}`" for k, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DIR)
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(r[n] == str(k) for r in rows for k, n in enumerate(names))
        expected = stage(spark, plain, DIR).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(((r["doc_id"], r["text"]) for r in expected), key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), DIR).count() == 0
