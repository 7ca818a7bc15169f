import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "1", "<", "▁", "th", "er", ".", "🙂", "===", "//"]), max_size=40).map("".join))
@settings(max_examples=1500, deadline=None)
def test_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = sentencepieces.loaded(MODEL).encode(text)
    assert ids == LIBRARY.encode(text)
    assert sentencepieces.loaded(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_long_segments():
    for text in ("a" * 3000, " " * 1000, "é" * 300, "x1" * 500):
        assert sentencepieces.loaded(MODEL).encode(text) == LIBRARY.encode(text)


def test_table(spark, hard, texts, empty):
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in sentencepieces.encode(hard, MODEL).collect()), key=repr)
    want = sorted(((i, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in texts), key=repr)
    assert got == want
    assert sentencepieces.encode(empty, MODEL).count() == 0


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in sentencepieces.encode(rows, MODEL).collect()}
    assert got == {r["doc_id"]: LIBRARY.encode(r["text"]) for r in rows.collect()}
