import duckdb
import pytest

from tideline.llm import sentencepiece_codec as codec

ODD = ["", " ", "  a  b", "a\tb\n\nc ", "▁x", "x▁▁y", "日本語 🙂 é", "<s></s><unk>", "<0x41>", "\x00a", "   ", "a" * 500, "1234567 8.9", "​word", "naïvé ﬁ", "tail   "]


def test_ids_and_texts_equal_the_reference_library():
    assert codec.check_parity(ODD) == []


def test_white_space_marked_in_python_equals_the_normaliser():
    by_normaliser = [e.ids for e in codec.codec(codec.MODEL).encode_batch_fast(ODD, add_special_tokens=False)]
    assert [e.ids for e in codec.encoder(codec.MODEL)(ODD)] == by_normaliser


def test_words_encoded_once_equal_whole_texts(monkeypatch):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()] + ODD + ["a b a", "b a\tc ", "ä" * 50 + " a"]
    whole = [e.ids for e in codec.encoder(codec.MODEL)(texts)]
    asked = []
    encoder = codec.encoder
    monkeypatch.setattr(codec, "encoder", lambda path: lambda ts: asked.extend(ts) or encoder(path)(ts))
    for kept in (1 << 18, 3):  # with few words kept, those of one batch are still encoded once
        monkeypatch.setattr(codec, "KEPT_WORDS", kept)
        own = codec.word_encoder.__wrapped__(codec.MODEL)
        assert [x.tolist() for k in range(0, len(texts), 7) for x, _ in own(texts[k : k + 7])] == whole
    own = codec.word_encoder.__wrapped__(codec.MODEL)
    asked.clear()
    own(["one two one", "two one two one"])
    assert sorted(" ".join(asked).split()) == ["one", "two"]


def test_whole_table_equals_the_reference_library():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    assert codec.check_parity(texts) == []
    ids = [e.ids for e in codec.codec(codec.MODEL).encode_batch_fast(texts, add_special_tokens=False)]
    assert codec.decode(ids) == texts


def test_unigram_model_is_rebuilt():
    """A tiny unigram model, written by hand: the best-scored cut wins and unknown characters fall back to bytes."""
    pieces = [("<unk>", 0.0, codec.UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, codec.BYTE) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -3.5, 1), ("▁ab", -4.0, 1), ("c", -1.0, 1)]
    tok = codec.build({"pieces": pieces, "model_type": codec.UNIGRAM, "byte_fallback": True, "unk_id": 0, "charsmap": b"", "add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True, "whitespace_as_suffix": False})
    assert tok.encode("ab  abc").tokens == ["▁ab", "▁ab", "c"]
    assert tok.encode("é", add_special_tokens=False).tokens == ["▁", "<0xC3>", "<0xA9>"]


def test_protobuf_fields():
    assert list(codec.fields(b"\x08\x96\x01\x12\x02hi\x1d\x00\x00\x80\x3f")) == [(1, 150), (2, b"hi"), (3, b"\x00\x00\x80\x3f")]
    with pytest.raises(ValueError):
        list(codec.fields(b"\x0b"))


def test_rows(spark):
    texts = [None, "", "same", "same", "x" * 100_000, *ODD]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    rows = {r.doc_id: r for r in codec.encode(df, verify_every=1).collect()}
    assert len(rows) == len(texts)
    assert rows[0].ids is None and rows[0].n_tokens == 0 and rows[0].parity is None
    assert rows[2].ids == rows[3].ids
    assert all(r.round_trip and r.parity for i, r in rows.items() if i)
    assert codec.encode(df.limit(0)).collect() == []
    assert codec.encode(df, keep=("doc_id", "text", "ids")).columns == ["doc_id", "text", "n_tokens", "ids", "round_trip", "parity"]


def test_query_and_stage_verify_every_text(spark):
    import corpus_pipeline

    got = codec.op7_sentencepiece(spark, "/root/testdata/sf0.001")
    assert got.where("ids IS NOT NULL").count() == got.where("parity").count() > 0
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)] + [(50, None)], "doc_id long, text string")
    rows = corpus_pipeline.tokens_stage(spark, docs, "").collect()
    assert [r.parity for r in sorted(rows, key=lambda r: r.doc_id)] == [True] * 50 + [None]
