"""Ids and texts against the sentencepiece library."""

import public_tokenizers
import pytest
import sentencepiece

from evalloom.llm import pieces

ODD = ["", " ", "   a", "a   b  ", "\n\n x\ty", "▁ ▁▁", "Straße — naïve café", "日本語のテキスト", "🙂🙃 é", "\x00\x01", "a" * 3000, " " * 200 + "x", "<s> </s> <unk>", "Hello, world! 1234567890", "▁x", "﻿bom", "𐍈 gothic", "a b​"]
SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def model_file():
    return public_tokenizers.path("piece_bpe_32k.model")


def check(spark, texts, model_file):
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    frame = spark.createDataFrame([(i, t, "old", 0) for i, t in enumerate(texts)], SCHEMA)
    rows = pieces.decode(pieces.encode(frame, model_file), model_file)
    assert rows.columns == ["doc_id", "text", "ids", "decoded"]
    for r in rows.collect():
        want = model.encode(texts[r.doc_id] or "")
        assert r.ids == want, repr(texts[r.doc_id])[:80]
        assert r.decoded == model.decode(want)


def test_odd_texts(spark, model_file):
    check(spark, [*ODD, None], model_file)


def test_whole_documents(spark, small, model_file):
    check(spark, [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()], model_file)


def test_null_ids_and_empty_table(spark, model_file):
    frame = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(frame, model_file).first().decoded == ""
    assert pieces.encode(spark.createDataFrame([], SCHEMA), model_file).count() == 0


def test_bytes_decode_as_the_library_does(model_file):
    model, table = sentencepiece.SentencePieceProcessor(model_file=model_file), pieces.PieceTable(model_file)
    bytes_ids = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
    for ids in ([bytes_ids[0xE2]], [bytes_ids[0xE2], bytes_ids[0x82], bytes_ids[0xAC]], [bytes_ids[0xFF], bytes_ids[0x41]]):
        assert table.decode(ids) == model.decode(ids)
