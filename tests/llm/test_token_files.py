import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF001
from tests.llm.helpers import docs
from velora.llm import token_files as K
from velora.llm.common import fresh_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENC = K.PieceEncoder(PATH)


def direct(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def slow(rows):
    tok = Tokenizer.from_file(PATH)
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@given(st.lists(st.integers(0, 5000), max_size=300).map(sorted))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    low_bits, low, high, samples = K.elias_fano(np.array(values, dtype=np.int64))
    assert K.decode(len(values), low_bits, low, high).tolist() == values
    assert [K.select(i, low_bits, low, high, samples) for i in range(len(values))] == values
    assert len(low) + len(high) <= (len(values) * (low_bits + 3) + 15) // 8 + 1


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab's.,1éºµ²\x1c\x85　–“<|endoftext|>'revm"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_like_whole_texts(text):
    assert np.frombuffer(ENC.encode([text])[0], dtype=ENC.dtype).tolist() == ENC.tokenizer.encode(text, add_special_tokens=False).ids


def test_cleared_caches_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(K, "KNOWN_PIECES", 2)
    texts = ["a b c d e f", "f e d x y z", "a <|endoftext|> b", "a b c d e f"]
    enc = K.PieceEncoder(PATH)
    for few in (texts, texts[:1], texts[1:3], texts):
        assert [np.frombuffer(g, dtype="<u2").tolist() for g in enc.encode(few)] == [direct(t) for t in few]


@pytest.mark.parametrize("shard_tokens", [1, 700, K.SHARD_TOKENS])
def test_index_equals_brute_force(spark, shard_tokens):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(None, "no id"), (5, None), (6, ""), (5, None), (7, "  two  blanks \n\n <|endoftext|> x"), (10**12, "large id")]
    folder = fresh_folder(spark, "t")
    K.write_token_files(docs(spark, rows, extra=["ids", "start", "part"]), folder, PATH, shard_tokens=shard_tokens)
    got = [tuple(r) for r in K.read_index(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_ids_through_select(spark):
    rows = [(i, "word " * (i % 7) + f"n{i}") for i in range(200)]
    folder = fresh_folder(spark, "t")
    K.write_token_files(docs(spark, rows), folder, PATH)
    wanted = spark.createDataFrame([(0,), (64,), (63,), (199,)], "doc_id bigint")
    got = {r.doc_id: r.ids for r in K.read_ids(spark, folder, wanted).collect()}
    assert got == {i: [*direct(rows[i][1]), 2] for i in (0, 63, 64, 199)}


def test_empty_table(spark):
    folder = fresh_folder(spark, "t")
    K.write_token_files(docs(spark, []), folder, PATH)
    assert K.read_index(spark, folder).collect() == []
