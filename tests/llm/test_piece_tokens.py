import hashlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tests.conftest import SF001
from tests.llm.helpers import docs
from velora.llm import piece_tokens as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = SentencePieceProcessor(model_file=MODEL)

HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b   c", "▁", "▁x▁▁y ▁", "a▁ b", "\n\n\t x", "<s> </s><unk>", "<0x41>",
    "\x00a\x00 ", "é é \U0001f600 ​　ﬁ½", "a" * 5000, ("ab " * 3000).strip(), "中文 中", " " * 700 + "x" + " " * 33,
]


def brute(text):
    ids = SP.encode(text or "", add_bos=True, add_eos=True)
    raw = array("I", ids).tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_report_equals_the_library(spark):
    rows = list(enumerate(HARD)) + [(100, None), (None, "no id"), (7, "twice"), (7, "twice")]
    got = P.piece_report(docs(spark, rows, extra=("ids", "words")).repartition(3), MODEL).collect()
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_whole_table_equals_the_library(spark):
    table = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in P.piece_report(table, MODEL).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def test_round_trip_and_empty_table(spark):
    rows = list(enumerate(HARD))
    frame = docs(spark, rows)
    back = {r.doc_id: r.text for r in P.decode_texts(P.encode_texts(frame, MODEL), MODEL).collect()}
    assert back == {i: SP.decode(SP.encode(t)) for i, t in rows}
    assert P.piece_report(frame.limit(0), MODEL).collect() == []


def test_very_long_unbroken_text(spark):
    long = "xéy" * 350_000
    row = P.piece_report(docs(spark, [(1, long), (2, "y " * 400_000)]), MODEL).orderBy("doc_id").collect()
    assert tuple(row[0])[1:] == brute(long) and tuple(row[1])[1:] == brute("y " * 400_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ▁\n.<s>é中\U0001f600́the")), max_size=40), max_size=4))
def test_words_join_to_the_library_ids(texts):
    table = P.word_table(MODEL)
    assert [array("I", x).tolist() for x in table.encode(texts)] == [SP.encode(t) for t in texts]


def test_table_closes_and_other_models_are_encoded_whole(monkeypatch):
    small = P.WordTable(MODEL, table_bytes=1000)
    for t in HARD * 2:
        assert array("I", small.encode([t])[0]).tolist() == SP.encode(t)
    assert small.splits and small.size < 400_000
    small.splits = False
    assert [array("I", x).tolist() for x in small.encode(HARD)] == [SP.encode(t) for t in HARD]


@pytest.mark.parametrize("n", [P.LONG_WORD - 1, P.LONG_WORD, P.LONG_WORD + 1])
def test_long_words(n):
    t = "q" * n + " " + "z" * n
    assert array("I", P.word_table(MODEL).encode([t])[0]).tolist() == SP.encode(t)
