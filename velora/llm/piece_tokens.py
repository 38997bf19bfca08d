"""SentencePiece ids through a table of distinct marked words (operator 11).

SentencePiece writes every space as a marker character and puts one marker in
front of the text. If no piece of the model has a marker behind another
character, no piece crosses from the end of a word into the markers of the next
one, and no merge does. A text's ids are then those of its marked words
(markers and the characters behind them), one after the other.

Each task keeps a table of the distinct marked words it has met: the library
segments a word once, a text becomes the list of its words' rows in that table,
and the ids are joined back by position. A table closes at ``TABLE_BYTES`` and
the next one starts, so memory does not grow with the vocabulary; words of more
than ``LONG_WORD`` characters are segmented where they stand. Nothing is
shuffled: each text is read once, and a lost task repeats its own texts only. A
table over the whole corpus would send every block of texts through a shuffle
to save the words that different tasks share.

Models that do not meet the condition (a piece with an inner marker, another
normalisation than the marker's) have their texts encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

MARK = "▁"
TABLE_BYTES = 64 << 20
LONG_WORD = 1000
ROWS = 200
#: a text whose normalised form shows that the model only puts markers in
_PROBE = "Å ﬁ½  　a\tb\n ć ​ "
_WORD = re.compile(f"[ {MARK}]+[^ {MARK}]*")


class WordTable:
    """Distinct marked words and their ids (little-endian 32 bits), one generation at a time."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        self.model = SentencePieceProcessor(model_file=path)
        self.table_bytes = table_bytes
        self.rows: dict[str, bytes] = {}
        self.size = 0
        self.splits = self.model.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK) and not any(
            MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size())
        )
        self.single = array("I", [self.model.piece_to_id(MARK)]).tobytes()

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids of marked words. The library puts the first marker of a word itself; a marker alone is its own piece."""
        found = self.model.encode([w[1:] for w in words], num_threads=1)
        return [array("I", ids).tobytes() if len(w) > 1 else self.single for w, ids in zip(words, found)]

    def _learn(self, words: list[str]) -> None:
        ids = self._segment(words)
        self.rows.update(zip(words, ids))
        self.size += sum(map(len, words)) + sum(map(len, ids)) + 200 * len(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts, without begin and end ids."""
        if not self.splits:
            return [array("I", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]
        if self.size > self.table_bytes:
            self.rows, self.size = {}, 0
        cut = [_WORD.findall(MARK + t) if t else [] for t in texts]
        rows = self.rows
        missing = {w: None for words in cut for w in words if w not in rows and len(w) <= LONG_WORD}
        if missing:
            self._learn(list(missing))
        out = []
        for words in cut:
            ids = list(map(rows.get, words))
            if None in ids:
                ids = [self._segment([w])[0] if x is None else x for w, x in zip(words, ids)]
            out.append(b"".join(ids))
        return out


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The worker's table: tasks that follow each other in one worker share it."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def _pieces(path: str, begin_end: bool):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        first, last = (array("I", [i]).tobytes() if begin_end else b"" for i in (table.model.bos_id(), table.model.eos_id()))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                few = batch.slice(at, ROWS)
                texts = [t or "" for t in few.column(1).to_pylist()]
                ids = [first + x + last for x in table.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"]
                )

    return tokens


def _digests(path: str):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in _pieces(path, True)(batches):
            ids = batch.column(1).to_pylist()
            decoded = [table.model.decode(array("I", x).tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return report


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def encode_texts(docs: DataFrame, model: str, begin_end: bool = True) -> DataFrame:
    """(doc_id, ids binary) of whole texts: the ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has the begin and end ids only. Rows keep
    their number: repeated and null doc_ids give a row each. An empty table
    gives no rows; columns other than doc_id and text are ignored.
    """
    return _input(docs).mapInArrow(_pieces(model, begin_end), "doc_id bigint, ids binary")


def _texts(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_table(path).model
        for batch in batches:
            found = [model.decode(array("I", x).tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "text"])

    return read


def decode_texts(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) as ``encode_texts`` returns them; begin and end ids decode to nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(model), "doc_id bigint, text string")


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes whole texts: doc_id, n_tokens, ids_sha256, decoded_sha256 (nulls and repeats as ``encode_texts``)."""
    return _input(docs).mapInArrow(_digests(model), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
