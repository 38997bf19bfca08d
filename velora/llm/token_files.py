"""Token ids in files with Elias-Fano document boundaries (operator 2).

A file set is a Parquet table of shards. A shard holds consecutive documents:
their ids concatenated (little-endian, 2 bytes each if the vocabulary allows,
else 4), and the end position of every document inside the shard as an
Elias-Fano sequence: the low bits packed side by side, the high bits in unary
in one bit array, and the place of every 64th one bit, from which ``select``
scans at most one sample's stretch. No table of 64-bit offsets is kept. Shards
are ordered by (part, seq); ``start`` is the number of ids before the shard in
its part, and the parts' totals (one row per part) give the rest.

A shard closes once it has ``shard_tokens`` ids, so it is bounded by that and
one document. Parts are ranges of doc_id, cut by Spark's range partitioner.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

END_ID = 2
SHARD_TOKENS = 1 << 18
SAMPLE = 64
KNOWN_PIECES = 400_000
KNOWN_BYTES = 48 << 20
ENCODE_ROWS = 500
SHARD_TYPE = (
    "part int, seq int, start bigint, n_tokens bigint, n_docs int, doc_ids array<bigint>, "
    "id_bytes int, ids binary, low_bits int, low binary, high binary, samples array<int>"
)


# --- Elias-Fano ---------------------------------------------------------------------------


def elias_fano(values: np.ndarray) -> tuple[int, bytes, bytes, list[int]]:
    """Encodes a non-decreasing sequence: number of low bits, low bits, high bits, select samples."""
    n = len(values)
    if n == 0:
        return 0, b"", b"", []
    values = values.astype(np.int64)
    low_bits = max(0, int(values[-1] // n).bit_length() - 1)
    low = (values[:, None] >> np.arange(low_bits)) & 1
    ones = (values >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    high[ones] = 1
    return (
        low_bits,
        np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
        np.packbits(high, bitorder="little").tobytes(),
        ones[::SAMPLE].tolist(),
    )


def select(i: int, low_bits: int, low: bytes, high: bytes, samples: list[int]) -> int:
    """The i-th value: finds the i-th one bit from the sample before it, then adds the low bits."""
    at = int(samples[i // SAMPLE])
    left = i % SAMPLE
    byte = at // 8
    bits = high[byte] & (0xFF << (at % 8)) & 0xFF
    while True:
        count = bits.bit_count()
        if left < count:
            for _ in range(left):
                bits &= bits - 1
            one = byte * 8 + ((bits & -bits).bit_length() - 1)
            break
        left -= count
        byte += 1
        bits = high[byte]
    value = 0
    if low_bits:
        first = i * low_bits
        word = int.from_bytes(low[first // 8 : (first + low_bits + 7) // 8], "little")
        value = (word >> (first % 8)) & ((1 << low_bits) - 1)
    return ((one - i) << low_bits) | value


def decode(n: int, low_bits: int, low: bytes, high: bytes) -> np.ndarray:
    """All n values at once."""
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, dtype=np.uint8), bitorder="little"))[:n]
    values = (ones - np.arange(n)) << low_bits
    if low_bits:
        bits = np.unpackbits(np.frombuffer(low, dtype=np.uint8), bitorder="little")[: n * low_bits]
        values = values + (bits.reshape(n, low_bits).astype(np.int64) << np.arange(low_bits)).sum(axis=1)
    return values


# --- encoding -----------------------------------------------------------------------------

#: The pieces that a byte-level pre-tokenizer cuts (fixed pattern), for the characters of ``_OTHER`` left out: there
#: letters are Latin ones and digits are 0-9, so that no table of character classes has to agree.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_S = " \t\n\x0b\x0c\r"
_PIECE = re.compile(f" ?[{_L}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile(f"[^\x00-\x7f{_L}\u2010-\u2027\u2030-\u205e]")


def byte_alphabet() -> dict[int, str]:
    """The characters by which a byte-level BPE writes bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """Encodes texts through the tokenizer, one distinct piece at a time.

    A byte-level BPE without a normalizer encodes every piece that its
    pre-tokenizer cuts on its own, so a text's ids are the concatenation of its
    pieces' ids. Distinct pieces go through the tokenizers library's BPE model
    once; their ids are kept in two generations of at most ``KNOWN_PIECES`` and
    ``KNOWN_BYTES``. Texts with other
    characters than ``_PIECE`` covers, with the text of an added token, or under
    a tokenizer with other rules are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cutter = self.tokenizer.pre_tokenizer
        self.cuts = type(cutter).__name__ == "ByteLevel" and cutter.use_regex and not cutter.add_prefix_space
        self.cuts = self.cuts and self.tokenizer.normalizer is None and self.tokenizer.truncation is None
        self.model, self.letters = self.tokenizer.model, byte_alphabet()
        self.cuts = self.cuts and type(self.model).__name__ == "BPE"
        self.size = 0
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        kind = "H" if self.dtype == "<u2" else "I"
        return [array(kind, e.ids).tobytes() for e in found]

    def _learned(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pieces, by the model alone: their bytes in its alphabet."""
        kind, tokenize, letters = "H" if self.dtype == "<u2" else "I", self.model.tokenize, self.letters
        return [array(kind, [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes() for p in pieces]

    def _pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None if it has to be encoded whole."""
        if not self.cuts or (not text.isascii() and _OTHER.search(text)) or any(x in text for x in self.added):
            return None
        return _PIECE.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        if len(self.known) > KNOWN_PIECES or self.size > KNOWN_BYTES:  # the older generation goes; pieces still used move over
            self.before, self.known, self.size = self.known, {}, 0
        known, before = self.known, self.before
        found = [None if row is None else list(map(known.get, row)) for row in cut]
        missing: dict[str, None] = {}
        for row, ids in zip(cut, found):
            if row and None in ids:
                for p, x in zip(row, ids):
                    if x is None and p not in known:
                        old = before.get(p)
                        if old is None:
                            missing[p] = None
                        else:
                            known[p] = old
        if missing:
            ids = self._learned(list(missing))
            known.update(zip(missing, ids))
            self.size += sum(map(len, missing)) + sum(map(len, ids))
        whole = iter(self._direct([t for t, row in zip(texts, cut) if row is None]))
        out = []
        for row, ids in zip(cut, found):
            if row is None:
                out.append(next(whole))
            elif None in ids:
                out.append(b"".join([known[p] if x is None else x for p, x in zip(row, ids)]))
            else:
                out.append(b"".join(ids))
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder: tasks that follow each other in one worker share what it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# --- writing ------------------------------------------------------------------------------


def _shards(path: str, end_id: int, shard_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        width = len(end)
        part = TaskContext.get().partitionId()
        seq = start = 0
        doc_ids: list[int | None] = []
        blobs: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, start, doc_ids, blobs, size
            ends = np.cumsum([len(b) // width for b in blobs])
            low_bits, low, high, samples = elias_fano(ends)
            row = {
                "part": part, "seq": seq, "start": start, "n_tokens": size, "n_docs": len(blobs), "doc_ids": doc_ids,
                "id_bytes": width, "ids": b"".join(blobs), "low_bits": low_bits, "low": low, "high": high, "samples": samples,
            }
            seq, start = seq + 1, start + size
            doc_ids, blobs, size = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                few = batch.slice(at, ENCODE_ROWS)
                for doc_id, ids in zip(few.column(0).to_pylist(), enc.encode([t or "" for t in few.column(1).to_pylist()])):
                    doc_ids.append(doc_id)
                    blobs.append(ids + end)
                    size += len(ids) // width + 1
                    if size >= shard_tokens:
                        yield close()
        if blobs:
            yield close()

    return pack


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()),
        ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.list_(pa.int32())),
    ]
)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encodes ``text`` (null: empty) of (doc_id, text) and writes the shards in ascending doc_id order.

    Null ids come first; rows of one id are ordered by text. An empty table
    writes an empty file set. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_shards(tokenizer, end_id, shard_tokens), SHARD_TYPE)
        .write.parquet(folder)
    )


# --- reading ------------------------------------------------------------------------------


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a file set with ``before``: the number of ids in front of the shard's part."""
    table = spark.read.schema(SHARD_TYPE).parquet(folder)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    return table.join(F.broadcast(before), "part")  # one row per part of the write


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            s = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            n = s["n_docs"].as_py()
            ends = decode(n, s["low_bits"].as_py(), s["low"].as_py(), s["high"].as_py())
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            raw = np.frombuffer(s["ids"].as_buffer(), dtype="<u2" if s["id_bytes"].as_py() == 2 else "<u4").astype("<u4")
            view = memoryview(raw).cast("B")
            yield pa.RecordBatch.from_arrays(
                [
                    s["doc_ids"].values,
                    pa.array(starts + (s["before"].as_py() + s["start"].as_py())),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (ids as 32-bit little-endian)."""
    table = shards(spark, folder).select("n_docs", "doc_ids", "id_bytes", "ids", "low_bits", "low", "high", "start", "before")
    return table.mapInArrow(_index, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pick(
    place: pd.Series, id_bytes: pd.Series, ids: pd.Series, low_bits: pd.Series, low: pd.Series, high: pd.Series, samples: pd.Series
) -> pd.Series:
    out = []
    for i, width, raw, *fano in zip(place, id_bytes, ids, low_bits, low, high, samples):
        a, b = (select(i - 1, *fano) if i else 0), select(i, *fano)
        out.append(np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4")[a:b].astype(np.int32))
    return pd.Series(out)


def read_ids(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The ids of the documents in ``wanted`` (doc_id), through the select structure: doc_id, ids."""
    table = spark.read.schema(SHARD_TYPE).parquet(folder)
    places = table.select("part", "seq", F.posexplode("doc_ids").alias("place", "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id")
    return places.join(table, ["part", "seq"]).select(
        "doc_id", _pick("place", "id_bytes", "ids", "low_bits", "low", "high", "samples").alias("ids")
    )
