"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Encoding: a text is cut at each space that stands between two characters that are not white
space. The pattern of a byte-level tokenizer never joins anything over such a cut (only ` ?`
takes the space, always to the right), so each chunk encodes as it would inside the text. A
worker keeps the ids of chunks it has met, in a table of bounded size; only new chunks go to the
library. Ids are the library's own, including its byte-to-character mapping.

Decoding turns each token's characters back into bytes by the reversed byte table and joins
them; one character split over several tokens is whole again after joining. Bytes that are not
UTF-8 (from cut id lists) become U+FFFD in text, and stay as they are in bytes.

Nulls and empty texts encode to no tokens; null lists and empty ones decode to an empty text. Ids that are null or
outside the vocabulary decode to U+FFFD. Very long texts are encoded whole, in chunks. Repeated rows and rows
without doc_id are encoded alike; ties of merges go to the lower rank, as in the library. An empty table gives no
rows. Other columns are kept; a column of the same name as an output column is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = re.compile(r"(?<=\S) (?=\S)")
DOUBLE = re.compile(r"\s\s")
#: Chunks whose ids a worker keeps, and the longest chunk that is kept.
KEPT_CHUNKS, KEPT_LENGTH = 400_000, 64


def byte_table() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One worker's tokenizer: encode() to little-endian uint32 ids, decode() back to bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        table = byte_table()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if all(c in table for c in token):
                self.pieces[i] = bytes(table[c] for c in token)
            else:
                self.pieces[i] = token.encode()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._chunks(t) for t in texts]
        known = self.known
        new = list({c for chunks in cut for c in chunks if c not in known})
        if len(known) + len(new) > KEPT_CHUNKS:
            known.clear()
            new = list({c for chunks in cut for c in chunks})
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for c, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, "<u4").tobytes()
        out = [b"".join([known[c] for c in chunks]) for chunks in cut]
        for c in new:
            if len(c) > KEPT_LENGTH:
                del known[c]
        return out

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not text:
            return []
        first, *rest = text.split(" ") if not DOUBLE.search(text) else CUT.split(text)
        return ([first] if first else []) + [" " + c for c in rest]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_any(self, ids: list[int | None]) -> bytes:
        """As decode(), of ids that may be null or unknown."""
        size, unknown = len(self.pieces), "\ufffd".encode()
        return b"".join(self.pieces[i] if i is not None and 0 <= i < size else unknown for i in ids)

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and, for each, the span of characters of text it covers (a split character counts for each of its tokens)."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(df: DataFrame, column: str, made: list[tuple[str, T.DataType]], rows: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with the made columns, which rows() gives for each batch of column."""
    names = [n for n, _ in made]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in made)])
    if column not in [f.name for f in kept]:
        df = df.withColumn("__in", F.col(column))
        column = "__in"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([*(part.column(at[f.name]) for f in kept), *rows(part.column(at[column]))], [*(f.name for f in kept), *names])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, column: str = "text", into: str = "ids", offsets: bool = False, digest: bool = False) -> DataFrame:
    """df with the token ids of column (array<int>).

    With offsets, also `<into>_offsets` (array of character spans); with digest, also the columns of digests().
    """

    def rows(texts: pa.Array) -> list[pa.Array]:
        c, texts = codec(tokenizer), [t or "" for t in texts.to_pylist()]
        if offsets:
            both = [c.offsets(t) for t in texts]
            spans = [[{"start": a, "end": b} for a, b in o] for _, o in both]
            return [pa.array([i for i, _ in both], pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        ids = c.encode(texts)
        return [_lists(ids), *(_digested(c, ids) if digest else [])]

    made: list[tuple[str, T.DataType]] = [(into, T.ArrayType(T.IntegerType()))]
    if offsets:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        made.append((f"{into}_offsets", T.ArrayType(span)))
    elif digest:
        made += DIGESTS
    return _mapped(df, column, made, rows)


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def decode(df: DataFrame, tokenizer: str, column: str = "ids", into: str = "decoded", as_text: bool = True) -> DataFrame:
    """df with the text (or bytes) of the ids in column; a null list decodes to an empty text."""

    def rows(ids: pa.Array) -> list[pa.Array]:
        c = codec(tokenizer)
        made = [c.decode_any(x or []) for x in ids.to_pylist()]
        return [pa.array([m.decode("utf-8", "replace") for m in made], pa.string()) if as_text else pa.array(made, pa.binary())]

    return _mapped(df, column, [(into, T.StringType() if as_text else T.BinaryType())], rows)


DIGESTS: list[tuple[str, T.DataType]] = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def _digested(c: Codec, ids: list[bytes]) -> list[pa.Array]:
    """Number of ids, SHA-256 of the ids, and SHA-256 of the bytes they decode to."""
    return [
        pa.array([len(x) // 4 for x in ids], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
        pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()),
    ]


def digests(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """df's ids encoded and decoded in one pass: n_tokens, ids_sha256 (of little-endian uint32) and decoded_sha256.

    For corpora whose ids need not be stored: the row holds three values instead of two copies of the text.
    """

    def rows(texts: pa.Array) -> list[pa.Array]:
        c = codec(tokenizer)
        return _digested(c, c.encode([t or "" for t in texts.to_pylist()]))

    return _mapped(df, column, DIGESTS, rows)
