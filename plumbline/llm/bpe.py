"""Byte-level BPE by the tiktoken library and a local rank file.

Long texts are cut before encoding, only where a match of the split pattern must end: before a
white-space character that follows another character. No alternative of the pattern takes white
space after something else, and none looks back, so the pieces are matched as the whole would be.
Decoding joins the ids' raw bytes; UTF-8 is never decoded from a part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, runs

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Texts of more characters than this are encoded in pieces of about as many.
PIECE = 1 << 16
_CUT = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """`text` cut at safe places into pieces of `most` characters and a little, if it has such places."""
    start = 0
    while len(text) - start > most and (cut := _CUT.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc: tiktoken.Encoding, piece: int = PIECE) -> np.ndarray:
    """The ids of one text, as little-endian unsigned 32-bit integers."""
    if len(text) <= piece:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text, piece)])


def decode(ids: np.ndarray, enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(ids.tolist())


def _rows(batches: Iterator[pa.RecordBatch], path: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in runs(batches):
        counts, hashes, decoded, lists = [], [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode(text or "", enc)
            counts.append(len(ids))
            hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            if keep_ids:
                lists.append(ids)
        out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            out.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256
    (and ids, an array of int, on demand).

    A null text is encoded as the empty one: no ids. Texts are encoded whole, whatever their
    length; strings that look like special tokens are ordinary text. Repeated rows each give a
    row; other columns are ignored; an empty table gives an empty result. `path`: the rank file,
    found under the same path on every executor; by default the installed multilingual one.
    Sets the session's rows of an Arrow batch (`common.bounded`).
    """
    path = path or public_tokenizers.path(RANKS)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return bounded(slim).mapInArrow(lambda batches: _rows(batches, path, keep_ids), schema)


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(path)
    for batch in batches:
        out = [None if ids is None else decode(np.array(ids, "<u4"), enc) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, bytes) of rows (doc_id, ids): the raw bytes of the ids; null ids give null bytes."""
    path = path or public_tokenizers.path(RANKS)
    return bounded(encoded.select("doc_id", "ids")).mapInArrow(lambda batches: _texts(batches, path), "doc_id long, bytes binary")
