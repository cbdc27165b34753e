"""Byte-level BPE encoding and decoding with a local rank file.

The ranks reach the executors as one broadcast of the file's bytes (refused above ``MAX_RANK_BYTES``), so only the driver needs the file.
A text is encoded whole: short texts in one call, longer ones in pieces cut where the pattern always ends a match, so the ids are the same.

Cases: a null text counts as empty and gives no ids; repeated rows give repeated results; other columns are not read. Ids decode to exactly
the UTF-8 bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import per_batch, table

MAX_RANK_BYTES = 64 << 20
#: Texts up to this many characters are encoded in one call.
PIECE = 100_000

# A match never holds a character that is not white space followed by one that is, and what follows is matched without looking back.
_SAFE_CUT = regex.compile(r"\S(?=\s)")
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file's bytes, built once per Python worker."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _encodings:
        _encodings.clear()
        pairs = (line.split() for line in ranks.splitlines() if line)
        _encodings[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encodings[key]


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Consecutive parts of ``text``, each ending at the first safe boundary after ``piece`` characters."""
    start = 0
    while len(text) - start > piece:
        cut = _SAFE_CUT.search(text, start + piece - 1)
        if cut is None:
            break
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:]


def encode(enc: tiktoken.Encoding, pattern: str, text: str, piece: int = PIECE) -> list[int]:
    """Ids of ``text``. A part without a safe boundary is matched here and its matches are merged one by one, as the library would."""
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_pieces(text, piece):
        if len(part) <= 2 * piece:
            ids.extend(enc.encode_ordinary(part))
        else:
            for m in regex.finditer(pattern, part):
                ids.extend(enc._encode_single_piece(m[0]))
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array column of token ids; all other columns are kept as they are.

    A column already named like ``ids`` is replaced.
    """
    sc = docs.sparkSession.sparkContext
    with open(rank_file, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_file} is larger than {MAX_RANK_BYTES} bytes")
    ranks = sc.broadcast(raw)

    @F.pandas_udf("array<int>")
    def to_ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(ranks.value, pattern)
        for s in parts:
            yield pd.Series([np.array(encode(enc, pattern, t or ""), dtype=np.int32) for t in s])

    return docs.withColumn(ids, to_ids(F.col(text)))


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column of the bytes its ids stand for. Null ids give no bytes; an unknown id stops the job."""
    sc = encoded.sparkSession.sparkContext
    with open(rank_file, "rb") as f:
        ranks = sc.broadcast(f.read(MAX_RANK_BYTES))

    @F.pandas_udf("binary")
    def to_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(ranks.value, pattern)
        for s in parts:
            yield pd.Series([b"" if x is None else enc.decode_bytes([int(i) for i in x]) for x in s])

    return encoded.withColumn(out, to_bytes(F.col(ids)))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them, without sending ids through Spark:
    ``key``, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256."""
    sc = docs.sparkSession.sparkContext
    with open(rank_file, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{rank_file} is larger than {MAX_RANK_BYTES} bytes")
    ranks = sc.broadcast(raw)

    def digests(frame: pd.DataFrame) -> pd.DataFrame:
        enc, out = encoding(ranks.value, pattern), []
        for t in frame["text"]:
            ids = encode(enc, pattern, t or "")
            out.append((len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
        return pd.concat([frame[["key"]], pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInPandas(per_batch(digests), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded with the public 50k rank file and decoded again."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
