"""Byte-level BPE encoding and decoding with the tiktoken library.

Defined results
    null text           encodes as the empty text: no ids, no bytes
    empty text          no ids, no bytes
    very long text      cut at safe boundaries, encoded piece by piece, ids joined
    long white space    a run is encoded as the one match it is, whatever its length
    ties, repeated rows every row is encoded on its own
    empty table         empty result
    clashing columns    the operator's own output column replaces one of its name
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import bounded_batches

#: Texts above this many characters are cut before they are encoded.
CUT_CHARS = 65_536

#: No alternative of the pre-splitting pattern matches a non-space followed by
#: white space, and none looks back, so a text may be cut there. Both sides are
#: ASCII: there every regex engine agrees on what white space is.
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")

#: The library's regex goes back over white space on its stack, which a run of a
#: million characters exhausts; runs from this length on are matched here.
RUN_CHARS = 4_096
# The characters with Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{WHITE_SPACE}]{{{RUN_CHARS},}}")


def safe_pieces(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """Cut a long text so that the pieces' matches are the text's matches."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def pieces(text: str, size: int = CUT_CHARS, runs: re.Pattern = _RUN) -> Iterator[tuple[str, bool]]:
    """Cut a text into (piece, whether the piece is one match of the pattern).

    Nothing before a run of white space matches into it. At the end of the text
    the run is one match; elsewhere all but its last character are, as that one
    may open the next word's match.
    """
    start = 0
    for run in runs.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield from ((p, False) for p in safe_pieces(text[start : run.start()], size))
        yield text[run.start() : end], True
        start = end
    yield from ((p, False) for p in safe_pieces(text[start:], size))


@functools.cache
def _encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, rank_path: str, pattern: str) -> bytes:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    coder = _encoding(rank_path, pattern)
    ids: list[int] = []
    for piece, whole in pieces(text or ""):
        ids += coder._encode_single_piece(piece) if whole else coder.encode_ordinary(piece)
    return np.asarray(ids, dtype="<u4").tobytes()


def decode_ids(packed: bytes, rank_path: str, pattern: str) -> bytes:
    """Raw bytes of packed ids; they need not be valid UTF-8."""
    return _encoding(rank_path, pattern).decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())


def encode(df: DataFrame, text: str, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add the packed ids of every whole text (binary, 4 bytes an id)."""

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: encode_text(x, rank_path, pattern))

    return bounded_batches(df).withColumn(ids, run(F.col(text).cast("string")))


def decode(df: DataFrame, ids: str, rank_path: str, pattern: str, decoded: str = "decoded") -> DataFrame:
    """Add the raw bytes that packed ids stand for."""

    @F.pandas_udf(T.BinaryType())
    def run(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: decode_ids(x or b"", rank_path, pattern))

    return bounded_batches(df).withColumn(decoded, run(F.col(ids)))


def round_trip(rank_path: str, pattern: str, text: Column) -> Column:
    """Struct of packed ids and decoded bytes, so that one pass yields both."""

    @F.pandas_udf("ids binary, decoded binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        packed = [encode_text(x, rank_path, pattern) for x in texts]
        return pd.DataFrame({"ids": packed, "decoded": [decode_ids(x, rank_path, pattern) for x in packed]})

    return run(text.cast("string"))
