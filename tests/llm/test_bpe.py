"""Encoding against the library on whole texts."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from strandloom.llm import bpe
from strandloom.llm.queries.op06 import RANK_FILE, digests

PATH = P.path(RANK_FILE)


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(docs, coder):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    rows = digests(docs, PATH, P.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r["doc_id"]]
        ids = np.array(coder.encode_ordinary(text), dtype="<u4")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_nasty_texts(nasty, coder):
    check(nasty, coder)


def test_test_tables(sample, coder):
    check(sample, coder)


def test_empty_table(no_docs):
    assert digests(no_docs, PATH, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [1, 3, 10, 50])
def test_cuts_do_not_change_ids(coder, size, monkeypatch):
    texts = ["a  b\n\n  c's don't  'll x1y2 ---  \t\n é漢 字   !? \x1c\x1d z  ", " lead", "trail   ", "\n\n\nx", "it's\n 'tis  12 34"]
    for text in texts:
        assert "".join(bpe.safe_pieces(text, size)) == text
        joined = [i for piece in bpe.safe_pieces(text, size) for i in coder.encode_ordinary(piece)]
        assert joined == coder.encode_ordinary(text)


@pytest.mark.parametrize("size", [2, 3, 7])
def test_runs_are_the_matches_they_are(coder, size):
    runs = re.compile(f"[{bpe.WHITE_SPACE}]{{{size},}}")
    texts = ["a   b", "   a", "a   ", "   ", "a\n\n\n\n b", "a \t\xa0\u3000 'll", "x      \n\n      1", "a\x1c\x1c\x1c\x1cb", "é\u2003\u2003\u2003\u2003!   "]
    for text in texts:
        for cut in (1, 50):
            found = list(bpe.pieces(text, cut, runs))
            assert "".join(p for p, _ in found) == text
            joined = [i for p, whole in found for i in (coder._encode_single_piece(p) if whole else coder.encode_ordinary(p))]
            assert joined == coder.encode_ordinary(text), text


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\xa0", " \n"])
def test_very_long_white_space(coder, space):
    """Runs the library can't match; split at the run, it encodes each side alone."""
    run = space * (1_200_000 // len(space))
    ids = lambda t: np.frombuffer(bpe.encode_text(t, PATH, P.PATTERN), "<u4").tolist()
    one = coder._encode_single_piece
    tail = run[-1]
    assert ids(run) == one(run)
    assert ids(run + "word") == one(run[:-1]) + coder.encode_ordinary(tail + "word")
    assert ids("word" + run) == coder.encode_ordinary("word") + one(run)
    assert ids("a b" + run + "c  d") == coder.encode_ordinary("a b") + one(run[:-1]) + coder.encode_ordinary(tail + "c  d")
    assert bpe.decode_ids(bpe.encode_text("a" + run + "b", PATH, P.PATTERN), PATH, P.PATTERN) == ("a" + run + "b").encode()


def test_operators_and_clashing_columns(spark, coder):
    df = spark.createDataFrame([("abc d", "x")], "text string, ids string")
    out = bpe.decode(bpe.encode(df, "text", PATH, P.PATTERN), "ids", PATH, P.PATTERN).first()
    assert bytes(out["decoded"]) == b"abc d"
    assert np.frombuffer(out["ids"], "<u4").tolist() == coder.encode_ordinary("abc d")
