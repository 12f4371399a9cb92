import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleiswerk.llm import bpe, packing

BYTE, WORD = bpe.public_vocabulary("byte_bpe_50k.json"), bpe.public_vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.mark.parametrize("which", ["odd", "documents", "clash"])
def test_round_trip_equals_the_library(request, byte, which):
    docs = request.getfixturevalue(which)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = byte.encode(r.text or "", add_special_tokens=False).ids
        text = byte.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, BYTE).collect())) == sorted(want)


def test_encode_gives_ids(odd, byte):
    got = {r.doc_id: r.ids for r in bpe.encode(odd, BYTE).collect()}
    assert got[1] == [] and got[6] == byte.encode("ábc   \t  \U0001f600‍\U0001f600 ΣΑΣ ΟΔΟΣ 12345 €§±", add_special_tokens=False).ids


def test_cuts_are_never_inside_a_token():
    own = bpe.Splitter(BYTE)
    assert own.cut.sum() > 5000  # most pairs of bytes
    for x in own.bytes_of[:-1]:
        assert all(not own.cut[a * 256 + b] for a, b in zip(x, x[1:], strict=False))
    assert own.split("aé b  c\n\nd1!x".encode()) == ["aé".encode(), b" b", b"  c", b"\n\nd", b"1", b"!", b"x"]


def test_fragments_in_any_order_equal_the_library(byte):
    """Apostrophes, runs of white space, signs, digits, letters of several scripts and special tokens beside each other."""
    rng = np.random.default_rng(3)
    parts = ["'", "''", "'s", "'ll", "'q", " ", "  ", "\n", "\n\n", "\t ", "\u00a0", "\u2003", "a", "Zq", "xqzj", "é", "É", "ß", "ñ1", "12", "3", "!", "!(", "<|", "<|endoftext|>", "漢字", "Σας", "\U0001f600", "\x1c", "\x85", "e\u0301", "-", "\\", "½", "ª"]
    own = bpe.Splitter(BYTE)
    word, words = Tokenizer.from_file(WORD), packing.word_ids(WORD)
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids, repr(text)
        raw = text.encode()
        assert np.frombuffer(words.join((raw if b"<|" in raw else raw.lower()).split()), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids, repr(text)


def test_empty(none):
    assert bpe.round_trip(none, BYTE).count() == 0
    assert packing.pack_documents(none, WORD).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(7)
    lengths = sorted(rng.integers(1, 2049, 500).tolist(), reverse=True)
    rooms, want = [], []
    for n in lengths:
        k = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if k == len(rooms):
            rooms.append(2048)
        want.append((k, 2048 - rooms[k]))
        rooms[k] -= n
    assert list(zip(*packing.first_fit(lengths, 2048), strict=True)) == want


@pytest.mark.parametrize("which", ["odd", "documents", "clash"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    rows = packing.pack_documents(docs, WORD).toPandas()
    own = Tokenizer.from_file(WORD)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted(want) == sorted(rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None))
    for _, x in rows.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == [0, *x.length.cumsum().tolist()[:-1]] and x.length.sum() <= 2048
    if which == "documents":
        padded = 2048 * rows.sequence_id.nunique() - rows.length.sum()
        assert padded < 0.03 * rows.length.sum() + 2048
