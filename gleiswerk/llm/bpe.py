"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token is a certain cut: no
merge can cross it. Pairs are tested against the vocabulary; a text is cut at
all of them that leave what the tokenizer sees on both sides as it was: not
after white space (whose runs it divides by what follows), not before an
apostrophe (whose endings it tells by what precedes), and between whole
characters. Fragments are encoded independently; a fragment's ids are looked up
in a bounded cache of the task, and only new ones go to the vocabulary's
merges. Ids are then concatenated, and decoded through the vocabulary's bytes.

Defined results: null is the empty text (no ids, empty decoded text); rows
with one doc_id are encoded each for itself; a null doc_id stays null; the
special token's string in a text is that token, as in the library. An empty
table gives an empty one. A text is one value of one task, however long: its
fragments take some 60 bytes for each word there. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import record_batch, table, text_rows

#: Entries of a task's fragment cache before it starts anew.
CACHE = 800_000
#: Letters of ASCII and Latin-1 as UTF-8: a change of case or of form never adds or takes characters there.
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_SIGNS = rb"[!-&(-/:-@\[-`{-~]+"
#: What is one piece to a tokenizer of words, and to one of bytes; anything else goes to the library whole.
WORD_PIECE = re.compile(_LETTERS + rb"|[0-9]|" + _SIGNS)
BYTE_PIECE = re.compile(rb" ?" + _LETTERS + rb"| ?[0-9]+| ?" + _SIGNS + rb"|\s+(?!\S)|\s+")
#: White space beyond ASCII, as UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Fragments:
    """Fragment -> little-endian ids, filled as fragments are met.

    A fragment of whole pieces is encoded piece by piece through the model's
    merges. Others are joined by the special token, which splits a text before
    anything else, and go to the tokenizer together; so each is encoded as if
    alone.
    """

    def __init__(self, path: str, special: str, piece: re.Pattern[bytes], lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.piece, self.lower = piece, lower
        self.written = {b: c for c, b in byte_alphabet().items()}
        self.known: dict[bytes, bytes] = {}  # a plain dict: sets are compared with it key by key
        self.pieces: dict[bytes, bytes] = {}
        self.special = special
        self.special_id = self.tokenizer.token_to_id(special)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def of_piece(self, x: bytes) -> bytes:
        said = (x.decode().lower().encode() if self.lower else x).decode("latin-1").translate(self.written)
        found = self.pieces[x] = struct.pack(f"<{len(ids := self.model.tokenize(said))}I", *[t.id for t in ids])
        return found

    def learn(self, fragments: set[bytes]) -> None:
        plain = []
        pieces, known, split = self.pieces, self.known, self.piece.findall
        for x in fragments:
            if b"<|" in x or b"|>" in x:
                known[x] = self.ids(x.decode("utf-8", "replace")).tobytes()
            elif sum(map(len, parts := split(x))) == len(x):
                known[x] = b"".join([pieces.get(p) or self.of_piece(p) for p in parts])
            else:
                plain.append(x)
        for i in range(0, len(plain), 64):
            part = plain[i : i + 64]
            ids = self.ids(self.special.join(x.decode("utf-8", "replace") for x in part))
            ends = np.flatnonzero(ids == self.special_id)
            data = ids.tobytes()
            for x, a, b in zip(part, [0, *((ends + 1) * 4).tolist()], [*(ends * 4).tolist(), len(data)], strict=True):
                known[x] = data[a:b]

    def join(self, fragments: list[bytes]) -> bytes:
        if new := set(fragments).difference(self.known):
            if len(self.known) > CACHE:
                self.known.clear()
                new = set(fragments)
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            self.learn(new)
        return b"".join(map(self.known.__getitem__, fragments))


class Splitter:
    """Certain cuts of a byte-level vocabulary, and its ids as bytes."""

    def __init__(self, path: str):
        self.fragments = Fragments(path, "<|endoftext|>", BYTE_PIECE, False)
        alphabet = byte_alphabet()
        vocabulary = self.fragments.tokenizer.get_vocab(with_added_tokens=True)
        self.special = self.fragments.special.encode()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        inside = np.zeros((256, 256), bool)
        for token, i in vocabulary.items():
            x = self.special if i == self.fragments.special_id else bytes(alphabet[c] for c in token)
            self.bytes_of[i] = x
            if i != self.fragments.special_id:
                b = np.frombuffer(x, np.uint8)
                inside[b[:-1], b[1:]] = True
        cut = ~inside
        cut[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False  # after white space
        cut[:, 0x27] = False
        cut[:, 0x80:0xC0] = False  # inside a character
        self.cut = cut.ravel()
        self.cut_ascii = self.cut.copy()
        self.cut_ascii[0x80 * 256 :] = False

    def split(self, part: bytes) -> list[bytes]:
        if len(part) < 2:
            return [part] if part else []
        b = np.frombuffer(part, np.uint8)
        cut = self.cut_ascii if _WIDE_SPACE.search(part) else self.cut
        at = (np.flatnonzero(cut[(b[:-1].astype(np.uint16) << np.uint16(8)) | b[1:]]) + 1).tolist()
        return [part[i:j] for i, j in zip([0, *at], [*at, len(part)], strict=True)]

    def encode(self, text: bytes) -> bytes:
        special = np.array([self.fragments.special_id], "<u4").tobytes()
        return special.join(self.fragments.join(self.split(part)) for part in text.split(self.special))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of each document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(vocabulary)
        for batch in batches:
            yield record_batch(_OUT, [batch.column(0), pa.array([np.frombuffer(own.encode(x or b""), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of each document's ids and of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(vocabulary)
        said = [str(i) for i in range(len(own.bytes_of))]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                ids = np.frombuffer(own.encode(x.as_py() or b""), "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(said.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield record_batch(_DIGEST, [batch.column(0), n, ids_sha, text_sha])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))
