"""Packing: first-fit decreasing into sequences, in randomised groups.

Documents are tokenised inside the scan (whitespace-separated words through a
bounded cache), cut at every 2048 tokens, and only the pieces' lengths and
checksums are shuffled. Pieces fall into random groups by a hash; each group
is packed for itself with a tournament tree over the free room of its bins,
so the work grows with the input and no group grows with it.

Defined results: a null text is the end token alone. Rows with one doc_id are
packed each for itself. Full pieces are sequences of their own. An empty table
gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WORD_PIECE, Fragments, public_vocabulary
from .common import record_batch, table, text_rows

CAPACITY, END_ID, GROUP_DOCS = 2048, 1, 4096
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


@lru_cache(2)
def word_ids(path: str) -> Fragments:
    return Fragments(path, "<|startoftext|>", WORD_PIECE, True)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and the end id, cut into pieces: where each starts, its length and checksum."""
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # white space is dropped and parts words for good, so each is encoded for itself; A-Z are lower-cased in any case
                text = x.as_py() or b""
                ids = own.join((text if b"<|" in text else text.lower()).split()) + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    for column, value in zip(rows, (doc, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(value)
            yield record_batch(_PIECES, rows)

    return text_rows(docs).mapInArrow(run, kinds)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length in the order given; the leftmost bin with room, by a tournament tree of free room."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[k]: the most free room below node k
    bins, offsets = [], []
    for n in lengths:
        k = 1
        while k < leaves:
            k = 2 * k if room[2 * k] >= n else 2 * k + 1
        bins.append(k - leaves)
        offsets.append(capacity - room[k])
        room[k] -= n
        while k > 1:
            k //= 2
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
    return bins, offsets


def pack(cut: DataFrame, n_groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows of ``pieces``) with sequence_id and offset."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").drop(columns="__group")
        bins, rows["offset"] = first_fit(rows["length"].tolist(), capacity)
        rows.insert(len(rows.columns) - 1, "sequence_id", np.array(bins, np.int64) + (np.int64(key[0]) << np.int64(32)))
        return rows

    kinds = ", ".join(f"{f.name} long" for f in _PIECES) + ", sequence_id long, offset long"
    grouped = cut.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_groups)))
    return grouped.groupBy("__group").applyInPandas(run, kinds)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every document in sequences of at most ``capacity`` tokens."""
    return pack(pieces(docs, vocabulary, capacity), max(1, -(-docs.count() // group_docs)), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))
