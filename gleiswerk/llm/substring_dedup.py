"""Substring dedup by level-wise doubling: word sequences that occur twice anywhere lose all their occurrences.

A window of ``window`` words can only be repeated if the shorter windows inside
it are. So short windows are tested first, and only those that are repeated
are extended to about twice their length (9, 18 and 35 words for 35), until the
length asked for is reached or no candidates survive.

1. Documents are packed into blocks (compressed, about 2 MB of text), which are
   partitioned once and checkpointed; later steps find them in place.
2. The shortest windows that are tested are those of the least hash in some
   window of full length. Each window of full length holds one, and equal ones
   hold the same, so a thirteenth of all positions stands for all.
3. A survivor is extended to twice its length to the right and to the left (one
   of both stays inside each window of full length around it); at the last
   level all windows of full length around a survivor are tested.
4. A level is one exchange: each block sends the distinct hashes of its
   candidates, each with whether the block holds it twice, and is answered with
   a bit for each. Hashes have 64 bits, with 32 more at the last level. A block
   sends one entry for any number of copies that it holds, so a window in a
   third of all documents is as many entries as there are blocks at most.
5. Each block marks the words of windows that survived the last level.

Windows never cross rows. They are judged on the input, not on what is left,
and no occurrence stays, the first neither.

Defined results: a null text has no words. A text without words, or with fewer
than ``window``, loses nothing by itself. Each row is a document of its own,
so rows of one doc_id, or equal rows, remove each other's windows; a null
doc_id is kept as null. Windows that overlap their own copy (``a a a ...``) are
repeated. A very long text is a block of its own. An empty table gives an empty
one. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix, powers, prefix_hashes, record_batch, shared_dir, span_hashes, table, words_of
from .suffix_dedup import _LAST, ANSWERED, ASKED, BLOCK_BYTES, blocks_of, by_bucket, ddl, open_block, packed, unpacked

WINDOW = 35
#: A window of fewer than twice so many words isn't halved again.
SHORTEST = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("kept", pa.string())])


def doubling(window: int, shortest: int = SHORTEST) -> list[int]:
    """The lengths of the levels: each at most twice the one before, the last is ``window``."""
    out = [window]
    while out[0] >= 2 * shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - width + span], values[width - span :]) if span < width else values


class Words:
    """A block's words, and its candidates at each level, alike in each step."""

    def __init__(self, payload: bytes, buckets: int, lengths: list[int]):
        self.buckets, self.lengths = buckets, lengths
        self.ids, bounds, data = open_block(payload)
        raw = [data[i:j].tobytes() for i, j in pairwise(bounds.tolist())]
        self.data, self.starts, self.ends, self.first = words_of(raw)
        n = len(self.starts)
        self.rest = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)  # words from here to the document's end
        words = span_hashes(prefix_hashes(self.data), self.starts, self.ends)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(n)[0][:n])]) for x in (words, mix(words ^ _OTHER))]

    def hashes(self, at: np.ndarray, length: int, k: int = 0) -> np.ndarray:
        """A hash of the window of ``length`` words at each position of ``at``."""
        down = powers(len(self.sums[k]))[1]
        return mix((self.sums[k][at + length] - self.sums[k][at]) * down[at] + np.uint64(length * int(_MUL) % (1 << 64)))

    def anchors(self) -> np.ndarray:
        """The shortest windows of the least hash in some window of full length."""
        short, window = self.lengths[0], self.lengths[-1]
        n = len(self.starts) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        width = window - short + 1
        every = self.hashes(np.arange(n + width - 1), short) | np.uint64(1)
        least = np.where(self.rest[:n] >= window, sliding(every, width, np.minimum), np.uint64(0))
        edge = np.zeros(width - 1, np.uint64)
        return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == every)

    def extended(self, level: int, survivors: np.ndarray) -> np.ndarray:
        """The windows of ``level`` that hold survivors of the level before."""
        short, length = self.lengths[level - 1], self.lengths[level]
        n = len(self.starts)
        if level < len(self.lengths) - 1:
            at = np.union1d(survivors, survivors + short - length)
        else:
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, np.maximum(survivors + short - length, 0), 1)
            np.add.at(change, survivors + 1, -1)
            at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        at = at[(at >= 0) & (at < n)]
        return at[self.rest[at] >= length]

    def replay(self, answers: dict[int, dict[int, bytes]], ask: int | None = None) -> Iterator[tuple[int, bytes]] | np.ndarray:
        """What to ask at level ``ask``, by the answers so far; or the positions that survive all levels."""
        at = np.zeros(0, np.int64)
        for level, length in enumerate(self.lengths):
            at = self.extended(level, at) if level else self.anchors()
            keys, rep, inverse, counts = np.unique(self.hashes(at, length), return_index=True, return_inverse=True, return_counts=True)
            order, parts = by_bucket(keys, self.buckets)
            if level == ask:
                more = (self.hashes(at[rep], length, 1) >> np.uint64(32)).astype(np.uint32)
                return self.questions(keys, more, counts, order, parts)
            flag = np.zeros(len(keys), bool)
            said = answers.get(level, {})
            for bucket, i, j in parts:
                if bucket in said:
                    flag[order[i:j]] = np.unpackbits(np.frombuffer(said[bucket], np.uint8), count=j - i).astype(bool)
            at = at[flag[inverse]]
        return at

    def questions(self, keys: np.ndarray, more: np.ndarray, counts: np.ndarray, order: np.ndarray, parts: list[tuple[int, int, int]]) -> Iterator[tuple[int, bytes]]:
        for bucket, i, j in parts:
            e = order[i:j]
            yield bucket, packed(keys[e], more[e], (counts[e] > 1).astype(np.uint8))

    def gone(self, survivors: np.ndarray) -> np.ndarray:
        """Which words a surviving window of full length covers."""
        change = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(change, survivors, 1)
        np.add.at(change, survivors + self.lengths[-1], -1)
        return np.cumsum(change[:-1]) > 0


def repeated(payloads: list[bytes]) -> Iterator[bytes | None]:
    """For each block's hashes a bit: it occurs twice in all (None: none does)."""
    read = [unpacked(x, "u8", "u4", "u1")[0] for x in payloads]
    key, more, twice = (np.concatenate([r[k] for r in read]) for k in range(3))
    order = np.lexsort((more, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    flag = np.bincount(group, 1 + twice)[group] >= 2
    ends = np.cumsum([len(r[0]) for r in read]).tolist()
    for i, j in zip([0, *ends], ends, strict=False):
        yield np.packbits(flag[i:j]).tobytes() if flag[i:j].any() else None


def cut_substrings(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (start and length of what goes, in words), kept (the remaining words, joined by one space), a row for each of ``docs``."""
    spark = docs.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    lengths = doubling(window, shortest)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks_of(docs, block_bytes).repartition(max(least, docs.rdd.getNumPartitions()), "block").checkpoint()
    buckets = max(least, blocks.count() // 4, 1)

    def opened(block: pa.Table, answers: pa.Table) -> tuple[Words, dict[int, dict[int, bytes]]] | None:
        if not block.num_rows:
            return None
        said: dict[int, dict[int, bytes]] = {}
        for bucket, level, payload in zip(answers.column("bucket").to_pylist(), answers.column("kind").to_pylist(), answers.column("payload"), strict=True):
            said.setdefault(level, {})[bucket] = payload.as_py()
        return Words(block.column("payload")[0].as_py(), buckets, lengths), said

    def asking(level: int):
        def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
            found = opened(block, answers)
            rows = list(found[0].replay(found[1], level)) if found else []
            return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([block.column("block")[0].as_py()] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], schema=ASKED)

        return ask

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for bucket, said in Words(payload.as_py(), buckets, lengths).replay({}, 0):
                    yield record_batch(ASKED, [[bucket], [block], [said]])

    def answering(level: int):
        def answer(asked: pa.Table) -> pa.Table:
            said = list(repeated([x.as_py() for x in asked.column("payload")]))
            full = pa.table([asked.column("block"), asked.column("bucket"), pa.array([level] * len(said), pa.int32()), pa.array(said, pa.binary())], schema=ANSWERED)
            return full.filter(pa.array([x is not None for x in said]))

        return answer

    def cut(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not (found := opened(block, answers)):
            return _KEPT.empty_table()
        own, said = found
        gone = own.gone(own.replay(said))
        rows: list[list] = [[], [], [], [], []]
        for doc, i, j in zip(own.ids.tolist(), own.first[:-1].tolist(), own.first[1:].tolist(), strict=True):
            edge = np.diff(np.concatenate([[0], gone[i:j].astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            stay = np.flatnonzero(~gone[i:j]) + i
            kept = b" ".join(own.data[s:e].tobytes() for s, e in zip(own.starts[stay].tolist(), own.ends[stay].tolist(), strict=True))
            for column, value in zip(rows, (None if doc == _LAST else doc, j - i, a, b - a, kept.decode()), strict=True):
                column.append(value)
        return pa.table([pa.array(x, f.type) for x, f in zip(rows, _KEPT, strict=True)], schema=_KEPT)

    at_home = blocks.groupBy("block")
    answers: list[DataFrame] = []
    for level in range(len(lengths)):
        so_far = answers[0] if answers else None
        for more in answers[1:]:
            so_far = so_far.unionByName(more)
        asked = blocks.mapInArrow(ask_first, ddl(ASKED)) if so_far is None else at_home.cogroup(so_far.groupBy("block")).applyInArrow(asking(level), ddl(ASKED))
        answers.append(materialize(asked.groupBy("bucket").applyInArrow(answering(level), ddl(ANSWERED)), f"level{lengths[level]}"))
        if answers[-1].isEmpty():  # no candidates survive
            discard(*answers[:-1])
            answers = answers[-1:]
            break
    so_far = answers[0]
    for more in answers[1:]:
        so_far = so_far.unionByName(more)
    done = at_home.cogroup(so_far.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, starts array<long>, lengths array<long>, kept string")
    return done.select("doc_id", "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length")).alias("spans"), "kept")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cut_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, p, array_to_string(ws[p:p + 34], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35)),
f AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT DISTINCT r, p + unnest(range(0, 35)) AS q FROM w JOIN f ON w.s = f.s),
k AS (SELECT d.r, e.q, e.x FROM d, LATERAL (SELECT unnest(ws) AS x, generate_subscripts(ws, 1) AS q) e),
s AS (SELECT k.r, string_agg(x, ' ' ORDER BY k.q) AS kept FROM k ANTI JOIN g ON k.r = g.r AND k.q = g.q GROUP BY k.r),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r LEFT JOIN n ON d.r = n.r
"""
