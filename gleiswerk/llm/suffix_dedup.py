"""Suffix-array dedup: repeated byte strings stay in the document with the smallest id only.

The method is a common-prefix interval tree over an enhanced suffix array. A
suffix array of every byte of a corpus would be shuffled whole, so it is built
sparsely, without losing a match: each 50-byte window has an anchor, its
20-byte string of the smallest hash, and equal windows have equal anchors. The
windows that share an anchor form a segment of at most 80 bytes.

1. Documents are packed into blocks (compressed, about 2 MB of text) that are
   partitioned once and checkpointed; later steps find them in place.
2. Each block asks, for its distinct anchors, in how many documents they are;
   the answer is a flag for each: alone, repeated, or very common.
3. For repeated anchors each block sends its distinct segments, with the least
   doc_id. Very common anchors send single windows instead, keyed by the
   window, so that no anchor gathers a corpus. A bucket sorts the suffixes of
   the segments of each anchor, takes their common prefixes, scans the
   intervals with a stack, keeps those whose occurrences differ to the left
   (maximal repeats), and answers with all occurrences and the least doc_id.
4. Each block marks what a smaller doc_id also holds, and cuts it out.

A block sends one entry for any number of copies that it holds, so a string
in a third of all documents is as many entries as there are blocks at most.

Defined results: a null text is empty. Rows with one doc_id are one document:
they never make each other lose bytes. A null doc_id counts as the largest.
An empty table gives an empty one. Other columns are ignored (or kept, by
``cut_repeats``). A kept text may lose part of a multi-byte character; as
text, such remains are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, mix, prefix_hashes, record_batch, shared_dir, span_hashes, table, text_rows

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 2 << 20
#: Documents from which an anchor is handled window by window.
COMMON = 4096
#: Suffixes that are sorted at once, of whole keys (one key has at most COMMON documents' segments).
SUFFIXES = 150_000
_STEP = 1 << 19
_LAST = np.iinfo(np.int64).max
_MUL = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


# -- blocks and messages -----------------------------------------------------------


def packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of one length, and a tail, as bytes; compressed where that may pay."""
    import zstandard

    data = len(arrays[0]).to_bytes(4, "little") + b"".join(a.tobytes() for a in arrays) + tail
    return b"\1" + zstandard.ZstdCompressor(level=3).compress(data) if len(data) > 256 else b"\0" + data


def unpacked(data: bytes, *kinds: str) -> tuple[list[np.ndarray], bytes]:
    """The arrays and the tail of ``packed``."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"\1" else data[1:]
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out, data[at:]


def pack_block(ids: list[int | None], texts: list[bytes]) -> bytes:
    return packed(np.array([_LAST if i is None else i for i in ids], np.int64), np.array([len(x) for x in texts], np.int64), tail=b"".join(texts))


def open_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bounds of the documents, bytes."""
    (ids, sizes), data = unpacked(payload, "i8", "i8")
    return ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.frombuffer(data, np.uint8)


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield record_batch(BLOCKS, [[n], [pack_block(ids, texts)]])
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield record_batch(BLOCKS, [[n], [pack_block(ids, texts)]])

    return text_rows(docs).mapInArrow(run, ddl(BLOCKS))


# -- anchors and segments -------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes in a row."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(data) - gram + 1, _STEP):
        part = data[i : i + _STEP + gram - 1]
        at = np.arange(len(part) - gram + 1)
        out.append(span_hashes(prefix_hashes(part), at, at + gram))
    return np.concatenate(out)


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window and number of windows of each segment, its anchor's hash, and the hashes of all strings of ``gram`` bytes."""
    grams = gram_hashes(data, gram)
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), grams
    width, low = length - gram + 1, np.uint64(0xFFFFFF)
    anchor = np.empty(n, np.int64)
    for i in range(0, n, _STEP):
        j = min(n, i + _STEP)
        least = (grams[i : j + width - 1] & ~low) | np.arange(j + width - 1 - i, dtype=np.uint64)  # the leftmost of equal ones
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: span - width], least[width - span :])
        anchor[i:j] = (least & low).astype(np.int64) + i
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # windows never cross documents
        anchor[max(a, b - length + 1) : b] = -1
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    count = np.diff(np.concatenate([first, [n]]))
    inside = anchor[first] >= 0
    first, count = first[inside], count[inside]
    return first, count, grams[anchor[first]], grams


def content_hashes(grams: np.ndarray, start: np.ndarray, size: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of whole spans from those of their strings of ``gram`` bytes."""
    out = size.astype(np.uint64) * _MUL
    for k in range(0, int(size.max()) if len(size) else 0, gram):
        out = mix(out + grams[np.minimum(start + k, start + size - gram)])
    return out


def told_apart(data: np.ndarray, start: np.ndarray, size: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each content, and each span's content: by their hashes, whose equality is checked byte by byte."""
    _, rep, inverse = np.unique(same, return_index=True, return_inverse=True)
    of = rep[inverse]
    other = np.flatnonzero(of != np.arange(len(of)))
    equal = bool((size[other] == size[of[other]]).all())
    for i in range(0, len(other) if equal else 0, 8192):
        part = other[i : i + 8192]
        if not np.array_equal(gather(data, start[part], size[part]), gather(data, start[of[part]], size[part])):
            equal = False
    if not equal:  # two contents of one hash
        found: dict[bytes, int] = {}
        inverse = np.array([found.setdefault(data[a : a + n].tobytes(), len(found)) for a, n in zip(start.tolist(), size.tolist(), strict=True)], np.int64)
        rep = np.unique(inverse, return_index=True)[1]
    return rep, inverse


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket (stable), and (bucket, from, to) in it."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return order, []
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return order, [(int(bucket[order[i]]), int(i), int(j)) for i, j in zip(edges, [*edges[1:], len(order)], strict=True)]


class Block:
    """A block's segments, and the numbering of its questions, alike in each step."""

    def __init__(self, payload: bytes, buckets: int, length: int, gram: int):
        self.buckets, self.length, self.gram = buckets, length, gram
        self.ids, self.bounds, self.data = open_block(payload)
        self.first, self.count, self.anchor, self.grams = segments(self.data, self.bounds, length, gram)
        self.doc = np.searchsorted(self.bounds, self.first, "right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors and in how many documents of the block they are."""
        order = np.argsort(self.anchor, kind="stable")
        sorted_, docs = self.anchor[order], self.ids[self.doc[order]]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, bool)
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        differ = new.copy()
        differ[1:] |= docs[1:] != docs[:-1]
        return sorted_[at], (np.add.reduceat(differ.astype(np.int64), at) if len(at) else at)

    def ask_counts(self) -> Iterator[tuple[int, bytes]]:
        anchors, n = self.anchors()
        order, parts = by_bucket(anchors, self.buckets)
        for bucket, i, j in parts:
            own = anchors[order[i:j]] >> np.uint64(16)  # 48 bits and the bucket: two alike by chance are only looked at in vain
            yield bucket, packed((own & np.uint64(0xFFFFFFFF)).astype(np.uint32), (own >> np.uint64(32)).astype(np.uint16), np.minimum(n[order[i:j]], 65535).astype(np.uint16))

    def entries(self, flags: dict[int, bytes]) -> None:
        """From the answers to ``ask_counts``: what to send, each content once, and where it occurs."""
        anchors, _ = self.anchors()
        order, parts = by_bucket(anchors, self.buckets)
        flag = np.zeros(len(anchors), np.uint8)
        for bucket, i, j in parts:
            flag[order[i:j]] = unpacked(flags[bucket], "u1")[0][0]
        flag = flag[self.inverse]
        light, heavy = flag == 1, flag == 2
        n = self.count[heavy]
        ends = np.cumsum(n)
        windows = np.repeat(self.first[heavy] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        start = np.concatenate([self.first[light], windows])
        size = np.concatenate([self.count[light] + self.length - 1, np.full(len(windows), self.length, np.int64)])
        key = np.concatenate([self.anchor[light], content_hashes(self.grams, windows, np.full(len(windows), self.length, np.int64), self.gram)])
        same = mix(key ^ (content_hashes(self.grams, start, size, self.gram) * _MUL))
        _, self.of_entry = told_apart(self.data, start, size, same)
        order = np.argsort(self.of_entry, kind="stable")
        at = np.flatnonzero(np.diff(self.of_entry[order], prepend=-1))
        self.start = start
        docs = self.ids[np.searchsorted(self.bounds, start, "right") - 1]
        self.occurs_in = docs
        rep = order[at]
        self.entry_start, self.entry_size, self.entry_key = start[rep], size[rep], key[rep]
        self.least = np.minimum.reduceat(docs[order], at) if len(at) else docs[:0]
        self.most = np.maximum.reduceat(docs[order], at) if len(at) else docs[:0]
        self.entry_order, self.entry_parts = by_bucket(self.entry_key, self.buckets)

    def ask_repeats(self) -> Iterator[tuple[int, bytes]]:
        for bucket, i, j in self.entry_parts:
            e = self.entry_order[i:j]
            yield bucket, packed(self.entry_key[e], self.least[e], self.most[e], self.entry_size[e].astype(np.uint8), tail=gather(self.data, self.entry_start[e], self.entry_size[e]).tobytes())

    def marked(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes of the block go."""
        who, off, size, least = [], [], [], []
        for bucket, i, j in self.entry_parts:
            if bucket in answers:
                (a, b, c, d), _ = unpacked(answers[bucket], "u4", "u1", "u1", "i8")
                who.append(self.entry_order[i:j][a])
                off.append(b.astype(np.int64))
                size.append(c.astype(np.int64))
                least.append(d)
        change = np.zeros(len(self.data) + 1, np.int64)
        if who:
            who, off, size, least = (np.concatenate(x) for x in (who, off, size, least))
            order = np.argsort(who, kind="stable")
            who, off, size, least = who[order], off[order], size[order], least[order]
            n = np.bincount(who, minlength=len(self.entry_start))
            begin = np.cumsum(n) - n
            each = n[self.of_entry]  # answers for each occurrence
            ends = np.cumsum(each)
            row = np.repeat(begin[self.of_entry] - (ends - each), each) + np.arange(ends[-1])
            occurrence = np.repeat(np.arange(len(each)), each)
            go = least[row] < self.occurs_in[occurrence]
            a = (self.start[occurrence] + off[row])[go]
            np.add.at(change, a, 1)
            np.add.at(change, a + size[row][go], -1)
        return np.cumsum(change[:-1]) > 0


# -- the enhanced suffix array --------------------------------------------------


def maximal_repeats(common: list[int], left: list[int], length: int) -> list[tuple[int, int, int]]:
    """Intervals [i, j] of a suffix array with a common prefix of ``length`` at least whose occurrences differ to the left.

    common[i] is the common prefix of suffixes i and i + 1, left[i] the byte
    before suffix i (a negative number of its own where there is none). The
    stack holds open intervals: prefix, first suffix, and the byte that stands
    before all their suffixes so far (None: they differ).
    """
    out = []
    stack: list[list] = []
    for i, depth in enumerate([*common, 0]):
        begin, before = i, left[i]
        while stack and stack[-1][0] > depth:
            prefix, begin, seen = stack.pop()
            seen = seen if seen == before else None
            if seen is None:
                out.append((begin, i, prefix))
            before = seen
        if depth >= length:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != before:
                    stack[-1][2] = None
            else:
                stack.append([depth, begin, before])
        elif stack:
            raise AssertionError("intervals end below the least length")
    return out


def repeats_of(key: np.ndarray, size: np.ndarray, text: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For distinct contents, grouped by key: (content, offset, length, least doc_id) of each occurrence of a maximal repeat."""
    begin = np.cumsum(size) - size
    n = np.maximum(size - length + 1, 0)
    ends = np.cumsum(n)
    content = np.repeat(np.arange(len(n)), n)
    offset = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    rest = size[content] - offset
    widest = int(rest.max()) if len(rest) else length
    padded = np.concatenate([text, np.zeros(widest, np.uint8)])
    rows = np.empty((len(content), 8 + widest), np.uint8)
    rows[:, :8] = key[content].astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, 8:] = np.lib.stride_tricks.sliding_window_view(padded, widest)[begin[content] + offset] if len(content) else 0
    rows[:, 8:][np.arange(widest)[None, :] >= rest[:, None]] = 0
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    rows, content, offset, rest = rows[order], content[order], offset[order], rest[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1) - 8, widest) if len(rows) > 1 else np.zeros(0, np.int64)
    common = np.minimum(common, np.minimum(rest[1:], rest[:-1]))
    before = np.where(offset > 0, text[np.maximum(begin[content] + offset - 1, 0)].astype(np.int64), -1 - np.arange(len(content)))
    deep = common >= length
    edge = np.diff(np.concatenate([[0], deep.astype(np.int8), [0]]))
    who, off, long, doc = [], [], [], []
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        for a, b, prefix in maximal_repeats(common[i:j].tolist(), before[i : j + 1].tolist(), length):
            members = content[i + a : i + b + 1]
            who.append(members)
            off.append(offset[i + a : i + b + 1])
            long.append(np.full(len(members), prefix, np.int64))
            doc.append(np.full(len(members), least[members].min(), np.int64))
    if not who:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in (who, off, long, doc))


def answer_repeats(payloads: list[bytes], length: int, gram: int) -> Iterator[bytes | None]:
    """For each block's entries: (entry, offset, length, least doc_id) of what occurs elsewhere too."""
    read = [unpacked(x, "u8", "i8", "i8", "u1") for x in payloads]
    parts = [p for p, _ in read]
    key, least, size = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
    size = size.astype(np.int64)
    text = np.frombuffer(b"".join(x for _, x in read), np.uint8)
    begin = np.cumsum(size) - size
    rep, inverse = told_apart(text, begin, size, mix(key ^ (content_hashes(gram_hashes(text, gram), begin, size, gram) * _MUL)))
    first = np.full(len(rep), _LAST, np.int64)
    np.minimum.at(first, inverse, least)
    _, of_key, n = np.unique(key[rep], return_inverse=True, return_counts=True)
    one = np.arange(len(rep))  # a content is a group of its own wherever it occurs whole
    found = [(one, np.zeros(len(one), np.int64), size[rep], first)]
    many = np.flatnonzero(n[of_key] > 1)
    many = many[np.argsort(of_key[many], kind="stable")]
    ends = np.append(np.flatnonzero(np.diff(of_key[many])) + 1, len(many))  # of keys
    upto = np.concatenate([[0], np.cumsum(size[rep[many]] - length + 1)])
    i = 0
    while i < len(many):  # whole keys, as many as SUFFIXES allows
        k = int(np.searchsorted(upto[ends], upto[i] + SUFFIXES, "right")) - 1
        j = int(ends[max(k, int(np.searchsorted(ends, i, "right")))])
        part = many[i:j]
        r = rep[part]
        a, b, c, d = repeats_of(key[r], size[r], gather(text, begin[r], size[r]), first[part], length)
        found.append((part[a], b, c, d))
        i = j
    who, off, long, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(who, kind="stable")
    off, long, doc = off[order], long[order], doc[order]
    n = np.bincount(who, minlength=len(rep))
    start = np.cumsum(n) - n
    at = 0
    for p in parts:
        mine = inverse[at : at + len(p[0])]
        each = n[mine]
        ends = np.cumsum(each)
        row = np.repeat(start[mine] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        entry = np.repeat(np.arange(len(each)), each)
        go = doc[row] < p[2][entry]
        at += len(p[0])
        row, entry = row[go], entry[go]
        yield packed(entry.astype(np.uint32), off[row].astype(np.uint8), long[row].astype(np.uint8), doc[row]) if len(row) else None


# -- the steps on Spark ---------------------------------------------------------


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, spans (start and length of what goes, in bytes), kept (the remaining bytes), text_md5 (of the whole text), a row for each of ``docs``."""
    spark = docs.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, docs.rdd.getNumPartitions())
    blocks = blocks_of(docs, block_bytes).repartition(parts, "block").checkpoint()
    buckets = max(least, blocks.count() // 4, 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for bucket, said in Block(payload.as_py(), buckets, length, gram).ask_counts():
                    yield record_batch(ASKED, [[bucket], [block], [said]])

    def count(asked: pa.Table) -> pa.Table:
        parts = [unpacked(x.as_py(), "u4", "u2", "u2")[0] for x in asked.column("payload")]
        key = np.concatenate([p[0] for p in parts]).astype(np.uint64) | np.concatenate([p[1] for p in parts]).astype(np.uint64) << np.uint64(32)
        _, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([p[2] for p in parts]).astype(np.float64))
        flag = np.where(n >= common, 2, np.where(n >= 2, 1, 0)).astype(np.uint8)[inverse]
        ends = np.cumsum([len(p[0]) for p in parts]).tolist()
        said = [packed(flag[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
        return pa.table([asked.column("block"), asked.column("bucket"), pa.array([1] * len(said), pa.int32()), pa.array(said, pa.binary())], schema=ANSWERED)

    flags = materialize(blocks.mapInArrow(ask, ddl(ASKED)).groupBy("bucket").applyInArrow(count, ddl(ANSWERED)), "anchors")

    def ready(block: pa.Table, answers: pa.Table) -> tuple[Block, dict[int, dict[int, bytes]]] | None:
        if not block.num_rows:
            return None
        said: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
        for bucket, kind, payload in zip(answers.column("bucket").to_pylist(), answers.column("kind").to_pylist(), answers.column("payload"), strict=True):
            said[kind][bucket] = payload.as_py()
        own = Block(block.column("payload")[0].as_py(), buckets, length, gram)
        own.entries(said[1])
        return own, said

    def ask_again(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = list(found[0].ask_repeats()) if (found := ready(block, answers)) else []
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), pa.array([block.column("block")[0].as_py()] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], schema=ASKED)

    def answer(asked: pa.Table) -> pa.Table:
        said = list(answer_repeats([x.as_py() for x in asked.column("payload")], length, gram))
        full = pa.table([asked.column("block"), asked.column("bucket"), pa.array([2] * len(said), pa.int32()), pa.array(said, pa.binary())], schema=ANSWERED)
        return full.filter(pa.array([x is not None for x in said]))

    at_home = blocks.groupBy("block")
    repeats = at_home.cogroup(flags.groupBy("block")).applyInArrow(ask_again, ddl(ASKED)).groupBy("bucket").applyInArrow(answer, ddl(ANSWERED))
    kept = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("kept", pa.binary()), ("text_md5", pa.string())])

    def cut(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not (found := ready(block, answers)):
            return kept.empty_table()
        own, said = found
        gone = own.marked(said[2])
        rows: list[list] = [[], [], [], [], [], []]
        for doc, i, j in zip(own.ids.tolist(), own.bounds[:-1].tolist(), own.bounds[1:].tolist(), strict=True):
            mask = gone[i:j]
            edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for column, value in zip(rows, (None if doc == _LAST else doc, j - i, a, b - a, own.data[i:j][~mask].tobytes(), hashlib.md5(own.data[i:j].tobytes()).hexdigest()), strict=True):
                column.append(value)
        return pa.table([pa.array(x, f.type) for x, f in zip(rows, kept, strict=True)], schema=kept)

    done = at_home.cogroup(flags.unionByName(repeats).groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, starts array<long>, lengths array<long>, kept binary, text_md5 string")
    return done.select("doc_id", "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length")).alias("spans"), "kept", "text_md5")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes gone from text, each row its own; a null text stays null. What a row loses follows from its doc_id and text, so rows of the same ones are cut alike."""
    whole_characters = F.pandas_udf(_whole_characters, "string")
    own, doc, md5, kept = free_names(docs, "__of", "__doc", "__md5", "__kept")
    cut = repeated_spans(docs, length).where(F.size("spans") > 0).select(F.col("doc_id").alias(doc), F.col("text_md5").alias(md5), F.col("kept").alias(kept)).dropDuplicates([doc, md5])
    joined = docs.withColumn(own, F.md5(F.col("text").cast("string"))).join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(md5)), "left")
    return joined.withColumn("text", F.when(F.col(kept).isNull(), F.col("text")).otherwise(whole_characters(F.col(kept)))).select(*docs.columns)


def _whole_characters(kept: pd.Series) -> pd.Series:
    return kept.map(lambda x: None if x is None else x.decode("utf-8", "ignore"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT w.doc_id, p FROM w JOIN f ON w.s = f.s WHERE first < w.doc_id),
r AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nxt FROM sp),
k AS (SELECT q.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
      string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT))
        || CASE WHEN nxt IS NULL THEN substr(h, CAST(2 * b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY a) AS kept
      FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
