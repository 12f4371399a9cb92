"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct 5-word shingles (64-bit hashes). Equal
sets (128-bit digests) are one node, so copies never meet as pairs. The join
is exact:

1. All tokens have one global order: by a level, then by hash. Levels come from
   a sketch of SLOTS counters over the whole corpus (a fixed size whatever the
   input), rare tokens first. The first token that two sets of similarity t
   share is among the first n - ceil(t n) + 1 of both, and among the first
   n - ceil(2 t n / (1 + t)) + 1 of the smaller one: there it is an index token.
2. Prefix tokens of distinct sets are looked up by token; those in two sets or
   more are the open rows.
3. Similar documents are partitioned into groups: a set goes to the cell of the
   highest of its open index tokens (by coarse level, then by hash, so that most
   near copies of one text have the same) and of its size class (one without any
   is only ever a query), a cell is dealt out into groups of about GROUP_MEMBERS
   sets. The matrix of tokens and cells tells which cells a query shares how
   many prefix tokens with; too few for any size in the cell rule it out. Only
   tokens that are an index token of some set count (those left out of a query
   are allowed for), and only sets with a cell are in the matrix. Of two cells
   the lower asks: near copies that lack a token are in a lower cell than the
   many that have it, so the few ask the many. Pairs of set and cell are made
   only where both have open tokens enough to be similar, and not at the half of
   the tokens that they must share that most sets have: the rest tell as well.
   Texts that share a long common part, but too little to be similar, have no
   index token in common, so their number costs nothing here, however many they
   are.
4. Each group stores the union of its members' tokens, and at which places of
   the union each member is. A query's tokens are looked up in the union, which
   bounds its overlap with every member; only a group that can qualify is
   opened, and all its members are then compared at once. A query is linked
   with one member of each component inside the group. Queries meet the first
   group of a cell; the others are asked in a second round, and only those that
   are not wholly in the query's component by then.
5. Links become components by alternating large and small stars, each round
   written to the shared folder.

Defined results: null text and text without words are empty sets, linked with
nothing; fewer than five words are one shingle. Rows with one doc_id are each
a row of the result. A null doc_id stays null and may be in a component, whose
id is the smallest known one. An empty table gives an empty one. A text is one
value of one task, however long; its shingles take some 30 times its words'
number of bytes there. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, chunks, discard, free_names, materialize, mix, ngram_hashes, prefix_hashes, record_batch, span_hashes, table, text_rows, with_rows, words_of

WORDS = 5
#: Similarity as a fraction: 75 / 100.
OVER, OF = 75, 100
#: Counters of the sketch that orders tokens by how common they are, and the slices they are summed in.
SLOTS, SLICES = 1 << 22, 64
#: Tokens a task gathers before it sends the prefixes of what it has.
GATHER = 2_000_000
#: Sets and tokens of a group, and of the queries that meet it in one task. A longer set is a group of its own.
GROUP_MEMBERS, GROUP_TOKENS, GROUP_QUERIES = 64, 200_000, 512
#: Sizes of a class differ by this factor at most.
SIZE_STEP = 1.1
#: Levels that count as one where a set's cell is told: a factor of 16.
COARSE = 32
#: Places that wanted rows are hashed to, to leave other texts out of a shuffle: a bitmap of so many bits at most (2 MB) is broadcast.
PLACES = 1 << 24
#: Parts that a star's center is dealt out to.
SALTS = 8
#: Sets of more than a HOT-th of all rows (so fewer than HOT sets) are named by a broadcast.
HOT = 1000


def shingle_sets(raw: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    out = []
    for i, j in chunks(raw):
        part = [x.lower() for x in raw[i:j]]  # of bytes: A-Z alone
        data, starts, ends, first = words_of(part)
        words = span_hashes(prefix_hashes(data), starts, ends)
        grams = ngram_hashes(words, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                out.append(mix(ngram_hashes(words[a:b], b - a) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def short(digest: bytes) -> int:
    """64 bits of a digest: sets that share them by chance are told apart later."""
    return int.from_bytes(digest[:8], "little", signed=True)


def prefix_size(n: int, over: int = OVER, of: int = OF) -> int:
    return n + (-over * n) // of + 1


def index_size(n: int, over: int = OVER, of: int = OF) -> int:
    """Of a set of n tokens, the smaller of two similar ones, where the first shared token must be."""
    return n + (-2 * over * n) // (over + of) + 1


def least_shared(n: Column, lo: Column, hi: Column, over: int = OVER, of: int = OF) -> Column:
    """How many tokens the prefixes of a set of n tokens and of a similar one of lo to hi tokens share at least.

    The overlap must be at least over / (over + of) of both sizes together, and
    all but the last tokens of the side whose prefix ends first may be outside
    of the prefixes. It falls from both ends of the sizes by rounding alone.
    """
    rest = lambda x: F.ceil(x * over / of)
    at = lambda m: F.ceil((n + m) * over / (over + of)) - F.greatest(rest(n), rest(m)) + 1
    return F.greatest(F.least(at(F.greatest(lo, F.ceil(n * over / of))), at(F.least(hi, F.floor(n * of / over)))) - 2, F.lit(1))


# -- sets and the order of tokens -------------------------------------------------------

_SETS = pa.schema([(ROW, pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("h", pa.int64()), ("md5", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])


def sets_of_documents(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, n_shingles, digest (null for the empty set) of each document; and of each task, slice and counts of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counters = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            sets = shingle_sets(texts)
            if sets:
                counters += np.bincount((np.concatenate(sets) >> np.uint64(42)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
            n = batch.num_rows
            digests = [digest_of(x) if len(x) else None for x in sets]
            yield record_batch(_SETS, [batch.column(2), batch.column(0), [len(x) for x in sets], digests, [d and short(d) for d in digests], [hashlib.md5(x).digest() for x in texts], [None] * n, [None] * n])
        said = [(k, zstandard.compress(x.tobytes(), 1)) for k, x in enumerate(counters.reshape(SLICES, -1)) if x.any()]
        none = [None] * len(said)
        yield record_batch(_SETS, [none, none, none, none, none, none, [k for k, _ in said], [x for _, x in said]])

    return text_rows(docs, ROW).mapInArrow(run, f"{ROW} long, doc_id long, n_shingles long, digest binary, h long, md5 binary, slice int, counts binary")


def token_levels(sketch: DataFrame) -> np.ndarray:
    """How common the tokens of each slot are, an eighth of a power of two for each level: SLOTS bytes."""
    schema = pa.schema([("slice", pa.int32()), ("levels", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        total = np.zeros(SLOTS // SLICES, np.float64)
        for x in rows.column("counts"):
            total += np.frombuffer(zstandard.decompress(x.as_py()), np.uint32)
        levels = np.clip(8 * np.log2(np.maximum(total, 1)), 0, 255).astype(np.uint8)
        return pa.table([rows.column("slice")[:1], pa.array([levels.tobytes()], pa.binary())], schema=schema)

    out = np.zeros((SLICES, SLOTS // SLICES), np.uint8)
    for r in materialize(sketch.groupBy("slice").applyInArrow(run, "slice int, levels binary"), "levels").collect():  # SLICES rows, SLOTS bytes
        out[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


# -- open tokens ----------------------------------------------------------------------

_SENT = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("token", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("level", pa.int32()), ("index", pa.bool_())])
_OPEN = pa.schema([("token", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("level", pa.int32()), ("index", pa.bool_())])
#: Low bits of a token that are sent; its bucket has others.
SENT_BITS = 32
_SHIFT = np.uint64(SENT_BITS)
_LOW = np.uint64((1 << SENT_BITS) - 1)


def _alike(x: np.ndarray) -> np.ndarray:
    """Of a sorted array: which values are there more than once."""
    out = np.zeros(len(x), bool)
    if len(x):
        same = x[1:] == x[:-1]
        out[1:] |= same
        out[:-1] |= same
    return out


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, all first bytes first: such planes compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _of_planes(data: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def packed_prefixes(h: np.ndarray, n: np.ndarray, owner: np.ndarray, low: np.ndarray, rank: np.ndarray, index: np.ndarray, mark: np.ndarray) -> bytes:
    """Sets (h, n) and their tokens in order (the set's number, the low SENT_BITS bits, level, two flags), compressed."""
    import zstandard

    head = np.array([len(h), len(low)], np.uint32).tobytes()
    tokens = _planes(owner, 4) + _planes(np.diff(low, prepend=np.uint64(0)), 4) + rank.tobytes() + np.packbits(index).tobytes() + np.packbits(mark).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + h.tobytes() + n.astype(np.int32).tobytes() + tokens)


def unpacked_prefixes(data: bytes) -> tuple[np.ndarray, ...]:
    """h and n of each token's set, the low bits, level and flags of the token."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    sets, n = np.frombuffer(data, np.uint32, 2).tolist()
    at = 8 + 12 * sets
    own = _of_planes(data, n, 4, at).astype(np.int64)
    low = np.cumsum(_of_planes(data, n, 4, at + 4 * n), dtype=np.uint64)
    bits = (n + 7) // 8
    flags = [np.unpackbits(np.frombuffer(data, np.uint8, bits, at + 9 * n + k * bits), count=n).astype(bool) for k in range(2)]
    return np.frombuffer(data, np.int64, sets, 8)[own], np.frombuffer(data, np.int32, sets, 8 + 8 * sets)[own], low, np.frombuffer(data, np.uint8, n, at + 8 * n), *flags


def prefix_tokens(docs: DataFrame, levels: np.ndarray, buckets: int, known: bool) -> DataFrame:
    """Prefix tokens of distinct sets, as far as a task knows.

    ``known``: tokens that two sets of a task share, which are open, as rows of
    token, h, n, level, index. Else: each other token, and one mark for each of these, goes to a bucket as part
    of a payload, so a token of very many sets is one entry from each task.
    The low SENT_BITS bits and the bucket tell tokens apart (a false match costs a
    comparison).
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def send(found: dict[bytes, np.ndarray]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        tokens, ranks, sizes, early = [], [], [], []
        for x in found.values():
            level = level_of[x >> np.uint64(42)]
            first = np.argsort(level, kind="stable")[: prefix_size(len(x))]
            tokens.append(x[first])
            ranks.append(level[first])
            sizes.append(len(x))
            early.append(np.arange(len(first)) < index_size(len(x)))
        h = np.array([short(d) for d in found], np.int64)
        n = np.array(sizes, np.int32)
        owner = np.repeat(np.arange(len(n)), [len(x) for x in tokens])
        token, rank, index = np.concatenate(tokens), np.concatenate(ranks), np.concatenate(early)
        bucket = ((token >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        token = token & _LOW | bucket.astype(np.uint64) << _SHIFT
        order = np.argsort(token, kind="stable")
        token, rank, owner, index = token[order], rank[order], owner[order], index[order]
        twice = _alike(token)
        if known and twice.any():
            none = np.full(int(twice.sum()), None)
            yield record_batch(_SENT, [pa.array(none, pa.int32()), pa.array(none, pa.binary()), token[twice].view(np.int64), h[owner[twice]], n[owner[twice]], rank[twice].astype(np.int32), index[twice]])
        if known:
            return
        once = np.ones(len(token), bool)
        once[1:] = token[1:] != token[:-1]
        token, rank, owner, index, mark = token[once], rank[once], np.where(twice, -1, owner)[once], index[once], twice[once]
        at = np.flatnonzero(np.diff((token >> _SHIFT).astype(np.int64), prepend=-1))
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(token)], strict=True):
            mine, own = np.unique(owner[i:j], return_inverse=True)
            said = packed_prefixes(np.where(mine < 0, 0, h[mine]), np.where(mine < 0, 0, n[mine]), own, token[i:j] & _LOW, rank[i:j], index[i:j], mark[i:j])
            yield record_batch(_SENT, [[int(token[i] >> _SHIFT)], [said], [None], [None], [None], [None], [None]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, np.ndarray] = {}
        size = 0
        for batch in batches:
            for x in shingle_sets([x or b"" for x in batch.column(1).to_pylist()]):
                if len(x) and (own := digest_of(x)) not in found:
                    found[own] = x
                    size += len(x)
            if size >= GATHER:
                yield from send(found)
                found, size = {}, 0
        if found:
            yield from send(found)

    return text_rows(docs).mapInArrow(run, "bucket int, payload binary, token long, h long, n int, level int, index boolean")


def met_in_buckets(sent: DataFrame) -> DataFrame:
    """Open rows of tokens that tasks told of apart: two sets of different tasks have them, or a mark tells of others."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = np.uint64(rows.column("bucket")[0].as_py())
        parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for x in rows.column("payload"):
            for column, value in zip(parts, unpacked_prefixes(x.as_py()), strict=True):
                column.append(value)
        h, size, token, rank, index, mark = (np.concatenate(x) for x in parts)
        order = np.lexsort((h, token))
        h, size, token, rank, index, mark = h[order], size[order], token[order], rank[order], index[order], mark[order]
        new = np.ones(len(token), bool)  # a set of several tasks is there once
        new[1:] = (token[1:] != token[:-1]) | (h[1:] != h[:-1])
        new |= mark
        h, size, token, rank, index, mark = h[new], size[new], token[new], rank[new], index[new], mark[new]
        keep = _alike(token) & ~mark
        return pa.table([(token[keep] | bucket << _SHIFT).view(np.int64), h[keep], size[keep].astype(np.int32), rank[keep].astype(np.int32), index[keep]], schema=_OPEN)

    return sent.where("payload is not null").groupBy("bucket").applyInArrow(run, "token long, h long, n int, level int, index boolean")


# -- cells, groups, and the matrix -------------------------------------------------------


def with_cells(rows: DataFrame) -> DataFrame:
    """(token, h, n, cell, unheld, held, place) of the open rows (token, h, n, level, index) whose token is an index token of some set: the cell of their set (its highest open index token and its size class, or null), how many of the set's open rows are left out and are here, and the row's place among these, tokens of most sets first.

    Cells are in the order of their tokens, sizes last.
    """
    tokens = rows.groupBy("token").agg(F.max("index").alias("any"), F.count("*").alias("sets")).where("any").select("token", "sets")
    of_set = Window.partitionBy("h", "n")  # a set's rows: one document's at most
    place = F.row_number().over(of_set.orderBy(F.desc_nulls_last("sets"), "token")) - 1
    top = F.max(F.when(F.col("index"), F.struct(F.floor(F.col("level") / COARSE).alias("coarse"), F.xxhash64("token").alias("mark")))).over(of_set)
    held = F.count("sets").over(of_set)
    size = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP)))  # under 256
    cell = F.when(F.col("top").isNotNull(), F.shiftleft("top.coarse", 59).bitwiseOR(F.shiftleft(F.shiftrightunsigned("top.mark", 13), 8)).bitwiseOR(size))
    known = rows.join(tokens, "token", "left").withColumn("place", place).withColumn("top", top).withColumn("held", held.cast("int")).withColumn("unheld", (F.count("*").over(of_set) - held).cast("int"))
    return known.where("sets is not null").select("token", "h", "n", cell.alias("cell"), "unheld", "held", "place")


def members_of_cells(marked: DataFrame) -> DataFrame:
    """h, n, cell, g, parts of each set that has a cell: its group, and how many groups its cell is dealt out to."""
    members = marked.where("cell is not null").select("h", "n", "cell").distinct()
    parts = members.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / GROUP_MEMBERS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts"))
    return members.join(parts, "cell").select("h", "n", "cell", F.xxhash64("cell", F.pmod(F.xxhash64("h", "n"), "parts")).alias("g"), "parts")


def asked_pairs(marked: DataFrame) -> DataFrame:
    """(h, n, of, least), once for each held token that a query and a cell meet at; at least ``least`` of the pair's rows are needed for a similar set.

    Rows that can't belong to a similar pair are left out as the matrix is
    joined: by size, where the query or all sets of the cell with the token have
    fewer open tokens than the pair must share, and cells of no smaller set than
    a query without a cell (of two similar sets the smaller has an open index
    token). Of the tokens that a pair must share, half may be the query's most
    common ones; these are left out, and the others still needed.
    """
    matrix = marked.where("cell is not null").groupBy("token", F.col("cell").alias("of")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("held") + F.col("unheld")).alias("most"))
    shared = least_shared(F.col("n"), F.col("lo"), F.col("hi"))
    need = F.greatest(shared - F.col("unheld"), F.lit(1))
    left_out = F.floor((need - 1) / 2)
    order = F.col("cell") < F.col("of")
    fits = (F.col("n") * OVER <= F.col("hi") * OF) & (F.col("lo") * OVER <= F.col("n") * OF)
    able = (shared <= F.col("held") + F.col("unheld")) & (shared <= F.col("most"))
    met = marked.join(matrix, "token").where((order | F.col("cell").isNull() & (F.col("lo") < F.col("n"))) & fits & able & (F.col("place") >= left_out))
    return met.select("h", "n", "of", (need - left_out).alias("least"))


def asked_cells(marked: DataFrame, members: DataFrame) -> DataFrame:
    """(h, n, own, of, parts): the cells that a query may have a similar set in, by the matrix of tokens and cells; own is its group in that cell, or null.

    Of two cells the lower asks; a set without a cell always does. A cell of
    several groups is asked by its own members, too.
    """
    cells = members.groupBy(F.col("cell").alias("of")).agg(F.max("parts").alias("parts"))
    # the rows of one similar set are as many as any of them says
    enough = asked_pairs(marked).groupBy("h", "n", "of").agg(F.count("*").alias("met"), F.min("least").alias("least")).where("met >= least")
    across = enough.join(cells, "of").select("h", "n", F.lit(None).cast("long").alias("own"), "of", "parts")
    inside = members.where("parts > 1").select("h", "n", F.col("g").alias("own"), F.col("cell").alias("of"), "parts")
    return across.unionByName(inside)


def with_texts(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """``dealt`` (set_id, g, part, parts) with each set's text; set_id is the ROW of one document. A bitmap of fixed size keeps nearly all other texts out of the shuffle."""
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(PLACES))
    bits = dealt.groupBy(F.bitmap_bucket_number(place("set_id")).alias("of")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("set_id"))).alias("bits"))
    at = F.bitmap_bit_position(place(ROW)).cast("int")
    byte = F.conv(F.hex(F.col("bits").substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = text_rows(docs, ROW).withColumn("of", F.bitmap_bucket_number(place(ROW))).join(F.broadcast(bits), "of").where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
    return near.select(ROW, "text").join(dealt, F.col(ROW) == F.col("set_id")).select("set_id", "g", "part", "parts", "text")


class Group:
    """A group's members, the union of their tokens, and each member's component among them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, inner: np.ndarray, union: np.ndarray, places: np.ndarray):
        self.ids, self.sizes, self.inner, self.union, self.places = ids, sizes, inner, union, places

    @classmethod
    def of(cls, ids: list[int], sets: list[np.ndarray], over: int = OVER, of: int = OF) -> Group:
        union, places = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets], np.int64)
        group = cls(np.array(ids, np.int64), sizes, np.arange(len(ids)), union, places.astype(np.int32))
        both = np.zeros((len(ids), len(ids)))
        held = group.matrix()
        for i in range(0, len(union), 16384):
            part = held[i : i + 16384].astype(np.float32)
            both += part.T @ part
        like = of * both >= over * (sizes[:, None] + sizes[None, :] - both)
        label = group.inner
        while True:  # the least reachable, a few rounds over a small table
            least = np.where(like, label[None, :], len(ids)).min(1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        group.inner = label
        return group

    def matrix(self) -> np.ndarray:
        """Tokens by members: whether the member has the token."""
        out = np.zeros((len(self.union), len(self.ids)), np.uint8)
        out[self.places, np.repeat(np.arange(len(self.ids)), self.sizes)] = 1
        return out

    def links(self, tokens: np.ndarray, held: list[np.ndarray], over: int = OVER, of: int = OF) -> list[int]:
        """Members similar to a query, one of each inner component. ``held`` keeps the matrix once the group is open."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if of * len(at) < over * max(len(tokens), int(self.sizes.min())):
            return []  # no member can reach the similarity
        if not held:
            held.append(self.matrix())
        both = held[0][at].sum(0, dtype=np.int64)
        found = np.flatnonzero(of * both >= over * (len(tokens) + self.sizes - both))
        return self.ids[found[np.unique(self.inner[found], return_index=True)[1]]].tolist()

    def pack(self) -> bytes:
        counts = np.array([len(self.ids), len(self.union)], np.int64)
        return b"".join(x.tobytes() for x in (counts, self.ids, self.sizes, self.inner.astype(np.int64), self.union, self.places))

    @classmethod
    def unpack(cls, data: bytes) -> Group:
        k, n = np.frombuffer(data, np.int64, 2).tolist()
        ids, sizes, inner = np.frombuffer(data, np.int64, 3 * k, 16).reshape(3, k)
        return cls(ids, sizes, inner, np.frombuffer(data, np.uint64, n, 16 + 24 * k), np.frombuffer(data, np.int32, -1, 16 + 24 * k + 8 * n))


_STORED = pa.schema([("g", pa.int64()), ("part", pa.int64()), ("stored", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def stored_groups(members: DataFrame) -> DataFrame:
    """(g, part, stored) of each group for each part of its queries, and rows (a, b) of links among its members."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("set_id").to_pylist()
        g, parts = rows.column("g")[0].as_py(), rows.column("parts")[0].as_py()
        group = Group.of(ids, shingle_sets(rows.column("text").to_pylist()))
        linked = [(i, k) for i, k in enumerate(group.inner.tolist()) if i != k]
        none = [None] * len(linked)
        columns = [[g] * parts + none, [*range(parts), *none], [group.pack()] * parts + none, [None] * parts + [ids[i] for i, _ in linked], [None] * parts + [ids[k] for _, k in linked]]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, _STORED, strict=True)], schema=_STORED)

    return members.groupBy("g").applyInArrow(run, "g long, part long, stored binary, a long, b long")


def opened_links(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """(a, b): queries and the members they are similar to, of the groups asked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(queries: pa.Table, groups: pa.Table) -> pa.Table:
        a, b = [], []
        if queries.num_rows and groups.num_rows:
            group, held = Group.unpack(groups.column("stored")[0].as_py()), []
            for q, x in zip(queries.column("set_id").to_pylist(), shingle_sets(queries.column("text").to_pylist()), strict=True):
                found = group.links(x, held)
                a += [q] * len(found)
                b += found
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return queries.groupBy("g", "part").cogroup(stored.groupBy("g", "part")).applyInArrow(run, "a long, b long")


def compared(docs: DataFrame, inside: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b): links within the groups ``inside`` (set_id, n, g: their members), and of queries (set_id, n, g) ``asked`` with these, written. A text moves once for its group, and once for each group it asks."""
    many = asked.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / GROUP_QUERIES), F.ceil(F.sum("n") / (4 * GROUP_TOKENS))).alias("parts"))
    several = inside.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    met = several.join(many, "g", "full").select("g", F.coalesce("parts", F.lit(0).cast("long")).alias("parts"))
    members = inside.join(met, "g").select("set_id", "g", F.lit(-1).cast("long").alias("part"), "parts")
    queries = asked.join(many, "g").select("set_id", "g", F.pmod(F.xxhash64("set_id"), "parts").alias("part"), "parts")
    dealt = materialize(members.unionByName(queries), "dealt")
    texts = materialize(with_texts(docs, dealt), "texts")
    discard(dealt)
    stored = materialize(stored_groups(texts.where("part < 0").select("set_id", "g", "parts", "text")), "stored")
    opened = opened_links(texts.where("part >= 0").select("g", "part", "set_id", "text"), stored.where("stored is not null").select("g", "part", "stored"))
    links = materialize(stored.where("a is not null").select("a", "b").unionByName(opened), "similar")
    discard(texts, stored)
    return links


def groups_left(asked: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """(set_id, n, g): of the cells ``asked`` (set_id, n, own, of), the groups that aren't the first, nor wholly in the query's component by ``known`` (set_id, comp).

    A cell is listed by the components that some of its groups lie in, not by
    its groups, so queries of the one component of a large cell meet one row.
    """
    comp = known.select(F.col("set_id").alias("id"), "comp")
    with_comp = lambda rows: rows.join(comp, F.col("set_id") == F.col("id"), "left").withColumn("comp", F.coalesce("comp", "set_id")).drop("id")
    groups = with_comp(members.where("parts > 1 and g <> first")).groupBy("cell", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    groups = groups.select(F.col("cell").alias("of"), "g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1).alias("all_of"))  # ROWs aren't negative
    ways = groups.select("of", "all_of").distinct()
    foreign = with_comp(asked.where("parts > 1")).join(ways, "of").where("all_of <> comp").select("set_id", "n", "own", "of", "all_of")
    return foreign.join(groups, ["of", "all_of"]).where("own is null or g < own").select("set_id", "n", "g")


def similar_sets(docs: DataFrame, kinds: DataFrame, marked: DataFrame) -> DataFrame:
    """(set_id, comp): the component of each set that is similar to another. marked: the open rows with their cells, written; they go as soon as they are used."""
    named = kinds.select("h", F.col("n_shingles").cast("int").alias("n"), "set_id")
    plain = members_of_cells(marked)
    first = plain.groupBy("cell").agg(F.min("g").alias("first"))
    members = materialize(plain.join(first, "cell").join(named, ["h", "n"]), "groups")
    cells = asked_cells(marked, members).join(members.select(F.col("cell").alias("of"), "first").distinct(), "of")
    asked = materialize(cells.join(named, ["h", "n"]).select("set_id", "n", "own", "of", "parts", "first"), "asked")
    discard(marked)
    begun = asked.where("own is null or own <> first").select("set_id", "n", F.col("first").alias("g"))
    links = compared(docs, members.select("set_id", "n", "g"), begun)
    known = components(links)
    if asked.where("parts > 1").isEmpty():
        discard(members, asked)
        return known
    left = materialize(groups_left(asked, members, known), "left")
    if not left.isEmpty():
        # a group of the second round was compared within itself in the first
        more = compared(docs, members.join(left.select("g").distinct(), "g", "left_semi").select("set_id", "n", "g"), left)
        known = components(known.select(F.col("set_id").alias("a"), F.col("comp").alias("b")).unionByName(more))
    discard(members, asked, left)
    return known


# -- components ---------------------------------------------------------------------


def _least(edges: DataFrame) -> DataFrame:
    """u, v, and m: the least of u's neighbours and u. A center's neighbours are dealt out by a salt."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    return edges.withColumn("salt", salt).join(least, ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(set_id, comp): the least id reachable by ``links`` (a, b), of each id in them. Alternates large and small stars until nothing changes."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        # large star: each larger neighbour goes to the least of all
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each smaller neighbour, and the node, goes to the least of them
        small = _least(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        discard(last)
        digest = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if digest == seen:
            break
        seen = digest
    return now.select(F.col("u").alias("set_id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("set_id"), F.col("v").alias("comp")).distinct())


def components_of_rows(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, n_shingles, md5 (of the text), component_id (the smallest doc_id reachable by links), first (the least ROW reachable; null for the empty set), of ``docs`` with ROW."""
    docs = docs.select("doc_id", "text", ROW)
    read = materialize(sets_of_documents(docs), "sets")
    sets = read.where(f"{ROW} is not null").select(ROW, "doc_id", "n_shingles", "digest", "h", "md5")
    levels = token_levels(read.where("counts is not null").select("slice", "counts"))
    kinds = sets.where("digest is not null").groupBy("digest").agg(F.min(ROW).alias("set_id"), F.min("doc_id").alias("least"), F.first("h").alias("h"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    kinds = materialize(kinds, "kinds")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # what a task knows of itself, and what it sends, are made one after the other: tokens in a file besides would be the most that is on disk
    known = prefix_tokens(docs, levels, buckets, True).select("token", "h", "n", "level", "index")
    marked = materialize(with_cells(known.unionByName(met_in_buckets(prefix_tokens(docs, levels, buckets, False)))), "marked")
    label = similar_sets(docs, kinds, marked)
    least = kinds.join(label, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    final = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id"), F.min("set_id").alias("first")), "comp").select("digest", "copies", "component_id", "first")
    final = materialize(final, "components")
    # copies of one text may be a third of all rows: the few sets of so many rows meet theirs without a shuffle
    many = final.where(F.col("copies") > sets.count() // HOT).select("digest", F.struct("component_id", "first").alias("hot"))
    found = sets.where("digest is not null").join(F.broadcast(many), "digest", "left")
    rest = found.where("hot is null").drop("hot").join(final.select("digest", F.struct("component_id", "first").alias("hot")), "digest")
    named = found.where("hot is not null").unionByName(rest)
    empty = sets.where("digest is null").select(ROW, "doc_id", "n_shingles", "md5", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("first"))
    return named.select(ROW, "doc_id", "n_shingles", "md5", F.coalesce("hot.component_id", "doc_id").alias("component_id"), F.col("hot.first").alias("first")).unionByName(empty)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows = with_rows(docs.select("doc_id", "text"))
    out = components_of_rows(rows).select("doc_id", "n_shingles", "component_id")
    discard(rows)  # texts are read no more
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without those that a document of a smaller id is linked with, directly or through others. A null doc_id is the largest; of a group of such rows alone one stays."""
    rows = with_rows(docs.select("doc_id", "text"))
    found = components_of_rows(rows).where(f"component_id = doc_id or (component_id is null and coalesce(first = {ROW}, true))")
    # which rows stay follows from doc_id and text, but for rows of null ids; with this written, the copy of the texts goes
    doc, key, own, one_, row = free_names(docs, "__doc", "__kept", "__md5", "__one", "__row")
    kept = materialize(found.select(F.col("doc_id").alias(doc), F.col("md5").alias(key), (F.col("doc_id").isNull() & F.col("first").isNotNull()).alias(one_)).distinct(), "kept")
    discard(rows)
    keyed = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key))
    out = keyed.join(kept.where(~F.col(one_)), same, "left_semi").select(*docs.columns)
    one = keyed.where("doc_id is null").join(kept.where(F.col(one_)), F.col(own) == F.col(key), "left_semi")
    one = one.groupBy(own).agg(F.first(F.struct(*docs.columns)).alias(row)).select(*(F.col(row)[c].alias(c) for c in docs.columns))
    return out.unionByName(one)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') for i in range(1, len(ws) - 3)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.m FROM r JOIN u ON r.doc_id = u.a WHERE r.m < u.b),
k AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM k LEFT JOIN n ON k.doc_id = n.doc_id
"""
