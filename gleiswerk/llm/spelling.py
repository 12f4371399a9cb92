"""Spelling variant grouping: each word's near words, its more frequent form, and the root of its forms.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. The method is reduced-alphabet generation: letters are hashed to a
few symbols, so that the full one-edit neighbourhood of a reduced word is small
whatever the alphabet. Near words are near, or equal, when reduced; so joining
the neighbourhoods with the reduced vocabulary finds every pair, and each pair
is then verified on the original strings.

1. Words are counted within the scan, task by task, and added up by word.
2. Each word has a key: a hash of its length and reduced letters. A bitmap of
   keys (4 MB, whatever the vocabulary) leaves out neighbours that no word can
   be; the rest are joined by key and verified.
3. A word's form is the near word of the largest count, if that is at least ten
   times its own. Counts grow tenfold along a chain of forms, so a chain has at
   most 18 links, and five rounds of pointer doubling reach its end.

Damage: ``damaged`` deletes one code point of every 31st run of letters, as
told by a checksum of doc_id and run, so that texts hold variants to find.

Defined results: a null or empty text has no words; a null doc_id is written as
``null`` in the checksum. Rows of one doc_id, or equal rows, count each. Only
A-Z are lower-cased. Ties of the largest count go to the smallest word in order
of code points. Words may be of any length. Without words of enough letters and
occurrences, or documents, the result is empty. Columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_TABLE, crc32_sql, discard, materialize, mix, powers, record_batch, table, text_rows

MIN_CHARS, MIN_COUNT = 7, 2
#: A form is so many times as frequent as the word.
TIMES = 10
#: Every so many runs of letters lose a code point.
DAMAGED = 31
#: Symbols that letters are hashed to.
SYMBOLS = 8
BITS = 25
#: Links of the longest chain of forms: counts are longs and grow TIMES-fold.
LINKS = 18
RUN = re.compile("[a-zÀ-ÿ]+")
#: Words that a task counts before it hands them on, and neighbours made at once.
_HELD, _AT_ONCE = 200_000, 2_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYED = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


def damaged(doc: int | None, run: str) -> str:
    """The run, or every DAMAGED-th time the run without one code point."""
    h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
    if h % DAMAGED:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the damaged words of at least ``min_chars`` code points and ``min_count`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(x for x in RUN.findall((text or b"").lower().decode()) if len(x) >= min_chars)
                for word, n in found.items():
                    if len(word := damaged(doc, word)) >= min_chars:
                        held[word] += n
                if len(held) >= _HELD:
                    yield record_batch(_COUNTS, [list(held), list(held.values())])
                    held.clear()
        yield record_batch(_COUNTS, [list(held), list(held.values())])

    return text_rows(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- reduced words -----------------------------------------------------------------


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """A row of symbols for each of ``words``, which are of one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(words), -1)
    return mix(points * _MUL) % np.uint64(symbols) + np.uint64(1)


def sealed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * int(_MUL) % (1 << 64)))


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Sums of symbols times powers, before each position and over all."""
    up = powers(rows.shape[1] + 1)[0]
    return np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(rows * up[: rows.shape[1]], axis=1)], axis=1)


def own_keys(rows: np.ndarray) -> np.ndarray:
    return sealed(prefixes(rows)[:, -1], rows.shape[1])


def neighbour_keys(rows: np.ndarray, symbols: int, shortest: int = 1) -> np.ndarray:
    """A row of keys for each reduced word: of itself and of its full one-edit neighbourhood (with repetitions)."""
    n, length = rows.shape
    up, down = powers(length + 2)
    before = prefixes(rows)
    whole = before[:, -1:]
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    out = [sealed(whole, length)]
    replaced = whole[:, :, None] + (every[None, None, :] - rows[:, :, None]) * up[:length][None, :, None]
    out.append(sealed(replaced.reshape(n, -1), length))
    inserted = (before + (whole - before) * up[1])[:, :, None] + every[None, None, :] * up[: length + 1][None, :, None]
    out.append(sealed(inserted.reshape(n, -1), length + 1))
    if length > shortest:
        out.append(sealed(before[:, :-1] + (whole - before[:, 1:]) * down[1], length - 1))
    return np.concatenate(out, axis=1)


def by_length(words: list[str], at_once: int) -> Iterator[np.ndarray]:
    """Indices of words of one length, so many that ``at_once`` neighbours are made of them (one at least)."""
    sizes = np.array([len(x) for x in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(part):
            step = max(1, at_once // (2 * SYMBOLS * (int(sizes[part[0]]) + 1)))
            for i in range(0, len(part), step):
                yield part[i : i + step]


def keyed(words: DataFrame, symbols: int) -> DataFrame:
    """key, word, n: each word with the key of its reduced form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            keys = np.zeros(len(own), np.uint64)
            for part in by_length(own, _AT_ONCE):
                keys[part] = own_keys(reduced([own[i] for i in part], symbols))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).cast(pa.string()), batch.column(1)], schema=_KEYED)

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits, those set that begin some key: 4 MB at 25, however many keys there are."""
    spot = F.shiftrightunsigned("key", 64 - bits)
    found = keys.select(F.shiftrightunsigned(spot, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    set_ = found.groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[set_["at"].to_numpy(np.int64)] = set_["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def neighbours(words: DataFrame, symbols: int, shortest: int, bits: int, held: np.ndarray) -> DataFrame:
    """key, word, n for each key of a word's neighbourhood that the bitmap ``held`` has."""
    sent = words.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            own = batch.column(0).to_pylist()
            for part in by_length(own, _AT_ONCE):
                keys = np.sort(neighbour_keys(reduced([own[i] for i in part], symbols), symbols, shortest), axis=1)
                stay = np.ones(keys.shape, bool)
                stay[:, 1:] = keys[:, 1:] != keys[:, :-1]
                spot = keys >> np.uint64(64 - bits)
                stay &= (held[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
                row, col = np.nonzero(stay)
                at = pa.array(part[row])
                for i in range(0, len(row), 1 << 17):
                    own_rows = at.slice(i, 1 << 17)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row[i : i + (1 << 17)], col[i : i + (1 << 17)]].view(np.int64)), batch.column(0).take(own_rows).cast(pa.string()), batch.column(1).take(own_rows)], schema=_KEYED)

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


# -- forms and roots -----------------------------------------------------------------


#: Joins of words go by sorted shuffles: the compressed files that Spark sizes a table by, and what is made of
#: them in Python, hold many times the rows that their bytes say, so a small enough file would be broadcast.
_BY_SHUFFLE = "merge"


def near_words(words: DataFrame, symbols: int = SYMBOLS, min_chars: int = MIN_CHARS, bits: int = BITS) -> DataFrame:
    """word, n, near, near_n: every ordered pair of near words of ``words`` (word, n)."""
    reduced_words = keyed(words, symbols)
    asked = neighbours(words, symbols, min_chars, bits, bitmap(reduced_words, bits))
    found = asked.join(reduced_words.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")).hint(_BY_SHUFFLE), "key")
    return found.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, links: int = LINKS) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by pointer doubling."""
    now, reach = materialize(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while reach < links:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(step.hint(_BY_SHUFFLE), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        moved = not after.where("moved").isEmpty()
        now, reach = after, 2 * reach
        if not moved:
            break
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, symbols: int = SYMBOLS, bits: int = BITS) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row for each word of the vocabulary."""
    words = materialize(vocabulary(docs, min_chars, min_count), "words")
    best = near_words(words, symbols, min_chars, bits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    near = materialize(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "near")
    known = words.join(near.hint(_BY_SHUFFLE), "word", "left")
    frequent = F.col("near_n") >= times * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n"))
    known = materialize(known, "forms")
    discard(words, near)
    return known.join(roots(known.where("form IS NOT NULL")).hint(_BY_SHUFFLE), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE t AS ({CRC32_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY doc_id, w),
h AS (SELECT w, n, {crc32_sql("concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', w)")} AS h FROM c, t),
x AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, CAST(h % length(w) AS BIGINT)), substr(w, CAST(h % length(w) + 2 AS BIGINT))) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.s = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.s = v.word),
b AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * v.n THEN best.near END AS form,
      CASE WHEN -best.less >= 10 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
g AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT g.word, f.form, k + 1 FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, m.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM g GROUP BY word) m ON f.word = m.word
"""
