"""Conversation structure repair: the cheapest edits that make role initials ``(s?(ua)+)?``.

The method is weighted CYK interval parsing. The repair grammar is in Chomsky
normal form: a nonterminal N[p,q] derives the edited rows of a span that lead
the pattern from state p to state q, with N[p,q] -> N[p,r] N[r,q] and, for one
row, keep, rerole or delete after inserted rows (the insertion closure). A
span's cell for N[p,q] is its minimum (cost, audit). As each nonterminal names
the states at both ends of its span, each split of a span gives the same
minimum; so the cells are combined bottom-up by span length over spans of 1, 2,
4, ... rows, which is one split of each span and makes the work linear.

1. Equal rows of a turn become one with a count, then learn whether an earlier
   turn has their role and text.
2. Rows are dealt out by ranges of (conv_id, turn, role, text), so that a
   conversation of any length is in as many tasks as it needs. A task combines
   its rows to blocks of spans; then the blocks of a conversation are combined
   in pairs, round by round.
3. The audit of the root meets the conversation's rows, sorted, in one stream
   per task, which yields the repaired rows in order. (A digest of a whole
   conversation has to see it in order, in one task; its rows are streamed.)

Minima may be taken cell by cell: of two audits for a span neither is the start
of another of the same cost, as each has one letter for each row besides its
inserts, each of which costs; so the lesser stays less with whatever follows.

Defined results: null conv_id is a conversation of its own, null turns come
first, a null role or text is one space. Rows of one turn are ordered by role
and text. A role without a first letter of s, u, a (also an empty one) can't be
kept. Empty and very long texts are texts as others. A conversation without
rows is empty: all zeros. An empty table gives an empty one. Columns besides
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_TABLE, crc32_sql, discard, materialize, table

RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a. The first and the last are ends.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
#: Rows whose cells a task combines to one block.
SPAN = 512
SALTS = 16
ROLES = {USER: "user", ASSISTANT: "assistant"}

Cell = tuple[int, str]
Chart = dict[tuple[int, int], Cell]


# -- the grammar -----------------------------------------------------------------


def combine(left: Chart, right: Chart) -> Chart:
    """N[p,q] -> N[p,r] N[r,q]: the cells of two spans in a row."""
    out: Chart = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            if (more := right.get((r, q))) and ((p, q) not in out or (cost + more[0], audit + more[1]) < out[p, q]):
                out[p, q] = (cost + more[0], audit + more[1])
    return out


def _closure() -> Chart:
    out: Chart = {(p, p): (0, "") for p in range(4)}
    step: Chart = {(p, q): (INSERT, "I") for x in "ua" for p, q in STEPS[x].items()}
    for _ in range(3):
        for key, cell in combine(out, step).items():
            out[key] = min(out.get(key, cell), cell)
    return out


#: What inserts alone lead from and to: the empty span.
INSERTS = _closure()


@lru_cache
def row_cells(initial: str, must_go: bool, truncated: bool) -> Chart:
    """The cells of one row, after inserts."""
    out: Chart = {(p, p): (DELETE, "D") for p in range(4)}
    if not must_go:
        for x in "sua":
            for p, q in STEPS[x].items():
                if x == initial:
                    out[p, q] = (TRUNCATED * truncated, "K")
                elif x != "s":
                    out[p, q] = (RELABEL + TRUNCATED * truncated, "R")
    return combine(INSERTS, out)


def copies(n: int) -> Chart:
    """The cells of n rows that must go."""
    return combine(INSERTS, {(p, p): (DELETE * n, "D" * n) for p in range(4)})


def bottom_up(spans: list[Chart]) -> Chart:
    """Spans of twice the length from those of each length, to the whole."""
    while len(spans) > 1:
        spans = [combine(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def root(cells: Chart) -> Cell:
    """Cost and audit of the whole conversation."""
    whole = combine(cells, INSERTS)
    return min(whole[START, q] for q in (START, ASSISTANT) if (START, q) in whole)


# -- rows and their faults ---------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows dropped, emptied, cut, repeated or made the user's, as a checksum of each row's conv_id and turn tells."""
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = plain(turns).withColumn("kind", F.crc32(said) % 20).where("kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def plain(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows of the turn), blank, seen (in an earlier turn), cut (truncated)."""
    rows = plain(turns).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("same", F.md5("text")).withColumn("order", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = rows.groupBy("conv_id", "role", "same").agg(F.min("order").alias("first"), F.count("*").alias("turns")).where("turns > 1")
    # a text may be in a third of all turns: its row of `first` is copied to many tasks
    first = first.select(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("same").alias("what"), "first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("part"))
    met = rows.withColumn("salt", _salt()).join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("same") == F.col("what")) & (F.col("salt") == F.col("part")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return met.select("conv_id", "turn", "role", "text", "n", blank.alias("blank"), F.coalesce(F.col("order") > F.col("first"), F.lit(False)).alias("seen"), (~blank & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))


# -- blocks of spans --------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BLOCK = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("first", pa.string()), ("last", pa.string()), ("min_turn", pa.int64()), ("max_turn", pa.int64()), ("turns", pa.int64()), ("states", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
BLOCK_DDL = "conv_id long, place long, blank long, duplicate long, truncated long, illegal long, first string, last string, min_turn long, max_turn long, turns long, states array<int>, costs array<long>, audits array<string>"


def joined(left: dict, right: dict) -> dict:
    """Two neighbouring blocks of one conversation as one."""
    out = {c: left[c] + right[c] for c in (*COUNTS, "turns")}
    out["illegal"] += left["last"] + right["first"] not in LEGAL
    out["turns"] -= left["max_turn"] is not None and left["max_turn"] == right["min_turn"]
    known = [x for x in (left["min_turn"], left["max_turn"], right["min_turn"], right["max_turn"]) if x is not None]
    return out | {"conv_id": left["conv_id"], "place": left["place"] // 2, "first": left["first"], "last": right["last"], "min_turn": known[0] if known else None, "max_turn": known[-1] if known else None, "cells": combine(left["cells"], right["cells"])}


def stored(blocks: list[dict]) -> pa.Table:
    rows = [b | {"states": [4 * p + q for p, q in b["cells"]], "costs": [c for c, _ in b["cells"].values()], "audits": [a for _, a in b["cells"].values()]} for b in blocks]
    return pa.table([pa.array([r[f.name] for r in rows], f.type) for f in _BLOCK], schema=_BLOCK)


def read_back(blocks: pa.Table | pa.RecordBatch) -> list[dict]:
    return [r | {"cells": {divmod(s, 4): (c, a) for s, c, a in zip(r["states"], r["costs"], r["audits"], strict=True)}} for r in blocks.to_pylist()]


class Spans:
    """The rows of a block, one after another."""

    def __init__(self, conv: int | None, place: int):
        self.out = {"conv_id": conv, "place": place, "first": None, "last": None, "min_turn": None, "max_turn": None, "turns": 0} | dict.fromkeys(COUNTS, 0)
        self.charts: list[Chart] = []

    def add(self, turn: int | None, role: str, n: int, blank: bool, seen: bool, cut: bool) -> None:
        out, initial = self.out, role[:1]
        if out["first"] is None:
            out["first"] = initial
        else:
            out["illegal"] += out["last"] + initial not in LEGAL
        out["last"] = initial
        out["illegal"] += n - 1  # a role after itself
        out["blank"] += n * blank
        out["duplicate"] += 0 if blank else n if seen else n - 1
        out["truncated"] += cut and not seen
        if turn is not None:
            out["turns"] += turn != out["max_turn"]
            out["min_turn"], out["max_turn"] = turn if out["min_turn"] is None else out["min_turn"], turn
        if blank or seen:
            self.charts.append(copies(n))
        else:
            self.charts.append(row_cells(initial if initial in STEPS else "", False, cut))
            if n > 1:
                self.charts.append(copies(n - 1))

    def block(self) -> dict:
        return self.out | {"cells": bottom_up(self.charts)}


def blocks_of(rows: DataFrame, span: int) -> DataFrame:
    """The blocks of each conversation, numbered from 0 in ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        open_: Spans | None = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and (row[0] != open_.out["conv_id"] or len(open_.charts) >= span):
                    done.append(open_.block())
                    open_, place = None, place + 1
                open_ = open_ or Spans(row[0], place)
                open_.add(*row[1:])
            if done:
                yield from stored(done).to_batches()
        if open_:
            yield from stored([open_.block()]).to_batches()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "n", "blank", "seen", "cut").mapInArrow(run, BLOCK_DDL)


def parsed(rows: DataFrame, span: int) -> DataFrame:
    """One block for each conversation of ``rows``: those of more are combined in pairs, round by round."""
    blocks = materialize(blocks_of(rows, span), "blocks")
    count = blocks.groupBy("conv_id").agg(F.count("*").alias("many"))
    long_ = count.where("many > 1").select(F.col("conv_id").alias("of"), "many")
    rounds = (long_.agg(F.max("many")).first()[0] or 1) - 1
    if not rounds:
        return blocks
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    # places in a row: a conversation's blocks are one in `span` of its rows
    number = blocks.select("conv_id", "place").join(long_, same).select("conv_id", "place", (F.row_number().over(_by_place()) - 1).cast("long").alias("number"))
    number = number.select(F.col("conv_id").alias("of"), F.col("place").alias("was"), "number")
    several = materialize(blocks.join(number, same & (F.col("place") == F.col("was"))).withColumn("place", F.col("number")).select(*blocks.columns), "round")
    single = blocks.join(long_, same, "left_anti")

    def pair(found: pa.Table) -> pa.Table:
        two = sorted(read_back(found), key=lambda b: b["place"])
        return stored([joined(*two) if len(two) > 1 else two[0] | {"place": two[0]["place"] // 2}])

    while rounds:
        after = materialize(several.withColumn("half", F.expr("place div 2")).groupBy("conv_id", "half").applyInArrow(lambda t: pair(t.drop_columns(["half"])), BLOCK_DDL), "round")
        discard(several)
        several, rounds = after, rounds // 2
    return single.unionByName(several)


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("place")


# -- repair ------------------------------------------------------------------------


def audits(blocks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [root(b["cells"]) for b in read_back(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", *COUNTS, "min_turn", "max_turn", "turns")), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["conv_id", *COUNTS, "min_turn", "max_turn", "turns", "cost", "audit"])

    done = blocks.mapInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, min_turn long, max_turn long, turns long, cost long, audit string")
    return done.select("conv_id", F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), *COUNTS, "cost", "audit")


def apply_audit(audit: Iterator[str], state: int, role: str, text: str, n: int) -> Iterator[tuple[int, str, str]]:
    """(state after, role, text) of what n equal rows and the inserts before them become."""
    for _ in range(n):
        for edit in audit:
            if edit == "K":
                state = STEPS[role[:1]][state]
                yield state, role, text
            elif edit != "D":
                state = ASSISTANT if state == USER else USER
                yield state, ROLES[state], text if edit == "R" else ""
            if edit != "I":
                break


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, pos, role, text of the repaired conversations; a task has whole conversations, in order."""
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "text")]
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, state, pos = None, None, START, 0
        for batch in batches:
            out: list[tuple] = []
            for own, kind, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    out += _trailing(conv, edits, state, pos)
                    conv, edits, state, pos = own, iter(text), START, 0
                for state, by, what in apply_audit(edits, state, role, text, n):
                    out.append((conv, pos, by, what))
                    pos += 1
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in _trailing(conv, edits, state, pos)], schema=schema)

    return stream.select("conv_id", "kind", "role", "text", "n").mapInArrow(run, "conv_id long, pos long, role string, text string")


def _trailing(conv: int | None, edits: Iterator[str] | None, state: int, pos: int) -> list[tuple]:
    """The inserts after the last row."""
    return [] if edits is None else [(conv, pos + k, role, text) for k, (_, role, text) in enumerate(apply_audit(edits, state, "", "", 1))]


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of rows as ``repaired`` returns them, in one stream per task."""
    import hashlib

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for own, pos, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pos == 0:
                    done += [(conv, digest.hexdigest())] if digest else []
                    conv, digest = own, hashlib.sha256()
                digest.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], schema=schema)
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], schema=schema)

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(a row of counts, cost and audit for each conversation; the repaired rows), of rows conv_id, turn, role, text."""
    rows = materialize(with_faults(turns), "turns")
    found = materialize(audits(parsed(rows, span)), "audits")
    return found, repaired(rows, found)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found, rows = repair(damaged(turns))
    hashed = digests(rows).select(F.col("conv_id").alias("of"), "repaired_sha256")
    found = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("conv_id", "of")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# -- the same in SQL: states of the pattern carried from row to row ---------------


def _least(*found: str) -> str:
    return f"list_sort([{', '.join(found)}])[1]"


def _then(state: str, cost: str, letter: str, text: str = "''", when: str = "true") -> str:
    return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {text}}} ELSE {_NONE} END"


_NONE = "{'c': 1000000000, 'a': '', 't': ''}"
_LINE = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}


def _inserted(s: list[str]) -> list[str]:
    u, a = _LINE["user"], _LINE["assistant"]
    one = [_then(s[p], "2", "I", u) for p in (START, SYSTEM, ASSISTANT)]
    two = [_then(s[p], "4", "II", f"{u} || {a}") for p in (START, SYSTEM)]
    return [s[0], s[1], _least(s[2], *one), _least(s[3], _then(s[2], "2", "I", a), *two)]


def _edited(s: list[str]) -> list[str]:
    gone = [_then(x, "3", "D") for x in s]
    keep = lambda p, x: _then(s[p], "cut", "K", "chr(10) || role || ':' || text", f"NOT must AND left(role, 1) = '{x}'")
    turn = lambda p, x: _then(s[p], "2 + cut", "R", f"{_LINE[x]} || text", "NOT must")
    to_user = [f(p, x) for p in (START, SYSTEM, ASSISTANT) for f, x in ((keep, "u"), (turn, "user"))]
    return [gone[0], _least(gone[1], keep(START, "s")), _least(gone[2], *to_user), _least(gone[3], keep(USER, "a"), turn(USER, "assistant"))]


_PARTS = ["s0", "s1", "s2", "s3"]
SQL = rf"""
WITH RECURSIVE t AS ({CRC32_TABLE}),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM h WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
      NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended FROM o),
r AS (SELECT *, CASE WHEN blank OR again THEN 0 WHEN unended THEN 1 ELSE 0 END AS cut, blank OR again AS must,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
      count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated,
      count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM r GROUP BY conv_id),
st AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}} AS s1,
       {{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}} AS s2, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}} AS s3 FROM n
      UNION ALL SELECT conv_id, i, {", ".join(f"{e} AS {p}" for e, p in zip(_edited(["i0", "i1", "i2", "i3"]), _PARTS, strict=True))} FROM
      (SELECT st.conv_id, r.i, r.role, r.text, r.cut, r.must, {", ".join(f"{e} AS i{k}" for k, e in enumerate(_inserted(_PARTS)))}
       FROM st JOIN r ON st.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = st.i + 1)),
e AS (SELECT n.*, {_least("s0", _inserted(_PARTS)[3])} AS best FROM st JOIN n ON st.conv_id IS NOT DISTINCT FROM n.conv_id AND st.i = n.size)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
