import hashlib
import itertools
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gleiswerk.llm.conversations import COUNTS, bottom_up, combine, damaged, digests, op11_conversation_repair, repair, root, row_cells

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def faults(rows):
    rows = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, out = set(), []
    for _, _, role, text in rows:
        said = SPACE.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return rows, out


def brute(rows):
    """Every way to edit, inserts up to two in a gap."""
    rows, found = faults(rows)
    best = None
    for edits in itertools.product(*(["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in found)):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, roles, lines = 0, "", "", []
            for k in range(len(rows) + 1):
                for x in gaps[k]:
                    cost, audit, roles = cost + 2, audit + "I", roles + x
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if k < len(rows):
                    e, (_, _, role, text) = edits[k], rows[k]
                    audit += e[0]
                    cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (found[k] == "truncated" and e != "D")
                    if e != "D":
                        role = role if e == "K" else {"u": "user", "a": "assistant"}[e[1]]
                        roles += role[:1] or "?"
                        lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(x) for x in COUNTS[:3]), illegal, *best)


def result(turns, span):
    found, rows = repair(turns, span)
    hashed = {r.conv_id: r.repaired_sha256 for r in digests(rows).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashed.get(r.conv_id, hashlib.sha256().hexdigest())) for r in found.collect()}


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        *counts, text = brute([r for r in rows if r[0] == conv])
        out[conv] = (*counts, hashlib.sha256(text.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."),
    (2, 0, "user", "Hello"), (2, 0, "user", "Hello"), (2, 3, "user", "Hello"),
    (3, 5, "assistant", " \t\n"), (3, 6, "tool", "x!"), (3, 6, "", "y."),
    (4, 0, "system", "Only that."),
    (None, None, None, None), (None, 1, "assistant", "Yes. "), (None, None, "user", "Is it?"),
    (5, 9, "assistant", "B."), (5, 7, "user", "x" * 50000), (5, None, "system", "A.\n\n"),
]


def test_repair_equals_every_way_to_edit(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    want = expected(ROWS)
    assert result(turns, 512) == want
    assert result(turns, 1) == want == result(turns.selectExpr("*", "'x' AS n", "1 AS same", "2 AS blank", "3 AS first", "4 AS place", "5 AS __row"), 2)
    assert want[2][5:7] == (9, "DDD") and want[1][6] == "KKK" and want[4][5:7] == (3, "D")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([None, 0, 1, 2, 4]), st.sampled_from(["system", "user", "assistant", "u", "x", None]), st.sampled_from(["A.", "B", "", None, "C! "])), max_size=10), st.integers(1, 3))
def test_any_rows(spark, rows, span):
    seen: dict = {}
    rows = [r for r in rows if seen.setdefault(r[0], []).append(r) or len(seen[r[0]]) <= 3]
    assert result(spark.createDataFrame(rows, SCHEMA), span) == expected(rows)


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Turn {t}. Of {c}! Yes?") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    got = damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_damage(rows), key=str)


def test_every_split_of_a_span_gives_the_same_cells():
    rows = [row_cells(x, go, cut) for x, go, cut in (("u", False, True), ("s", False, False), ("", False, False), ("a", True, False), ("u", False, False), ("a", False, True), ("a", False, False))]
    chart = {(i, i + 1): c for i, c in enumerate(rows)}
    for n in range(2, len(rows) + 1):
        for i in range(len(rows) - n + 1):
            found = [combine(chart[i, k], chart[k, i + n]) for k in range(i + 1, i + n)]
            assert all(f == found[0] for f in found)
            chart[i, i + n] = found[0]
    assert chart[0, len(rows)] == bottom_up(rows) and root(bottom_up(rows))[0] > 0


def test_long_conversation_in_many_blocks(spark):
    """A conversation of thousands of rows, in blocks of 16, against the pattern's states carried from row to row."""
    rows = [(1, t, ("user", "assistant", "user", "tool")[t * 7 % 11 % 4], f"{t}{'.' if t % 3 else ''}") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    from functools import reduce

    from gleiswerk.llm.conversations import STEPS

    cells = reduce(combine, [row_cells(r[2][:1] if r[2][:1] in STEPS else "", False, not r[3].endswith(".")) for r in rows[:3000]])
    got = result(spark.createDataFrame(rows, SCHEMA), 16)
    assert got[1][5:7] == root(cells) and got[2][5:7] == (2, "KI")


def test_query(spark):
    got = op11_conversation_repair(spark, "/root/testdata/sf0.001")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    empty = spark.createDataFrame([], SCHEMA)
    assert result(damaged(empty), 4) == {}
