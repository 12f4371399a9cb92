import hashlib
from collections import defaultdict

import pytest

from gleiswerk.llm import line_dedup
from gleiswerk.llm.registry import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40 and doc is not None:
                docs[key(x)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(docs.get(key(x), ())) < 5 or max(docs[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(df).select("doc_id", "__n_lines", "__n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sorted(map(tuple, out.collect()), key=str)


def test_planted(spark):
    shared, accents = "A line that many Documents hold, word for word.", "é" * 39 + "X"
    rows = [(i, f"own {i}\n {shared.upper() if i % 2 else shared}\t\n{accents}\nshort") for i in range(7)]
    rows += [(7, f"{shared}\n{shared}"), (8, "é" * 39), (9, None), (None, shared), (3, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert {r[0]: r[2] for r in got(df)}[7] == 0


@pytest.mark.parametrize("which", ["odd", "none", "documents", "clash"])
def test_brute(request, which):
    df = request.getfixturevalue(which)
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_keeps_columns_and_null(clash):
    out = line_dedup.dedup_lines(clash)
    assert out.columns[:-2] == clash.columns
    assert out.where("doc_id = 1 and text is null").count() == 1


def test_counts_are_the_last_columns(clash):
    """Where the input has columns of their names, which stay as they are."""
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(clash)
    n_lines, n_dropped = out.columns[-2:]
    assert not {n_lines, n_dropped} & set(clash.columns)
    rows = out.select("doc_id", n_lines, n_dropped, F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert sorted(map(tuple, rows), key=str) == brute([(r.doc_id, r.text) for r in clash.collect()])
    assert {r["__n_lines"] for r in out.collect()} == {"x"}


def test_query(spark):
    assert QUERIES["op1_line_dedup"](spark, "/root/testdata/sf0.001").count() == 200
