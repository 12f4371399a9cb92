import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from gleiswerk.llm.substring_dedup import cut_substrings, doubling, op13_substring_dedup
from pyspark.sql import functions as F


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    seen = Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p + k for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def result(docs, **options):
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return sorted(tuple(r) for r in cut_substrings(docs, **options).select("n_words", length, "kept").collect())


def test_levels_at_most_double():
    assert doubling(35) == [9, 18, 35] and doubling(70) == [9, 18, 35, 70] and doubling(3) == [3]
    for n in range(1, 300):
        levels = doubling(n)
        assert levels[-1] == n and all(a < b <= 2 * a for a, b in zip(levels, levels[1:]))


def test_odd_rows(odd, none, clash):
    want = sorted(brute([r.text for r in odd.collect()], 35))
    assert result(odd) == want == result(clash)
    assert result(none) == [] and cut_substrings(none).columns == ["doc_id", "n_words", "spans", "kept"]
    assert sorted(r.doc_id for r in cut_substrings(odd).collect()) == [1, 2, 3, 4, 5, 5, 6, 7]


def test_given_documents_in_small_blocks(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows], 35))}
    got = cut_substrings(documents, block_bytes=5000).collect()
    assert {r.doc_id: (r.n_words, sum(s.length for s in r.spans), r.kept) for r in got} == want
    assert sum(x[1] for x in want.values()) > 0
    assert op13_substring_dedup(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_nothing_survives(spark):
    docs = spark.createDataFrame([(k, " ".join(f"{k}w{i}" for i in range(80))) for k in range(9)], "doc_id long, text string")
    assert result(docs) == sorted(brute([r.text for r in docs.collect()], 35))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab \n", max_size=120), max_size=6), st.sampled_from([1, 2, 5, 17, 20]))
def test_any_texts(spark, texts, window):
    docs = spark.createDataFrame([(i // 2, x) for i, x in enumerate(texts)], "doc_id long, text string")
    assert result(docs, window=window, shortest=2, block_bytes=60) == sorted(brute(texts, window))
