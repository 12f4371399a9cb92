import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleiswerk.llm.spelling import DAMAGED, near_words, neighbour_keys, op12_spelling, own_keys, reduced, roots, spelling_groups


def brute_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        found = [(-m, v) for v, m in words.items() if near(w, v)]
        form = min(found)[1] if found and -min(found)[0] >= 10 * n else None
        out[w] = (n, len(found), form, words[form] if form else None)
    rows = set()
    for w, (n, k, form, m) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, n, k, form, m, root))
    return rows


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_odd_rows(spark, odd, none, clash):
    want = brute(brute_words([(r.doc_id, r.text) for r in odd.collect()]))
    assert result(spelling_groups(odd)) == want == result(spelling_groups(clash))
    assert result(spelling_groups(none)) == set()


def test_variants_chain_to_one_root(spark):
    texts = [(None, "Stationen ÉTÉÉTÉÉ étéétéé"), (1, None), (2, "")]
    texts += [(10 + k, w) for w, n in (("bahnhof", 900), ("bahnhofe", 60), ("bahnhofes", 5), ("bahnhoffes", 2), ("Bahnhöf", 3), ("bahnhüf", 3), ("gleiseé", 2), ("gleiseè", 2), ("x" * 3000, 2), ("x" * 2999 + "y", 2)) for k in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = brute_words(texts)
    got = result(spelling_groups(docs))
    assert got == brute(words)
    root = {r[0]: r[5] for r in got}
    assert root["bahnhofes"] == root["bahnhofe"] == root["bahnhof"] == "bahnhof" and len({r[0]: r for r in got}["bahnhöf"]) == 6


def test_given_documents(spark, documents):
    words = brute_words([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    docs = op12_spelling(spark, "/root/testdata/sf0.001")
    assert docs.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert result(docs.select("word", "n", "n_near", "form", "form_n", "root")) == brute(words)
    assert any(r.form for r in docs.collect())


def test_chain_of_every_length(spark):
    for n in (1, 2, 3, 17, 18):
        forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(n)], "word string, form string")
        assert {tuple(r) for r in roots(forms).collect()} == {(f"w{i}", f"w{n}") for i in range(n)}


def test_reduced_neighbourhood_holds_every_near_word():
    letters = "abcdeé"
    for symbols in (1, 2, 8):
        for word in ("abcabca", "éééééé", "a"):
            keys = set(neighbour_keys(reduced([word], symbols), symbols)[0].tolist())
            edits = [word[:i] + x + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) for x in (*letters, "") if j <= len(word)]
            assert all(own_keys(reduced([x], symbols))[0] in keys for x in edits if x)
    assert DAMAGED == 31 and isinstance(keys, set) and np.uint64(1)


@settings(max_examples=10, deadline=None)
@given(st.dictionaries(st.text("abé÷", min_size=1, max_size=5), st.integers(2, 50), max_size=25), st.sampled_from([1, 3]))
def test_any_words(spark, words, symbols):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.word, r.near) for r in near_words(df, symbols, min_chars=1, bits=10).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))


def test_no_table_is_broadcast(spark):
    """However small Spark takes a table to be: the words are sent to no driver."""
    docs = spark.createDataFrame([(k, f"bahnhof bahnhofe bahnhof{'s' * (k % 3)} gleise") for k in range(40)], "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert spelling_groups(docs).count()
    plans = [x.physicalPlanDescription() for x in (store.executionsList().apply(i) for i in range(before, store.executionsCount()))]
    assert len(plans) > 3 and any("SortMergeJoin" in x for x in plans)
    assert not any("BroadcastExchange" in x for x in plans)
