import hashlib
import random

import pytest

from gleiswerk.llm import jaccard_join, suffix_dedup

SPACE = b" \t\n\x0b\x0c\r"


# -- suffix-array dedup -------------------------------------------------------------


def brute_spans(rows, length=50):
    """What goes from each row, by looking every string up."""
    first = {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        x = (text or "").encode()
        for p in range(len(x) - length + 1):
            first.setdefault(x[p : p + length], (doc is None, doc))
    out = []
    for doc, text in rows:
        x = (text or "").encode()
        gone = [False] * len(x)
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] != (doc is None, doc):
                gone[p : p + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got_spans(df, **kw):
    rows = suffix_dedup.repeated_spans(df, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s["length"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


def planted(seed=3, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(30) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [s[a : a + rng.randint(20, 120)], text(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "x"), (102, "ab" * 400), (103, "ab" * 300 + "c"), (104, "x\0" * 80), (105, "x\0" * 90), (2, rows[5][1])]
    return rows


@pytest.mark.parametrize(("blocks", "common", "suffixes"), [(1 << 20, 4096, 150_000), (2000, 4096, 40), (2000, 3, 1)])
def test_spans_planted(spark, monkeypatch, blocks, common, suffixes):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", suffixes)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_spans(df, block_bytes=blocks, common=common) == brute_spans(rows)


@pytest.mark.parametrize("which", ["odd", "none", "clash"])
def test_spans_odd(request, which):
    df = request.getfixturevalue(which)
    assert got_spans(df) == brute_spans([(r.doc_id, r.text) for r in df.collect()])


def test_null_id_is_last(spark):
    rows = [(None, "y" * 30 + "z" * 60), (9, "z" * 70), (3, None)]
    assert got_spans(spark.createDataFrame(rows, "doc_id long, text string")) == brute_spans(rows)


def test_cut_keeps_columns_and_null(spark, clash):
    out = suffix_dedup.cut_repeats(clash.dropDuplicates(["doc_id"]))
    assert out.columns == clash.columns and out.where("doc_id = 1 and text is null").count() == 1


def test_maximal_repeats():
    text = b"xabcabcyabcabcz"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = []
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    left = [text[i - 1] if i else -1 for i in order]
    runs, i = set(), 0
    deep = [c >= 3 for c in common]
    while i < len(common):
        if deep[i]:
            j = i
            while j < len(common) and deep[j]:
                j += 1
            for a, b, n in suffix_dedup.maximal_repeats(common[i:j], left[i : j + 1], 3):
                runs.add((text[order[i + a] : order[i + a] + n], b - a + 1))
            i = j
        else:
            i += 1
    want = set()
    for n in range(3, len(text)):
        for p in range(len(text) - n + 1):
            s = text[p : p + n]
            at = [q for q in range(len(text) - n + 1) if text[q : q + n] == s]
            if len(at) > 1 and len({text[q - 1] if q else -1 - q for q in at}) > 1 and len({text[q + n] if q + n < len(text) else -1 - q for q in at}) > 1:
                want.add((s, len(at)))
    assert runs == want


# -- Jaccard join -------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().translate(bytes(range(256))).split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(zip(ids, sets, strict=True))), key=str)


def got_components(df):
    return sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=str)


def near_copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    doc = 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(text))
                text[k : k + 1] = [word()] * rng.randint(0, 2)
            if rng.random() < 0.3:
                text += [word() for _ in range(rng.randint(1, 12))]
            rows.append((doc, rng.choice([" ", "  \n", "\t"]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
            doc += 1
    common = " ".join(word() for _ in range(40))
    rows += [(1000 + i, f"{common} {word()} {word()} {' '.join(word() for _ in range(i))}") for i in range(25)]
    rows += [(2000, "one two"), (2001, "ONE  two"), (2002, "two one"), (2003, ""), (2004, None), (2005, " \n"), (5, "repeated row"), (5, "repeated row"), (None, rows[0][1])]
    return rows


def test_components_planted(spark):
    rows = near_copies()
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_components(rows)


def test_components_of_small_groups(spark, monkeypatch):
    """Cells of several groups, queries in several parts, tasks that send many times."""
    for name, value in (("GROUP_MEMBERS", 3), ("GROUP_TOKENS", 300), ("GROUP_QUERIES", 2), ("GATHER", 500), ("HOT", 10**9)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(6)
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)) == brute_components(rows)


def test_groups_hold_all_links(spark):
    """Links come from groups: those inside where they are stored, the others from the groups that queries ask and open."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for _ in range(300):  # copies of one text, many of which are not similar to each other
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got_components(df) == brute_components(list(enumerate(texts)))
    rows = jaccard_join.with_rows(df)
    sets = jaccard_join.sets_of_documents(rows)
    levels = jaccard_join.token_levels(sets.where("counts is not null").select("slice", "counts"))
    known = jaccard_join.prefix_tokens(rows, levels, 4, True).select("token", "h", "n", "level", "index")
    rows = known.unionByName(jaccard_join.met_in_buckets(jaccard_join.prefix_tokens(rows, levels, 4, False)))
    marked = jaccard_join.with_cells(rows).cache()
    members = jaccard_join.members_of_cells(marked).cache()
    asked = jaccard_join.asked_cells(marked, members)
    assert members.groupBy("g").count().agg({"count": "max"}).first()[0] <= 2 * jaccard_join.GROUP_MEMBERS
    assert asked.count() < marked.select("h", "n").distinct().count() * members.select("cell").distinct().count()


def test_the_few_ask_the_many(spark):
    """Sets of a large group lie in many cells: those of small cells ask the large one, not each of its sets all of them."""
    rows = []
    for h in range(433):
        small = h % 11 + 1 if h >= 400 else 0  # 400 sets have token 0 as their highest index token, 33 one of eleven others
        rows += [(token, h, 40, 96 if token == 0 else 80, token == small) for token in range(12)]
    marked = jaccard_join.with_cells(spark.createDataFrame(rows, "token long, h long, n int, level int, index boolean")).cache()
    members = jaccard_join.members_of_cells(marked).cache()
    assert members.select("cell").distinct().count() == 12
    across = jaccard_join.asked_cells(marked, members).where("own is null")
    assert 33 <= across.count() < 400
    assert across.where("h < 400").isEmpty()


def test_least_shared_is_a_bound(spark):
    """Similar sets share so many of their prefixes' tokens in any order of the tokens."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    pairs, want = [], []
    while len(pairs) < 150:
        both = rng.randint(3, 60)
        a, b = both + rng.randint(0, 12), both + rng.randint(0, 12)
        if 100 * both < 75 * (a + b - both):
            continue
        tokens = rng.sample(range(1000), a + b - both)
        x, y = sorted(tokens[:a]), sorted(tokens[a - both :])
        assert len(set(x) & set(y)) == both
        pairs.append((len(x), max(1, len(y) - rng.randint(0, 9)), len(y) + rng.randint(0, 9)))
        want.append(len(set(x[: jaccard_join.prefix_size(len(x))]) & set(y[: jaccard_join.prefix_size(len(y))])))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k long, n long, lo long, hi long")
    got = {r.k: r.least for r in df.select("k", jaccard_join.least_shared(F.col("n"), F.col("lo"), F.col("hi")).alias("least")).collect()}
    assert all(got[k] <= w for k, w in enumerate(want))


def test_first_shared_token_is_an_index_token():
    """Of similar sets, in any order of the tokens: in the prefix of both, and early in that of the smaller one."""
    rng = random.Random(4)
    done = 0
    while done < 2000:
        both = rng.randint(1, 60)
        a, b = sorted((both + rng.randint(0, 12), both + rng.randint(0, 12)))
        if 100 * both < 75 * (a + b - both):
            continue
        tokens = rng.sample(range(1000), a + b - both)
        x, y = sorted(tokens[:a]), sorted(tokens[a - both :])
        first = min(set(x) & set(y))
        assert x.index(first) < jaccard_join.index_size(a) <= jaccard_join.prefix_size(a) and y.index(first) < jaccard_join.prefix_size(b)
        done += 1


def dealt_rows(spark, monkeypatch, texts):
    """How many texts move to groups in all, and the result."""
    seen, plain = [], jaccard_join.with_texts

    def counted(docs, dealt):
        seen.append(dealt.count())
        return plain(docs, dealt)

    monkeypatch.setattr(jaccard_join, "with_texts", counted)
    got = got_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    monkeypatch.setattr(jaccard_join, "with_texts", plain)
    return sum(seen), got


def test_form_letters_move_nowhere(spark, monkeypatch):
    """A long common part, but too short for a link: no text is sent to a group, however many there are."""
    common = " ".join(f"c{i}" for i in range(80))
    for n in (300, 900):
        texts = [common + "".join(f" own{k}x{i}" for i in range(14)) for k in range(n)]
        moved, got = dealt_rows(spark, monkeypatch, texts)
        assert moved == 0 and len({r[2] for r in got}) == n


def test_linked_copies_move_in_proportion(spark, monkeypatch):
    """Different texts that are all linked: each moves a few times, not once for each group before it."""
    monkeypatch.setattr(jaccard_join, "GROUP_MEMBERS", 8)
    common = [f"c{i}" for i in range(150)]
    moved = {}
    for n in (200, 800):
        texts = [" ".join(common + [f"own{k}"]) for k in range(n)]
        moved[n], got = dealt_rows(spark, monkeypatch, texts)
        assert len({r[2] for r in got}) == 1
        assert moved[n] <= 4 * n
    assert moved[800] <= 4.5 * moved[200]


@pytest.mark.parametrize("which", ["odd", "none", "documents", "clash"])
def test_components_brute(request, which):
    df = request.getfixturevalue(which)
    assert got_components(df) == brute_components([(r.doc_id, r.text) for r in df.collect()])


def test_chain_of_links(spark):
    """Neighbours are similar, the ends are not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_one_of_each(clash):
    out = jaccard_join.one_of_each(clash)
    assert out.columns == clash.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 5, 5, 6, 7]


def test_rows_of_null_and_repeated_ids(spark):
    """Each row is cut, or goes, for itself, whatever its doc_id."""
    a, b, c = ("".join(random.Random(k).choice("abcdefgh ") for _ in range(120)) for k in range(3))
    rows = [(1, a, 0), (2, f"{b}x{a}", 1), (2, f"{a}y{c}", 2), (None, f"{a}z", 3), (None, f"q{c}", 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(2)
    cut = suffix_dedup.cut_repeats(df).collect()
    assert sorted((r.n, r.doc_id, r.text) for r in cut) == [(0, 1, a), (1, 2, f"{b}x"), (2, 2, f"y{c}"), (3, None, "z"), (4, None, "q"), (5, 3, None)]
    words = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(3)]
    rows = [(7, words[0], 0), (None, words[0] + " more", 1), (None, words[1], 2), (None, words[1] + " more", 3), (8, words[2], 4), (8, words[0], 5), (None, None, 6), (None, "", 7)]
    kept = {r.n for r in jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(2)).collect()}
    assert {0, 4, 6, 7} <= kept and kept & {1, 5} == set() and len(kept & {2, 3}) == 1


def test_contents_of_one_hash_are_told_apart():
    import numpy as np

    data = np.frombuffer(b"abcabdabc", np.uint8)
    start, size = np.array([0, 3, 6]), np.array([3, 3, 3])
    for same in ([7, 7, 7], [1, 2, 1]):
        rep, inverse = suffix_dedup.told_apart(data, start, size, np.array(same, np.uint64))
        assert rep.tolist() == [0, 1] and inverse.tolist() == [0, 1, 0]
