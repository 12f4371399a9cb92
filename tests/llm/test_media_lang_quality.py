import hashlib
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from gleiswerk.llm import language_id, media, quality
from gleiswerk.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


# -- media: a second writer, with every feature of the format --------------------------


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8), bitorder="little").tobytes()


def code_lengths(used, size):
    """Complete lengths over the symbols used."""
    n = len(used)
    out = np.zeros(size, np.int64)
    k = max(1, int(np.ceil(np.log2(n))))
    short = (1 << k) - n
    for i, s in enumerate(sorted(used)):
        out[s] = k - 1 if i < short else k
    return out


def put_code(w, used, size):
    """Writes a code; returns how to write its symbols."""
    used = sorted(set(used)) or [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        w.put(used[0], 8)
        if len(used) == 2:
            w.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    if len(used) == 1:
        used.append(0)
    lengths = code_lengths(used, size)
    w.put(0, 1)
    w.put(15, 4)
    for k in media.LENGTH_ORDER:
        w.put(4 if k < 13 else 5, 3)
    of = np.array([4] * 13 + [5] * 6)
    codes = media.canonical(of)
    w.put(0, 1)
    i = 0
    while i < size:
        j = i
        while j < size and lengths[j] == lengths[i]:
            j += 1
        run = j - i
        if lengths[i] == 0 and run >= 11:
            n = min(run, 138)
            w.put(int(codes[18]), 5)
            w.put(n - 11, 7)
        elif lengths[i] == 0 and run >= 3:
            n = min(run, 10)
            w.put(int(codes[17]), 5)
            w.put(n - 3, 3)
        elif i and lengths[i] and lengths[i - 1] == lengths[i] and run >= 3:
            n = min(run, 6)
            w.put(int(codes[16]), 5)
            w.put(n - 3, 2)
        else:
            n = 1
            w.put(int(codes[lengths[i]]), int(of[lengths[i]]))
        i += n
    own = media.canonical(lengths)
    return {s: (int(own[s]), int(lengths[s])) for s in used}


def prefix(v):
    """Code, extra bits and their value of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), n, v & (1 << n) - 1


def put_pixels(w, pixels, width, main, cache_bits=0, copies=False, meta=0):
    """Writes a picture of codes; copies: back-references and the cache are used where they fit."""
    n = len(pixels)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = [0] * n
    if main:
        w.put(1 if meta else 0, 1)
        if meta:
            w.put(meta - 2, 3)
            across, down = -(-width >> meta), -(-(n // width) >> meta)
            which = [(i * 7) % 3 for i in range(across * down)]
            put_pixels(w, [g << 8 for g in which], across, False)
            groups = [which[(i // width >> meta) * across + (i % width >> meta)] for i in range(n)]
    ops, i = [], 0
    cache = {}
    while i < n:
        far, run = 0, 0
        if copies:
            for d in (1, 2, width, width - 1, width + 1, 5 * width + 3):
                k = 0
                while i + k < n and i - d >= 0 and pixels[i + k - d] == pixels[i + k] and k < 300:
                    k += 1
                if k > run:
                    far, run = d, k
        key = (media.CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if run >= 3:
            near = [k for k, (x, y) in enumerate(media.NEAR, 1) if max(1, x + y * width) == far]
            lc, dc = prefix(run), prefix(near[0] if near else far + len(media.NEAR))
            ops.append((groups[i], "copy", lc, dc))
            step = run
        elif cache_bits and cache.get(key) == pixels[i]:
            ops.append((groups[i], "cache", key, None))
            step = 1
        else:
            ops.append((groups[i], "pixel", pixels[i], None))
            step = 1
        if cache_bits:
            for k in range(i, i + step):
                cache[(media.CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        i += step
    tables = []
    for g in range(max(groups) + 1):
        own = [o for o in ops if o[0] == g]
        lit = [o[2] for o in own if o[1] == "pixel"]
        green = [p >> 8 & 255 for p in lit] + [256 + o[2][0] for o in own if o[1] == "copy"] + [280 + o[2] for o in own if o[1] == "cache"]
        size = 280 + ((1 << cache_bits) if cache_bits else 0)
        tables.append([put_code(w, green, size), put_code(w, [p >> 16 & 255 for p in lit], 256), put_code(w, [p & 255 for p in lit], 256), put_code(w, [p >> 24 & 255 for p in lit], 256), put_code(w, [o[3][0] for o in own if o[1] == "copy"], 40)])
    for g, kind, a, b in ops:
        green, red, blue, alpha, distance = tables[g]
        if kind == "pixel":
            for table, v in ((green, a >> 8 & 255), (red, a >> 16 & 255), (blue, a & 255), (alpha, a >> 24 & 255)):
                w.put(*table[v])
        elif kind == "copy":
            w.put(*green[256 + a[0]])
            w.put(a[2], a[1])
            w.put(*distance[b[0]])
            w.put(b[2], b[1])
        else:
            w.put(*green[280 + a])


def picture(w, width, height):
    body = b"\x2f" + w.bytes()
    even = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(even)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + even


def start(width, height):
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def argb(rng, n, few=False):
    base = rng.integers(0, 256, (6 if few else n, 4))
    parts = base[rng.integers(0, 6, n)] if few else base
    return (parts[:, 0].astype(np.int64) << 24 | parts[:, 1] << 16 | parts[:, 2] << 8 | parts[:, 3]).tolist()


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize(("cache", "copies", "meta"), [(0, False, 0), (0, True, 0), (4, False, 0), (10, True, 0), (3, True, 2), (0, False, 3)])
def test_decode_codes(few, cache, copies, meta):
    width, height = 23, 17
    pixels = argb(np.random.default_rng(cache + meta), width * height, few)
    w = start(width, height)
    w.put(0, 1)
    put_pixels(w, pixels, width, True, cache, copies, meta)
    assert media.decode(picture(w, width, height))[2].tolist() == pixels


def test_decode_predictor():
    width, height, block = 19, 30, 2
    rng = np.random.default_rng(1)
    pixels = np.array(argb(rng, width * height)).reshape(height, width)
    across, down = -(-width >> block), -(-height >> block)
    modes = [(i * 5) % 14 for i in range(across * down)]
    p = media.channels(pixels)
    rest = np.zeros_like(p)
    for y in range(height):
        for x in range(width):
            if y == 0:
                expect = p[y, x - 1].tolist() if x else [255, 0, 0, 0]
            elif x == 0:
                expect = p[y - 1, x].tolist()
            else:
                right = p[y - 1, x + 1] if x + 1 < width else p[y, 0]
                expect = media.predicted(modes[(y >> block) * across + (x >> block)], *(v.tolist() for v in (p[y, x - 1], p[y - 1, x], right, p[y - 1, x - 1])))
            rest[y, x] = (p[y, x] - np.array(expect)) & 255
    w = start(width, height)
    w.put(1, 1)
    w.put(0, 2)
    w.put(block - 2, 3)
    put_pixels(w, [m << 8 for m in modes], across, False)
    w.put(0, 1)
    put_pixels(w, media.joined(rest).ravel().tolist(), width, True)
    assert (media.decode(picture(w, width, height))[2] == pixels.ravel()).all()


def test_decode_cross_colour_and_green():
    width, height, block = 20, 12, 3
    rng = np.random.default_rng(2)
    pixels = np.array(argb(rng, width * height))
    across = -(-width >> block)
    factors = np.array(argb(rng, across * -(-height >> block)))
    at = np.arange(len(pixels))
    f = media.channels(factors)[(at // width >> block) * across + (at % width >> block)]
    p = media.channels(pixels)
    s = media.signed
    green = s(p[:, 2])
    new = p.copy()
    new[:, 1] = (p[:, 1] - (s(f[:, 3]) * green >> 5)) & 255
    new[:, 3] = (p[:, 3] - (s(f[:, 2]) * green >> 5) - (s(f[:, 1]) * s(p[:, 1]) >> 5)) & 255
    # then subtract-green, which is undone first
    new[:, 1] = (new[:, 1] - new[:, 2]) & 255
    new[:, 3] = (new[:, 3] - new[:, 2]) & 255
    w = start(width, height)
    w.put(1, 1)
    w.put(1, 2)
    w.put(block - 2, 3)
    put_pixels(w, factors.tolist(), across, False)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    put_pixels(w, media.joined(new).tolist(), width, True)
    assert (media.decode(picture(w, width, height))[2] == pixels).all()


@pytest.mark.parametrize("colours", [2, 4, 9, 200])
def test_decode_palette(colours):
    width, height = 21, 11
    rng = np.random.default_rng(colours)
    palette = np.array(argb(rng, colours))
    index = rng.integers(0, colours, width * height).reshape(height, width)
    shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    bits, across = 8 >> shift, -(-width >> shift)
    packed = np.zeros((height, across), np.int64)
    for x in range(width):
        packed[:, x >> shift] |= index[:, x] << (x & (1 << shift) - 1) * bits
    p = media.channels(palette)
    w = start(width, height)
    w.put(1, 1)
    w.put(3, 2)
    w.put(colours - 1, 8)
    put_pixels(w, media.joined(np.diff(p, axis=0, prepend=0)).tolist(), colours, False)
    w.put(0, 1)
    put_pixels(w, (packed.ravel() << 8).tolist(), across, True)
    assert (media.decode(picture(w, width, height))[2] == palette[index.ravel()]).all()


def test_grey_round_trip():
    rng = np.random.default_rng(3)
    for x in (b" " * 192, bytes(range(256)) * 3, rng.integers(0, 256, 192 * 70, np.uint8).tobytes(), b"the and of with " * 12 * 40, b"\x00" * 384, ("Été ÜBER " * 400).encode()[: 192 * 20]):
        assert media.decode_grey(media.encode_grey(x)) == x
    long = rng.integers(97, 105, 192 * (media.MAX_HEIGHT + 5), np.uint8).tobytes()
    stored = media.encode_grey(long)
    assert len(list(media.pictures(stored))) == 2 and media.decode_grey(stored) == long


def steps(monkeypatch, stored):
    """What the reader meets in stored pictures."""
    met, read = set(), media.read_group

    def group(bits, cache_bits):
        out = read(bits, cache_bits)
        symbols = out[0].entries >> 4
        met.update(name for name, there in (("cache", (symbols >= 280).any()), ("copies", ((symbols >= 256) & (symbols < 280)).any())) if there)
        met.add(("code", out[0].entries.tobytes()))
        return out

    with monkeypatch.context() as m:
        m.setattr(media, "read_group", group)
        for name in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette"):
            m.setattr(media, name, lambda *a, f=getattr(media, name), name=name: met.add(name[5:]) or f(*a))
        pixels = np.concatenate([media.decode(x)[2] for x in media.pictures(stored)])
    return met, pixels


def entropy_bytes(x):
    return sum(-n * np.log2(n / len(x)) for n in Counter(x).values()) / 8


def test_grey_writer_takes_each_step(monkeypatch):
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(3, 9), np.uint8)) for _ in range(80)]
    prose = b" ".join(words[k] for k in rng.integers(0, 80, 3000))
    base64 = rng.choice(np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 20000).tobytes()
    slope = (np.cumsum(rng.integers(-1, 2, (64, 192)), 1) + np.arange(64)[:, None] * 3 & 255).astype(np.uint8).tobytes()
    again = np.concatenate([np.tile(rng.integers(0, 256, 2, np.uint8), 6)[rng.permutation(12)] for _ in range(1600)]).tobytes()
    cases = [
        (media.payload_of(prose), {"copies"}),
        (rng.choice(np.frombuffer(b"ab", np.uint8), 192 * 20, p=[0.9, 0.1]).tobytes(), {"palette"}),
        (rng.choice(np.frombuffer(b"acgtn\n", np.uint8), 192 * 20, p=[0.7, 0.1, 0.1, 0.04, 0.03, 0.03]).tobytes(), {"palette"}),
        (slope, {"predictor"}),
        (again, {"cache"}),
    ]
    for x, expected in cases:
        stored = media.encode_grey(x)
        met, pixels = steps(monkeypatch, stored)
        assert expected <= met and (pixels & 255).astype(np.uint8).tobytes() == x
    assert len(media.encode_grey(cases[0][0])) < 0.8 * entropy_bytes(cases[0][0])
    # codes are a picture's own: no more than the entropy and a head
    x = media.payload_of(base64)
    assert len(media.encode_grey(x)) < 1.01 * entropy_bytes(x) + 200
    # and of parts of a picture
    x = media.payload_of(base64 + bytes(rng.integers(200, 240, 20000, np.uint8)))
    met, pixels = steps(monkeypatch, media.encode_grey(x))
    assert (pixels & 255).astype(np.uint8).tobytes() == x and len(media.encode_grey(x)) < 0.93 * entropy_bytes(x)


@pytest.mark.parametrize("kind", ["noise", "few", "photo", "alpha", "one", "many"])
def test_colour_round_trip(monkeypatch, kind):
    rng = np.random.default_rng(5)
    width, height = 67, 41
    n = width * height
    green = np.cumsum(rng.integers(-2, 3, (height, width)), 1).ravel() + 128
    picture = {
        "noise": lambda: np.array(argb(rng, n)),
        "few": lambda: np.array(argb(rng, n, True)),
        "photo": lambda: media.joined(np.stack([np.full(n, 255), (green - 128) // 2 + rng.integers(0, 2, n), green, 90 - (green - 128) // 2], -1)),
        "alpha": lambda: media.joined(np.stack([rng.integers(0, 4, n) * 80, np.zeros(n), np.zeros(n), np.zeros(n)], -1)),
        "one": lambda: np.full(n, 0x80102030),
        "many": lambda: np.array(argb(rng, 300))[np.abs(np.cumsum(rng.integers(-3, 4, n))) % 300],
    }[kind]()
    stored = media.encode(picture, width)
    met, pixels = steps(monkeypatch, stored)
    assert (pixels == picture).all() and media.decode(stored)[:2] == (width, height)
    if kind == "photo":
        assert {"cross_colour", "predictor"} & met and len(stored) < n


def odd_payloads():
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(300)]
    out = [media.payload_of(b" ".join(words[k] for k in rng.integers(0, 300, n))) for n in (0, 1, 40, 300, 2000, 9000, 40000)]
    out += [rng.integers(0, 256, 192 * n, np.uint8).tobytes() for n in (1, 2, 40)] + [b"\0" * 192, b"\0" * 19200, b"ab" * 960, bytes(range(192)) * 200]
    out += [rng.choice(np.frombuffer(b"ab\n", np.uint8), 192 * 40, p=[0.9, 0.05, 0.05]).tobytes()]
    out += [(np.cumsum(rng.integers(-1, 2, (64, 192)), 1) + np.arange(64)[:, None] * 3 & 255).astype(np.uint8).tobytes()]
    return out + [media.payload_of(b"x" * n) for n in range(0, 2000, 77)] * 8


def test_pictures_written_together_are_those_written_alone():
    payloads = odd_payloads()
    alone = [media.encode_grey(x) for x in payloads]
    assert [media.decode_grey(x) for x in alone] == payloads
    order = np.random.default_rng(7).permutation(len(payloads))
    assert media.encode_greys([payloads[k] for k in order]) == [alone[k] for k in order]
    assert media.encode_greys(payloads) == alone and media.encode_greys([]) == []


def test_cut_pictures_raise():
    stored = media.encode_grey(odd_payloads()[4])
    for n in range(60, len(stored) - 2, 97):
        with pytest.raises(ValueError):
            media.decode(stored[:n])


def test_writing_and_reading_take_few_steps(documents):
    """Python's own steps are few for each byte; numpy does what each pixel and bit takes."""
    payloads = [media.payload_of((r.text or "").encode()) for r in documents.collect()]
    tool, lines = sys.monitoring, Counter()
    own = media.__file__
    tool.use_tool_id(tool.PROFILER_ID, "steps")
    tool.register_callback(tool.PROFILER_ID, tool.events.LINE, lambda code, line: lines.update([1]) if code.co_filename == own else tool.DISABLE)
    tool.set_events(tool.PROFILER_ID, tool.events.LINE)
    try:
        stored = [x for k in range(0, len(payloads), 50) for x in media.encode_greys(payloads[k : k + 50])]
        assert [media.decode_grey(x) for x in stored] == payloads
    finally:
        tool.set_events(tool.PROFILER_ID, 0)
        tool.register_callback(tool.PROFILER_ID, tool.events.LINE, None)
        tool.free_tool_id(tool.PROFILER_ID)
    total = sum(map(len, payloads))
    assert lines[1] < 2.5 * total


def test_odd_code_counts():
    for counts in ([0] * 256 + [5] + [0] * 23, [0] * 280, [3] + [0] * 279, [0] * 7 + [1, 0, 4] + [0] * 270, [1] * 280, (1.6 ** np.arange(40)).astype(np.int64).tolist() + [0] * 240, [9] + [0] * 278 + [1]):
        counts = np.array(counts)
        out = media.BitList()
        lengths, codes = media.put_code(out, counts)
        code = media.read_code(media.Bits(out.bytes() + bytes(8)), 280)
        for s in np.flatnonzero(counts).tolist():
            e = int(code.entries[codes[s] & code.mask])
            assert (e >> 4, e & 15) == (s, lengths[s])
        assert lengths.max() <= 15


@pytest.mark.parametrize("which", ["odd", "none", "documents", "clash"])
def test_media_query(request, which):
    docs = request.getfixturevalue(which)
    texts = {}
    for r in docs.collect():
        x = (r.text or "").encode()
        texts[r.doc_id] = (len(x), media.payload_of(x))
    rows = media.media_features(media.media(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, payload = texts[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(payload) % 192 == 0 and payload
    if which == "documents":
        assert sum(r.media_bytes for r in rows) < 0.8 * sum(r.payload_bytes for r in rows)


# -- language ID -----------------------------------------------------------------------


def brute_phrases(learned, text):
    """Phrases by searching the learned text."""
    learned, text = ("".join(map(chr, x.tolist())) for x in (learned, text))
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in learned:
            j += 1
        n, i = n + 1 + (text[i] not in learned), j
    return n


def test_phrases_are_longest_matches():
    own = language_id.Languages({"aa": ["banana bandana cabana"], "bb": ["zebra zoo zonal"]})
    for text in ("bananas and zebras", "cabanabanana", "qqq banana", "zoo"):
        x = language_id.classes(text, own.table)
        for name, automaton in zip(own.names, own.automata, strict=True):
            learned = language_id.classes({"aa": "banana bandana cabana", "bb": "zebra zoo zonal"}[name], own.table)
            assert automaton.finish(automaton.start, x) == brute_phrases(learned, x)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, language_id.learning_sample(docs)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_odd(spark, odd, none, clash):
    for df in (odd, clash):
        got = {r.doc_id: r for r in language_id.identify(df, {"en": ["one two three"], "fr": ["déjà vu été"]}).collect()}
        assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
        assert got[4].lang_pred == "en" and got[5].lang_pred == "fr"
        assert got[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    assert language_id.identify(none, {}).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.learning_sample(none) == {}


def test_languages_of_short_or_long_texts_are_learned(spark):
    """Each language is learned, if none of its texts is of the preferred length."""
    texts = {"en": "the house by the river " * 20, "de": "das haus am fluss", "fr": "la maison et le fleuve " * 20_000}
    rows = [(k, text, lang) for lang, text in texts.items() for k in range(8)]
    sample = language_id.learning_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(sample) == set(texts)
    assert max(len(x) for x in sample["fr"]) <= 2 * language_id.SAMPLE_LETTERS
    assert language_id.Languages(sample).predict(["das haus am fluss", "la maison et le fleuve"])[0] == ["de", "fr"]


# -- quality rules -----------------------------------------------------------------------


def brute_base(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = [False] * len(words)
    for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if grams[g] > 1:
            inside[i : i + 3] = [True] * 3
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), copies, sum(inside))


@pytest.mark.parametrize("which", ["odd", "none", "documents", "clash"])
def test_base_statistics(request, spark, which):
    docs = request.getfixturevalue(which)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = sorted((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    rows = quality.judged(docs, labels).collect()
    assert sorted((r.doc_id, *(r[n] for n in quality.BASE)) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() >= 0.99 and bad.kept.mean() <= 0.2


def test_forest_separates_outliers():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.normal(0, 0.05, (500, 3)), rng.normal(1, 0.05, (10, 3))])
    forest = quality.IsolationForest(rows)
    scores = forest.score(rows)
    assert scores[500:].min() > np.quantile(scores[:500], 0.95)
    # path lengths are those of walking each tree
    feature, cut, left, right, path = forest.trees[0]
    x, node = rows[7], 0
    while feature[node] >= 0:
        node = left[node] if x[feature[node]] <= cut[node] else right[node]
    assert path[node] > 0


def test_without_labels(odd, none, spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.kept == (not r.base_failed) for r in quality.judged(odd, nothing).collect()} == {True}
    assert quality.good_documents(none, nothing).count() == 0


def test_quality_learns_below_the_tolerances(spark):
    """Bad documents of 20 % capitals or 1.5 % symbols, less than a rule tolerates, are learned from the labels."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(300):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(60 + k)]
        good = k % 3 > 0
        if k % 3 == 0 and k % 2:
            words = [w.title() for w in words]
        elif k % 3 == 0:
            words = [w + "#" if i % 12 == 0 else w for i, w in enumerate(words)]
        rows.append((k, " ".join(words), "en", "a", None))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[k].kept for k in range(300) if k % 3)
    assert not any(got[k].kept for k in range(300) if k % 3 == 0)


def test_letters_of_large_alphabets_have_classes_of_their_own():
    """Two languages of 600 ideographs each, and one text of many runs, parsed by its longest matches."""
    import random

    from gleiswerk.llm import language_id

    rng = random.Random(1)
    signs = [chr(0x4E00 + i) for i in range(1200)]
    text = lambda part, n: "".join(rng.choice(part) for _ in range(n))
    samples = {"aa": [text(signs[:600], 3000)], "bb": [text(signs[600:], 3000)]}
    own = language_id.Languages(samples)
    names, scores = own.predict([text(signs[:600], 50), text(signs[600:], 50), text(signs[600:], 5000), "", "123"] + [text(signs[:600], 2500)] * 20)
    assert names == ["aa", "bb", "bb", "und", "und"] + ["aa"] * 20 and min(scores[:3]) > 0

    for x in [text(signs[:600], 30), samples["aa"][0][100:3000], samples["aa"][0][:1500] + text(signs, 700)]:
        c = language_id.classes(x, own.table)
        want = [brute_phrases(language_id.classes(samples[k][0], own.table), c) for k in ("aa", "bb")]
        assert own.phrases([c])[:, 0].tolist() == want
        assert own.phrases([c] * 20)[:, 7].tolist() == want


def test_good_documents_of_clashing_columns(spark, clash):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.good_documents(clash, none)
    assert out.columns == clash.columns and {r.doc_id for r in out.collect()} <= {4, 7}


def test_of_labels_that_disagree_the_worse_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    other = labels.where("doc_id % 3 = 0").selectExpr("doc_id", "1 - quality as quality", "toxic")
    worse = labels.selectExpr("doc_id", "if(doc_id % 3 = 0, 0, quality) as quality", "toxic")
    verdict = lambda marks: sorted((r.doc_id, r.kept) for r in quality.judged(docs, marks).collect())
    want = verdict(worse)
    assert verdict(labels.select("doc_id", "quality", "toxic").union(other)) == want == verdict(other.union(labels))
