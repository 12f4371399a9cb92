"""Language ID by cross-parsing: the language whose labelled text parses a document into the fewest phrases.

Per language a suffix automaton of a bounded sample of labelled text answers
longest matches. A document is parsed greedily: a phrase is the longest
string from here on that occurs in the language's text, and one new letter
starts the next; a letter that isn't there at all is an empty match and itself. Phrases are normalised by the letters parsed; the language
with the fewest wins.

The sample is bounded (SAMPLE_ROWS documents of each language, those of
SAMPLE_CHARS characters first and then those of any length, in the order of
the hashes of their text, with at most SAMPLE_LETTERS letters used, or as many as
keep an automaton within CELLS transitions); every document is parsed whole.
Documents are parsed in step with each other, RUN letters at a time, so that
the automata advance by array operations; their states carry over from run to
run. Each letter of the samples has a class of its own.

Defined results: ``und`` with score 0 for a null text, a text without letters,
or if there is nothing to learn from. Ties go to the first language by name.
A null doc_id is not held out and never learned from. Rows with one doc_id are
predicted each for itself; an empty table gives an empty one. Other columns
are ignored. The sample has as many rows as there are labels times
SAMPLE_ROWS; labels are languages, and so few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import record_batch, table

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_LETTERS = 64, (200, 8000), 60_000
RUN = 1024
#: Transitions of an automaton, as a table of states and of its language's letters.
CELLS = 24_000_000
#: From this number of documents on the automata advance by array operations.
FEW = 16
END = 65535
HOLD_OUT_OF, HELD_OUT = 4, 2
UNKNOWN = "und"
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HOLD_OUT_OF)) == HELD_OUT, F.lit(False))


def letters_table(alphabet: str) -> np.ndarray:
    """Code point -> class: 0 a break (no letter), 1 a letter beyond the alphabet, 2 and up the alphabet's."""
    out = np.zeros(0x110000, np.uint16)
    place = {c: i + 2 for i, c in enumerate(alphabet)}
    for start in range(0, 0x110000, 0x1000):
        for cp in range(start, start + 0x1000):
            if 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                out[cp] = place.get(low[0], 1)
    return out


def classes(text: str, table: np.ndarray) -> np.ndarray:
    """The classes of a text's letters; other characters become one break between words."""
    x = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(x):
        return x
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    keep[0] = x[0] != 0
    return x[keep]


class SuffixAutomaton:
    """All substrings of a sequence of classes; ``step`` maps state and class to the next state and whether a phrase begins."""

    def __init__(self, sequence: np.ndarray, n_classes: int):
        letters = np.unique(sequence[sequence > 1])
        self.size = len(letters) + 2
        self.local = np.ones(n_classes, np.int32)  # a letter of other languages is one beyond its alphabet
        self.local[0] = 0
        self.local[letters] = np.arange(2, self.size)
        sequence = self.local[sequence[: max(1, min(SAMPLE_LETTERS, CELLS // (2 * self.size)))]].tolist()
        follow: list[dict[int, int]] = [{}]
        link, longest, last = [-1], [0], 0
        for c in sequence:
            state = len(follow)
            follow.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in follow[p]:
                follow[p][c] = state
                p = link[p]
            if p != -1:
                q = follow[p][c]
                if longest[p] + 1 == longest[q]:
                    link[state] = q
                else:
                    clone = len(follow)
                    follow.append(dict(follow[q]))
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    while p != -1 and follow[p].get(c) == q:
                        follow[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
        rows = np.fromiter((s for s, x in enumerate(follow) for _ in x), np.int64)
        cols = np.fromiter((c for x in follow for c in x), np.int64)
        to = np.fromiter((t for x in follow for t in x.values()), np.int64)
        # a class that can't follow begins the next phrase, from the root; one that is nowhere is an empty match and a letter, so two phrases
        self.start = len(follow) * self.size
        first = np.full(self.size, self.start)
        first[list(follow[0])] = np.array(list(follow[0].values()), np.int64) * self.size
        step = np.tile(first * 4 + np.where(first == self.start, 2, 1), (len(follow) + 1, 1))
        step[rows, cols] = to * self.size * 4
        self.step = step.astype(np.int32).ravel()  # (next state * classes) << 2 | phrases that begin

    def advance(self, at: np.ndarray, begun: np.ndarray, lanes: np.ndarray) -> None:
        """lanes[k] holds the k-th class of each document, END beyond its end (documents in order of their lengths): moves the states, counts the phrases begun."""
        live = lanes.shape[1]
        for row in lanes:
            while live and row[live - 1] == END:
                live -= 1
            if not live:
                break
            got = self.step[at[:live] + self.local[row[:live]]]
            begun[:live] += got & 3
            at[:live] = got >> 2

    def finish(self, at: int, rest: np.ndarray) -> int:
        """The phrases begun in the rest of one document."""
        step, begun = memoryview(self.step), 0
        for c in self.local[rest].tolist():
            got = step[at + c]
            begun += got & 3
            at = got >> 2
        return begun


class Languages:
    """The automata of all languages, over one alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        kept = {name: "\n".join(texts[name])[: 2 * SAMPLE_LETTERS] for name in sorted(texts)}
        self.alphabet = "".join(sorted({c for x in kept.values() for c in x.lower() if c.isalpha()}))[: END - 2]
        self.table = letters_table(self.alphabet)
        self.names = list(kept)
        self.automata = [SuffixAutomaton(classes(kept[n], self.table), len(self.alphabet) + 2) for n in self.names]

    def phrases(self, documents: list[np.ndarray]) -> np.ndarray:
        """The phrases of each document (classes) by each automaton."""
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        sizes = [len(documents[i]) for i in order]
        at = [np.full(len(order), a.start, np.int32) for a in self.automata]
        begun = np.zeros((len(self.automata), len(order)), np.int64)
        live, start = sum(n > 0 for n in sizes), 0
        while live >= FEW:
            lanes = np.full((live, min(RUN, sizes[0] - start)), END, np.uint16)
            for k in range(live):
                part = documents[order[k]][start : start + RUN]
                lanes[k, : len(part)] = part
            lanes = np.ascontiguousarray(lanes.T)
            for a, automaton in enumerate(self.automata):
                automaton.advance(at[a], begun[a], lanes)
            start += RUN
            while live and sizes[live - 1] <= start:
                live -= 1
        for k in range(live):
            for a, automaton in enumerate(self.automata):
                begun[a, k] += automaton.finish(int(at[a][k]), documents[order[k]][start:])
        out = np.zeros_like(begun)
        out[:, order] = begun
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each text, and how far it is ahead of the second: 1 - its phrases / the second's."""
        documents = [classes(text, self.table) for text in texts]
        letters = np.array([int((x != 0).sum()) for x in documents], np.int64)
        rate = self.phrases([x if n else x[:0] for x, n in zip(documents, letters, strict=True)]) / np.maximum(letters, 1)
        names, scores = [], []
        for i in range(len(texts)):
            if not letters[i] or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            own = rate[:, i]
            best = int(np.argmin(own))
            rest = np.delete(own, best)
            names.append(self.names[best])
            scores.append(float(min(1.0, max(0.0, 1 - own[best] / rest.min()))) if len(rest) else 1.0)
        return names, scores


_ready: dict[str, Languages] = {}


def languages_of(texts: dict[str, list[str]]) -> Languages:
    """Built once in each Python worker."""
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = Languages(texts)
    return _ready[key]


def learning_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """At most ``rows`` texts of each language, of documents that aren't held out."""
    order = Window.partitionBy("lang").orderBy(F.desc("fits"), "h", "text")
    fit = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    some = fit.select("lang", F.substring("text", 1, 2 * SAMPLE_LETTERS).alias("text"), F.xxhash64("text").alias("h"), F.length("text").between(*SAMPLE_CHARS).alias("fits"))
    chosen = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    out: dict[str, list[str]] = {}
    for r in chosen.select("lang", "k", "text").orderBy("lang", "k").toLocalIterator():
        out.setdefault(r.lang, []).append(r.text)
    return out


def identify(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = languages_of(shared.value)
        for batch in batches:
            names, scores = own.predict([x or "" for x in batch.column(1).to_pylist()])
            yield record_batch(_OUT, [batch.column(0), names, scores])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learning_sample(docs))
