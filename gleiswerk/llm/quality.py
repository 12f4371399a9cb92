"""Quality rules: isolation forests over rule statistics.

Each document's rule statistics are counted in the scan, many documents at
once, and each share becomes log-odds, shrunk by the length it is taken from.
Nothing is cut off below what a rule tolerates. Forests of random splits over
the whole range of the log-odds are fitted on a bounded sample of labelled
documents, one on good and one on bad ones (FIT_ROWS of them, half of each;
the only bounded part); a document's mean path length over the trees tells how
easily it is set apart from either. The score is the part of the good ones'
forest in both. The threshold is calibrated from all labelled rows: the lowest
score, in steps of 1 / STEPS, at which at least KEEP of the good documents stay
and the share of bad ones that go, less the share of good ones that go, is
largest.

Defined results: a null text has no words and fails the base rules. A null
doc_id is scored like any other. Rows with one doc_id are scored each for
itself. Without labels of both kinds nothing is calibrated, and the base rules
alone decide. An empty table gives an empty one. Other columns are ignored (or
kept, by ``good_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, free_names, materialize, mix, ngram_hashes, prefix_hashes, record_batch, span_hashes, table, text_rows, words_of

#: Labelled documents that the forests are fitted on, those of the smallest hashes.
FIT_ROWS = 4096
TREES, SAMPLE = 200, 256
STEPS, KEEP = 1000, 0.995
MIN_WORDS, MAX_REPEATED = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares in which a document can be odd, each counted as a part and a whole.
RATIOS = ("symbols", "repeated_words", "repeated_lines", "upper_case", "exclamation", "digits")
#: Added to each whole, so that one telephone number in a short clean text is little; the least prior share.
SHRINK, LEAST = 20, 0.001
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("counts", pa.list_(pa.int64()))])
_DDL = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", counts array<long>"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _UPPER = _class(b"#*$%&|<>"), _class(bytes(range(65, 91)))
_MARK, _DIGIT = _class(b"!"), _class(b"0123456789")
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_START = _class(bytes(set(range(256)) - set(range(0x80, 0xC0)) - {9, 10, 11, 12, 13, 32}))


def rule_statistics(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts, and the parts and the wholes of RATIOS, a row for each document."""
    base, counts = [np.zeros((0, 5), np.int64)], [np.zeros((0, 2 * len(RATIOS)), np.int64)]
    for i, j in chunks(raw):
        part = raw[i:j]
        data, starts, ends, first = words_of(part)
        sizes = np.array([len(x) + 1 for x in part], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])

        def count(of: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(of[data])])  # noqa: B023
            return total[bounds[1:]] - total[bounds[:-1]]  # noqa: B023

        n = np.diff(first)
        repeats = np.zeros(len(starts), bool)
        if len(starts) >= 3:
            owner = np.repeat(np.arange(len(part)), n)
            grams = ngram_hashes(span_hashes(prefix_hashes(data), starts, ends), 3)
            inside = np.flatnonzero(owner[:-2] == owner[2:])
            keys = mix(grams[inside] + mix(owner[inside].astype(np.uint64) + np.uint64(1)))
            order = np.argsort(keys)
            same = keys[order][1:] == keys[order][:-1]
            again = np.zeros(len(keys), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            for k in range(3):
                repeats[inside[again] + k] = True
        repeated = np.concatenate([[0], np.cumsum(repeats)])
        repeated = repeated[first[1:]] - repeated[first[:-1]]
        lines, copies = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for k, x in enumerate(part):
            seen: set[bytes] = set()
            found = [y for y in x.split(b"\n") if y.strip(b" \t\x0b\x0c\r")]
            seen.update(found)
            lines[k], copies[k] = len(found), len(found) - len(seen)
        chars, symbols, letters = count(_START), count(_SYMBOL), count(_LETTER)
        base.append(np.stack([n, chars, symbols, copies, repeated], 1))
        counts.append(np.stack([symbols, repeated, copies, count(_UPPER), count(_MARK), count(_DIGIT), chars, n, lines, letters, chars, chars], 1))
    return np.concatenate(base), np.concatenate(counts)


def prior_shares(counts: np.ndarray) -> np.ndarray:
    """Each of RATIOS over all rows together."""
    part, whole = np.split(counts.sum(0), 2)
    return np.clip(part / np.maximum(whole, 1), LEAST, 0.5)


def log_odds(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log-odds of the shares, shrunk by length; none has the same at any length."""
    part, whole = np.split(counts, 2, axis=1)
    share = part / (whole + SHRINK)
    return np.log((share + prior) / (1 - share + prior))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the counts of the ratios of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, counts = rule_statistics([x or b"" for x in batch.column(1).to_pylist()])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, counts.shape[1]), pa.int32()), pa.array(counts.ravel()))
            yield record_batch(_SCHEMA, [batch.column(0), *(np.ascontiguousarray(base[:, k]) for k in range(5)), flat])

    return text_rows(docs).mapInArrow(run, _DDL)


class IsolationForest:
    """Trees of random splits; the score of a row is 2 ** -(mean path / expected path). Splits are within ``box`` (lowest and highest values), or the rows' own range."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 20, box: tuple[np.ndarray, np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        self.box = box
        self.expected = self.average(min(sample, len(rows)))
        self.trees = [self._grow(rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def average(n: int) -> float:
        """The mean path of an unsuccessful search among n."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []
        deepest = int(np.ceil(np.log2(max(len(rows), 2))))

        def add(part: np.ndarray, depth: int, box: tuple[np.ndarray, np.ndarray] | None) -> int:
            node = len(feature)
            feature.append(-1)
            cut.append(0.0)
            left.append(node)
            right.append(node)
            path.append(depth + self.average(len(part)))
            low, high = box or (part.min(0), part.max(0))
            able = np.flatnonzero(high > low)
            if len(part) > 1 and depth < deepest and len(able):
                k = int(rng.choice(able))
                at = rng.uniform(low[k], high[k])
                feature[node], cut[node] = k, at
                column = np.arange(len(low)) == k
                left[node] = add(part[part[:, k] <= at], depth + 1, box and (low, np.where(column, at, high)))
                right[node] = add(part[part[:, k] > at], depth + 1, box and (np.where(column, at, low), high))
            return node

        add(rows, 0, self.box)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                go = f >= 0
                if not go.any():
                    break
                node = np.where(go, np.where(rows[at_row, np.maximum(f, 0)] <= cut[node], left[node], right[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(self.expected, 1e-9))


class Contrast:
    """A forest of good rows and one of bad ones, over the counts of RATIOS; a score beyond 0.5 is nearer to the bad ones."""

    def __init__(self, good: np.ndarray, bad: np.ndarray):
        self.prior = prior_shares(np.concatenate([good, bad]))
        highest = np.log((1 + self.prior) / self.prior)
        self.forests = [IsolationForest(log_odds(x, self.prior), box=(-highest, highest)) for x in (good, bad)]

    def score(self, counts: np.ndarray) -> np.ndarray:
        from_good, from_bad = (f.score(log_odds(counts, self.prior)) for f in self.forests)
        return from_good / (from_good + from_bad)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def scored(stats: DataFrame, forest: Contrast) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("counts")).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * len(RATIOS))
            kinds, back = np.unique(rows, axis=0, return_inverse=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(kinds)[back.ravel()])], names=[*batch.schema.names, "score"])

    return stats.mapInArrow(run, f"{_DDL}, score double")


def judged(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Base counts, base_failed, score (null if nothing could be fitted) and kept of each document."""
    stats = materialize(statistics(docs), "statistics")
    marks = labels.where("quality is not null").select(F.col("doc_id").alias("__doc"), F.col("quality").cast("int").alias("__good")).groupBy("__doc").agg(F.min("__good").alias("__good"))  # of labels that disagree the worse
    marked = stats.join(marks, F.col("doc_id") == F.col("__doc"))
    kinds = [marked.where(~base_failed() & (F.col("__good") == k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2).select("counts").toPandas()["counts"] for k in (1, 0)]
    out = stats.withColumn("base_failed", base_failed())
    none = out.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    if not all(len(x) for x in kinds):
        return none.drop("counts")
    results = materialize(scored(stats, Contrast(*(np.stack(x.to_list()) for x in kinds))), "scores")
    # a bounded table: a row for each step of the score and label
    steps = results.where(~base_failed()).join(marks, F.col("doc_id") == F.col("__doc")).groupBy(F.floor(F.col("score") * STEPS).cast("int").alias("step"), "__good").count().toPandas()
    good, bad = (np.bincount(x["step"], x["count"], STEPS + 2) for x in (steps[steps["__good"] == 1], steps[steps["__good"] == 0]))
    stay = np.concatenate([[0], np.cumsum(good)[:-1]]) / good.sum()  # below each step
    go = 1 - np.concatenate([[0], np.cumsum(bad)[:-1]]) / bad.sum()
    gain = np.where(stay >= KEEP, go - (1 - stay), -2.0)
    gain[-1] = max(gain[-1], 0.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    step = int(best[len(best) // 2])  # the middle of equally good ones
    verdict = results.withColumn("base_failed", base_failed())
    return verdict.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("score") * STEPS) < step)).drop("counts")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones; of rows with one doc_id all stay if any may."""
    (doc,) = free_names(docs, "__doc")
    kept = judged(docs, labels).where("kept").select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", *BASE, "base_failed", "kept", "score")
