"""What the operators of this subpackage share: reading, materialising, hashing words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds: documents may be long, so batches stay small.
BATCH_ROWS = 2000
#: Bytes of text that numpy works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by whatever path Spark's readers can open."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share; a temporary one only where none is named (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleiswerk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark deletes the shuffle files of a query at its end.
FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. The shuffle files of the write go with its end, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLE, "false")
    spark.conf.set(FREE_SHUFFLE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing to come reads: what was made of them is written. Others are left alone."""
    for df in (t for t in tables if hasattr(t, "scratch_path")):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A row's own key, for tables where doc_ids are null or repeated.
ROW = "__row"


#: Steps that hand on a file's rows one by one, so that a row's partition and place are those of its file each time.
_STRAIGHT = re.compile(r"(?:AdaptiveSparkPlan|WholeStageCodegen|Project|Filter|ColumnarToRow|InputAdapter|(?:File|Batch)?Scan)\b")


def straight_from_files(df: DataFrame) -> bool:
    """Whether ``df`` only reads, selects and filters the rows of files."""
    steps = [x.lstrip(" +-:*()0123456789") for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    return any("Scan" in x for x in steps) and all(_STRAIGHT.match(x) for x in steps if x)


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ROW, alike in each use: rows straight from files are numbered by their place there, others are written once."""
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    return numbered if straight_from_files(docs) else materialize(numbered, "rows")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the UTF-8 bytes of text and ``more``, nothing else: other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def chunks(raw: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of at most ``limit`` bytes together (one document at least)."""
    i = total = 0
    for j, x in enumerate(raw):
        if j > i and total + len(x) > limit:
            yield i, j
            i, total = j, 0
        total += len(x) + 1
    if i < len(raw):
        yield i, len(raw)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# -- 64-bit hashes over many documents at once ---------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads near values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of byte hashes times base**position over [i, j)."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, alike wherever the span lies."""
    down = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MUL)


def words_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of many documents: bytes of all, starts, ends, first word of each document (and the count)."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
    return data, starts, ends, np.searchsorted(starts, bounds)


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row (across document ends too; the caller drops those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words[j : j + n]
    return mix(out)


# -- checksums in DuckDB's SQL ---------------------------------------------------


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8, where a table ``t`` of one row has ``CRC32_TABLE``."""
    byte = f"list_transform(range(0, CAST(strlen({text}) AS BIGINT)), lambda i: CAST(concat('0x', hex(encode({text}))[2 * i + 1 : 2 * i + 2]) AS BIGINT))"
    return f"xor(4294967295, list_reduce({byte}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))"


#: ``crc``: what each byte does to a checksum.
CRC32_TABLE = "SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc"
