"""Line dedup: lines that many documents share stay in one document only.

Per document the distinct line keys are hashed (128 bits) inside the scan, so
only (hash, doc_id) pairs are shuffled, never the text; documents are counted
per hash, and the hashes over the threshold come back to each document as its
own list. Text moves once, to meet that list.

Defined results: a null or empty text is one empty line; a null text stays
null. Rows with one doc_id are one document to the count. A null doc_id is
counted as no document and loses no line. An empty table gives an empty one.
Columns besides doc_id and text pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, record_batch, table, text_rows

MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 16
STRIP = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_HASHES = pa.schema([("doc_id", pa.int64()), ("line_hash", pa.binary())])


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(STRIP).lower()


def long_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the line's key, or None if the key has too few code points."""
    key = line_key(line)
    if len(key) < min_chars or len(key.translate(None, _CONTINUATION)) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_hash), once for each distinct long line of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and doc is not None:
                    found = {long_hash(x, min_chars) for x in text.split(b"\n")} - {None}
                    ids += [doc] * len(found)
                    out += found
            yield record_batch(_HASHES, [ids, out])

    return text_rows(docs).mapInArrow(run, "doc_id long, line_hash binary")


def dropped_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, hashes): the keys whose lines each document loses."""
    occurs = line_hashes(docs, min_chars)
    common = occurs.groupBy("line_hash").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    # a line may be in a third of all documents: its hash is dealt out to many tasks, where its one row of `common` is copied to
    parts = F.explode(F.array(*map(F.lit, range(SALTS))))
    own = occurs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return own.join(common.select("line_hash", "keeper", parts.alias("part")), ["line_hash", "part"]).where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("line_hash").alias("__drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the dropped lines gone from text, and as its last columns the numbers of lines and of those dropped: __n_lines and __n_dropped, or longer names where these are taken."""
    fields = docs.schema.fields
    names = [f.name for f in fields]
    doc, drop_, n_lines, n_dropped = free_names(docs, "__doc", "__drop", "__n_lines", "__n_dropped")
    lost = dropped_hashes(docs, min_chars, min_docs).toDF(doc, drop_)
    joined = docs.join(lost, F.col("doc_id").cast("long") == F.col(doc), "left").select(*names, drop_)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, counts, gone = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                kept = lines
                if drop:
                    lost = set(drop)
                    kept = [x for x in lines if long_hash(x.encode(), min_chars) not in lost]
                texts.append(None if text is None else "\n".join(kept) if drop else text)
                counts.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*names, n_lines, n_dropped])

    return joined.mapInArrow(run, f"{kinds}, {n_lines} long, {n_dropped} long")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
