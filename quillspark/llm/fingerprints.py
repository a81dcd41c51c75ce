"""Document fingerprints: quartile digests of hashed byte triplets.

A digest counts the byte triplets of a text in 256 hash buckets and says of each bucket in which quarter of the
counts it lies (two bits a bucket), with a code for the length and two for the spread of the counts. Two
digests are compared by a score of their differences, bounded by what unrelated digests differ by.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, shuffle_parts, whole

BUCKETS = 256
HEADER = 3
#: Expected difference of two unrelated digests: 1.25 a bucket, as for independent codes 0 to 3.
BOUND = BUCKETS * 1.25
_CHUNK = 1 << 20


def triplet_counts(data: bytes) -> np.ndarray:
    """Number of byte triplets in each bucket, of a text of any length."""
    raw = np.frombuffer(data, dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(len(raw) - 2, 0), _CHUNK):
        part = raw[at : at + _CHUNK + 2].astype(np.uint32)
        triplet = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        counts += np.bincount((triplet * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> np.ndarray:
    """Codes of a text: length, spread of the counts (two), then 0 to 3 for each bucket."""
    counts = triplet_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.zeros(HEADER + BUCKETS, dtype=np.int16)
    codes[0] = min(255, round(8 * math.log2(len(data) + 1)))
    codes[1:HEADER] = (15 * q1 // q3, 15 * q2 // q3) if q3 else (0, 0)
    codes[HEADER:] = (counts > q1).astype(np.int16) + (counts > q2) + (counts > q3)
    return codes


def as_text(codes: np.ndarray) -> str:
    """Hexadecimal form: length, spread, then four buckets a byte."""
    body = codes[HEADER:].reshape(-1, 4)
    packed = (body << np.array([6, 4, 2, 0], dtype=np.int16)).sum(axis=1).astype(np.uint8)
    return bytes([int(codes[0]), int(codes[1]) << 4 | int(codes[2])]).hex() + packed.tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    body = (raw[2:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3
    return np.concatenate([[raw[0], raw[1] >> 4, raw[1] & 15], body.ravel()]).astype(np.int16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for those that differ as much as unrelated ones or more."""
    apart = np.abs(a - b)
    score = int(apart[HEADER:].sum()) + int(apart[0]) + int(apart[1:HEADER].sum())
    return 1.0 - min(float(score), BOUND) / BOUND


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row, from its whole text; null counts as empty.

    Texts of fewer than three bytes have no triplets: their digests differ by length only. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(digest(t.as_py().encode())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, fingerprint string"
    )


def _part_of(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are not above ``value``, found by way of every n-th cut."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda some: F.size(F.filter(some, lambda c: c <= value))
    group = below(F.array(*[F.lit(g[0]) for g in groups]))
    inner = below(F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), group - 1))
    return F.when(value.isNull() | (group == 0), 0).otherwise((group - 1) * step + inner)


def in_order_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(doc_id, text, tail)`` dealt out and sorted by id, so that each is followed by the next document.

    Ids are cut into even ranges, one a partition, and each text moves once. The first document of a range also
    goes to the end of the range before (``tail`` = 1), the very first to the end of the last: the one thing
    that a partition needs from another. Only ranges and their first ids pass through the driver.
    """
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    if isinstance(docs.schema[doc_id].dataType, T.NumericType):
        shares = [i / n for i in range(1, n)]
        cuts = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)) if shares else F.array(F.lit(0.5)), 20 * n)).first()[0]
        cuts = sorted(set(cuts or []))[: n - 1]
    else:  # no percentiles: even cuts of the ids with the smallest hashes, 20 a range
        some = ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(20 * n)
        drawn = sorted(r["doc_id"] for r in some.collect())
        cuts = drawn[20 :: 20][: n - 1]
    part = _part_of(F.col("doc_id"), cuts)
    firsts = ids.select("doc_id", part.alias("part")).groupBy("part").agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null_first")
    ).collect()
    heads: list = [None] * (len(cuts) + 1)
    before, filled = [0] * (len(cuts) + 1), sorted(r["part"] for r in firsts)
    for r in firsts:
        heads[r["part"]] = None if r["null_first"] else r["first"]
        before[r["part"]] = filled[filled.index(r["part"]) - 1]
    id_type = docs.schema[doc_id].dataType
    array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    is_head = F.col("doc_id").eqNullSafe(F.get(array(heads, id_type), F.col("part")))
    places = F.when(
        is_head, F.array(F.struct(F.col("part"), F.lit(0).alias("tail")), F.struct(F.get(array(before, "int"), F.col("part")).alias("part"), F.lit(1).alias("tail")))
    ).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("tail"))))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")).withColumn("part", part)
        .select("doc_id", "text", F.inline(places))
        .repartitionById(len(cuts) + 1, F.col("part").cast("int"))
        .sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
        .select("doc_id", "text", "tail")
    )


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    The edited text is the text with its last half (rounded down, in code points) replaced by as many code
    points from the start of the next document, by ascending id, or by all of it if it is shorter; after the
    last document comes the first. ``near_edited`` and ``near_next`` tell how like the fingerprint is to that
    of the edited text and of the next document.

    * Null text: empty. A document alone in its table is its own next one. An empty table gives no rows.
    * Rows that share an id follow one another in the order of a hash of their texts; rows without an id come
      first. Other columns are not read.
    * Texts of any length are handled one at a time; a task holds two and their digests.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for key, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = digest(text.encode())
                if held is not None:
                    out.append(pair(*held, text, codes))
                held = None if tail else (key, text, codes)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def pair(key, text, codes, following, next_codes):
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        edited_codes = digest(edited)
        return (
            key, len(text), hashlib.sha256(edited).hexdigest(), as_text(codes), as_text(edited_codes),
            likeness(codes, edited_codes), likeness(codes, next_codes),
        )

    schema = f"doc_id {id_type}, n_chars bigint, " + ", ".join(f"{c} string" for c in names[2:5])
    return in_order_with_next(docs, doc_id, text).mapInArrow(run, f"{schema}, near_edited double, near_next double")
