"""Phrase collocation mining by vertical partitioning, as suffix trees of long strings are built in parts.

A word's key is a 64-bit hash of its language and itself; a phrase is the list of its words' keys. No phrase hash
takes part in a count, and two words of one key end the run with an error, so counts are exact.

1. One scan counts the words. Words below the least count can't stand in a phrase.
2. A second scan counts prefixes of two words, by hash: one that is too rare can't start a suffix, nor go on in one.
   Both findings are kept as bitmaps of a fixed size, in which a chance hit only lets more through.
3. Prefix classes (ranges of the prefix's hash) are grouped until a group's suffixes fill a memory budget; a class
   that passes the budget alone is split further by the rest of its suffixes.
4. A third scan sends each suffix, cut at ``DEPTH`` words, at the end of its piece or at a rare prefix, to its group.
   Equal suffixes of one task go as one row with a number, so copies of any passage stay few rows.
5. Each group is built on its own: sorted suffixes are the leaves, common prefixes of neighbours the nodes, and the
   sum of a node's leaves is the count of its phrase. Only a split class has nodes in several groups; they are added up.

Scores, containment and the first phrases of each language are joins and aggregates over the counted phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, whole
from quillspark.llm.words import Words, byte_class, mix
from quillspark.session import materialize

DEPTH = 4
LEAST = 30
FILTER_BITS = 25
CLASS_BITS = 12
BUDGET = 1 << 20
HELD = 1 << 21
NO_LANG = "und"
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D), *[(b, b) for b in PIECE_ENDS])
ENDS = byte_class(*[(b, b) for b in PIECE_ENDS])
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lang_seed(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), dtype="<u8")[0]


class Texts:
    """Word keys of many texts at once, and which of them follow each other within a piece."""

    def __init__(self):
        self.words = Words(WORD_BYTES)

    def each(self, batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each language of a batch (``lang, text``): it, the bytes, starts, ends, keys, and whether the next word follows."""
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            data = np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)  # the line feed ends a piece
            starts, ends, hashes = self.words.of(data)
            keys = mix(hashes ^ lang_seed(lang))
            keys[keys == 0] = 1
            ended = np.zeros(len(data) + 1, dtype=np.int32)
            np.cumsum(ENDS[data], out=ended[1:])
            follows = np.zeros(len(keys), dtype=bool)
            follows[:-1] = ended[starts[1:]] == ended[ends[:-1]]
            yield lang, data, starts, ends, keys, follows


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    out = np.zeros(len(keys), dtype=np.uint64)
    out[:-1] = mix(keys[:-1] * _P + keys[1:] * _Q)
    return out


class Bits:
    """A set of hashes as a bitmap: all of its members are found, others by chance."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.shift = np.frombuffer(data, dtype=np.uint8), np.uint64(64 - bits)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(found: DataFrame, key: str, bits: int) -> bytes:
    """Bitmap over the leading ``bits`` of the keys, made of Spark's bitmap aggregates; 2 ** bits / 8 bytes at any number of keys."""
    at = F.shiftrightunsigned(key, 64 - bits) + 1  # Spark numbers buckets from 1 and their bits from the value before
    rows = found.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows.collect():  # 2 ** (bits - 15) rows of 4 KB
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)[: len(out) - at]
    return out.tobytes()


def _shipped(spark: SparkSession, data: bytes):
    """A value of fixed size for all tasks."""
    return spark.sparkContext.broadcast(data)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def count_words(texts: DataFrame) -> DataFrame:
    """``key, lang, word, n`` of all words; an error if two words share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Texts()
        names = ["key", "lang", "word", "n"]
        known: dict[str, np.ndarray] = {}
        counts: dict[str, list] = {}
        held = 0

        def merged(lang):
            keys, ns = (np.concatenate(c) for c in zip(*counts[lang], strict=True))
            u, inverse = np.unique(keys, return_inverse=True)
            return u, np.bincount(inverse, weights=ns, minlength=len(u)).astype(np.int64)

        def flush():
            for lang in counts:
                u, n = merged(lang)
                for at in range(0, len(u), 100_000):
                    part = slice(at, at + 100_000)
                    m = len(u[part])
                    yield pa.RecordBatch.from_arrays([_longs(u[part]), pa.array([lang] * m, pa.string()), pa.nulls(m, pa.string()), pa.array(n[part])], names)
            counts.clear()

        for batch in batches:
            for lang, data, starts, ends, keys, _ in read.each(batch):
                u, first, n = np.unique(keys, return_index=True, return_counts=True)
                seen = known.setdefault(lang, np.zeros(0, dtype=np.uint64))
                new = np.flatnonzero(~np.isin(u, seen, assume_unique=True))
                if len(new):
                    low, at, to = read.words.lower[data].tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
                    strings = [low[a:b].decode() for a, b in zip(at, to, strict=True)]
                    size = max(len(s) for s in strings)
                    step = max(1, min(100_000, (16 << 20) // size))
                    for k in range(0, len(new), step):
                        part = new[k : k + step]
                        yield pa.RecordBatch.from_arrays(
                            [_longs(u[part]), pa.array([lang] * len(part), pa.string()), pa.array(strings[k : k + step], pa.string()), pa.array(np.zeros(len(part), np.int64))], names
                        )
                    known[lang] = np.union1d(seen, u[new])
                counts.setdefault(lang, []).append((u, n))
                held += len(u)
            if held > HELD:
                for lang in counts:
                    counts[lang] = [merged(lang)]
                held = sum(len(c[0][0]) for c in counts.values())
                if held > HELD // 2:
                    yield from flush()
                    known.clear()
                    held = 0
        yield from flush()

    named = F.struct("lang", "word")
    words = texts.mapInArrow(run, "key bigint, lang string, word string, n bigint").groupBy("key").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("word").isNotNull(), named)).alias("low"), F.max(F.when(F.col("word").isNotNull(), named)).alias("high")
    )
    words = materialize(words.select("key", "low.lang", "low.word", "n", (F.col("low") != F.col("high")).alias("clash")))
    if words.where("clash").limit(1).count():
        raise ValueError("two words have the same 64-bit key")
    return words.drop("clash")


def count_pairs(texts: DataFrame, often, filter_bits: int) -> DataFrame:
    """``pair, n``: hashes of two words that follow each other, both of them frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, words = Texts(), Bits(often.value, filter_bits)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged():
            keys, ns = (np.concatenate(c) for c in zip(*parts, strict=True))
            u, inverse = np.unique(keys, return_inverse=True)
            return u, np.bincount(inverse, weights=ns, minlength=len(u)).astype(np.int64)

        def flush(u, n):
            for at in range(0, len(u), 200_000):
                yield pa.RecordBatch.from_arrays([_longs(u[at : at + 200_000]), pa.array(n[at : at + 200_000])], ["pair", "n"])

        for batch in batches:
            for _, _, _, _, keys, follows in read.each(batch):
                frequent = words.holds(keys)
                follows = follows & frequent
                follows[:-1] &= frequent[1:]
                u, n = np.unique(pair_keys(keys)[follows], return_counts=True)
                parts.append((u, n))
                held += len(u)
            if held > HELD:
                u, n = merged()
                parts, held = [(u, n)], len(u)
                if held > HELD // 2:
                    yield from flush(u, n)
                    parts, held = [], 0
        if parts:
            yield from flush(*merged())

    return texts.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def group_plan(sizes: dict[int, int], budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First group of each prefix class, its number of groups, and the number of all groups.

    Classes are taken in their order into a group until its budget is full; one above the budget gets groups of its own.
    """
    base, split = np.zeros(1 << CLASS_BITS, dtype=np.int64), np.ones(1 << CLASS_BITS, dtype=np.int64)
    group, filled = 0, 0
    for c in range(1 << CLASS_BITS):
        size = sizes.get(c, 0)
        if size > budget:
            group += filled > 0
            base[c], split[c], filled = group, -(-size // budget), 0
            group += int(split[c])
            continue
        if filled + size > budget:
            group, filled = group + 1, 0
        base[c] = group
        filled += size
    return base, split, group + 1


def suffixes(texts: DataFrame, often, pairs, filter_bits: int, plan: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``grp, split, k1 .. k4, n``: suffixes of two to four words with their number, 0 for words beyond the end."""
    base, split = plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, words, prefixes = Texts(), Bits(often.value, filter_bits), Bits(pairs.value, filter_bits)
        names = ["grp", "split", *(f"k{d + 1}" for d in range(DEPTH)), "n"]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged(rows: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            h = rows[0].copy()
            for d in range(1, DEPTH):
                h = mix(h * _P + rows[d] * _Q)
            _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            if not np.array_equal(rows, rows[:, first][:, inverse]):  # two suffixes of one hash: by all their words
                _, first, inverse = np.unique(rows, axis=1, return_index=True, return_inverse=True)
            return rows[:, first], np.bincount(inverse.ravel(), weights=ns, minlength=len(first)).astype(np.int64)

        def flush(rows, ns):
            at = (mix(rows[0] * _P + rows[1] * _Q) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
            rest = (mix(rows[2] * _P + rows[3] * _Q + np.uint64(1)) >> np.uint64(1)).astype(np.int64)
            grp = base[at] + rest % split[at]
            for k in range(0, len(ns), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grp[part]), pa.array(split[at[part]] > 1), *[_longs(np.ascontiguousarray(r[part])) for r in rows], pa.array(ns[part])], names
                )

        for batch in batches:
            for _, _, _, _, keys, follows in read.each(batch):
                frequent = words.holds(keys)
                go = follows & frequent
                go[:-1] &= frequent[1:]
                go &= prefixes.holds(pair_keys(keys))
                at = np.flatnonzero(go)
                rows = np.zeros((DEPTH, len(at)), dtype=np.uint64)
                rows[0] = keys[at]
                open_, place = np.ones(len(at), dtype=bool), at
                for d in range(1, DEPTH):
                    open_ = open_ & go[np.minimum(place, len(go) - 1)]
                    place = place + 1
                    rows[d, open_] = keys[place[open_]]
                if len(at):
                    parts.append(merged(rows, np.ones(len(at), dtype=np.int64)))
                    held += len(parts[-1][1])
            if held > HELD:
                rows, ns = merged(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))
                parts, held = [(rows, ns)], len(ns)
                if held > HELD // 2:
                    yield from flush(rows, ns)
                    parts, held = [], 0
        if parts:
            yield from flush(*merged(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])))

    return texts.mapInArrow(run, "grp bigint, split boolean, " + ", ".join(f"k{d + 1} bigint" for d in range(DEPTH)) + ", n bigint")


def subtree_counts(leaves: np.ndarray, ns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Depth, place of the first leaf and count of each node from depth 2 on; ``leaves`` (words x suffixes) must be sorted.

    A node of depth d starts where a leaf shares fewer than d words with the one before it, and its count is the
    total of its leaves.
    """
    n = leaves.shape[1]
    differs = np.ones((DEPTH, n), dtype=bool)
    for d in range(DEPTH):
        differs[d, 1:] = leaves[d, 1:] != leaves[d, :-1]
        if d:
            differs[d] |= differs[d - 1]
    for depth in range(2, DEPTH + 1):
        starts = np.flatnonzero(differs[depth - 1])
        totals = np.add.reduceat(ns, starts) if n else ns
        there = leaves[depth - 1, starts] != 0
        yield depth, starts[there], totals[there]


def phrase_counts(grouped: DataFrame, least: int, n_groups: int) -> DataFrame:
    """``k1 .. k4, a`` of the phrases of two to four words found at least ``least`` times."""
    keys = [f"k{d + 1}" for d in range(DEPTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, split, parts = None, False, []

        def build():
            rows = np.concatenate([p[0] for p in parts], axis=1)
            ns = np.concatenate([p[1] for p in parts])
            order = np.lexsort(rows[::-1])
            rows, ns = rows[:, order], ns[order]
            for depth, first, totals in subtree_counts(rows, ns):
                if not split:
                    first, totals = first[totals >= least], totals[totals >= least]
                for at in range(0, len(first), 100_000):
                    place = first[at : at + 100_000]
                    columns = [pa.array(rows[d, place] if d < depth else np.zeros(len(place), np.int64), pa.int64()) for d in range(DEPTH)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(totals[at : at + 100_000])], [*keys, "a"])

        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
                if high == low:
                    continue
                if groups[low] != grp:
                    if parts:
                        yield from build()
                    grp, parts = groups[low], []
                    split = bool(batch.column(1)[low].as_py())
                part = batch.slice(low, high - low)
                rows = np.array([part.column(2 + d).to_numpy() for d in range(DEPTH)])
                parts.append((rows, part.column(2 + DEPTH).to_numpy()))
                if split and sum(p[1].size for p in parts) > 4 * BUDGET:  # a split class may be built in any pieces
                    yield from build()
                    parts = []
        if parts:
            yield from build()

    placed = grouped.repartition(n_groups, "grp").sortWithinPartitions("grp", "split")
    nodes = placed.mapInArrow(run, ", ".join(f"{k} bigint" for k in keys) + ", a bigint")
    return nodes.groupBy(*keys).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _part(start: int, size: int) -> list:
    """The keys of a run of words inside a phrase, filled up with zeros."""
    return [F.col(f"k{start + d + 1}") if d < size else F.lit(0).cast("long") for d in range(DEPTH)]


def _parts(phrases: DataFrame, spans, *more: str) -> DataFrame:
    """One row for each run ``spans(size) -> (tag, start, size)`` of each phrase: the phrase as ``p``, ``tag``, the run as ``k1 .. k4``."""
    size = sum((F.col(f"k{d + 1}") != 0).cast("int") for d in range(DEPTH))
    listed = F.lit(None)
    for n in range(2, DEPTH + 1):
        runs = [
            F.struct(F.lit(tag).alias("tag"), *[k.alias(f"k{d + 1}") for d, k in enumerate(_part(start, length))]) for tag, start, length in spans(n)
        ]
        listed = F.when(size == n, F.array(*runs)).otherwise(listed) if runs else listed
    return phrases.select(F.struct(*[f"k{d + 1}" for d in range(DEPTH)]).alias("p"), *more, F.explode(listed).alias("r")).select("p", *more, "r.*")


def _cuts(n: int) -> list[tuple[int, int, int]]:
    """Both sides of each cut of n words; the tag is twice the words before it, plus one for the rest."""
    return [x for k in range(1, n) for x in ((2 * k, 0, k), (2 * k + 1, k, n - k))]


def _inner(n: int) -> list[tuple[int, int, int]]:
    """All runs of two or more words inside n words."""
    return [(0, start, size) for size in range(2, n) for start in range(n - size + 1)]


def collocations(
    docs: DataFrame, top: int = 2000, least: int = LEAST, filter_bits: int = FILTER_BITS, budget: int = BUDGET,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A-Z is lower-cased; ``.,;:!?`` and line ends cut a text into pieces, blanks and tabs a piece into words. A phrase has two to
    four words of one piece and stands there ``a >= least`` times. Its score is the least of ``2000000 * a // (l + r)`` over
    its cuts into a first part (``l``) and a rest (``r``). It goes if a longer phrase that holds it is at least 0.8 as frequent.

    * Null and empty texts have no words; a null language is ``und``. Repeated rows count again.
    * Ties of the score go by ``a``, then by the phrase's bytes. Very long texts and words are read whole, the former in parts.
    * An empty table, or no phrase of that count, gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keys = [f"k{d + 1}" for d in range(DEPTH)]
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), whole(text).alias("text"))
    words = count_words(texts)
    frequent = words.where(F.col("n") >= least)
    often = _shipped(spark, bitmap_of(frequent, "key", filter_bits))
    pairs = materialize(count_pairs(texts, often, filter_bits).where(F.col("n") >= least))
    starts = _shipped(spark, bitmap_of(pairs, "pair", filter_bits))
    classes = pairs.groupBy(F.shiftrightunsigned("pair", 64 - CLASS_BITS).alias("c")).agg(F.sum("n").alias("n"))
    base, split, n_groups = group_plan({r["c"]: r["n"] for r in classes.collect()}, budget)  # 2 ** CLASS_BITS rows at most
    phrases = materialize(phrase_counts(suffixes(texts, often, starts, filter_bits, (base, split)), least, n_groups))

    known = phrases.unionByName(frequent.select(F.col("key").alias("k1"), *[F.lit(0).cast("long").alias(k) for k in keys[1:]], F.col("n").alias("a")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    sides = _parts(phrases, _cuts, "a").join(known.withColumnRenamed("a", "f"), keys).withColumn("k", F.expr("tag div 2"))
    cuts = sides.groupBy("p", "a", "k").agg(
        F.max(F.when(F.col("tag") % 2 == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("tag") % 2 == 1, F.col("f"))).alias("r")
    ).withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    around = _parts(phrases, _inner, "a").groupBy(*keys).agg(F.max("a").alias("longer"))
    left = best.select(*[F.col(f"p.{k}").alias(k) for k in keys], "a", "b.l", "b.r", "b.score").join(around, keys, "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * 80)
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a")]
    first = left.join(frequent.select(F.col("key").alias("k1"), "lang"), "k1")
    first = materialize(first.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top))
    spelled = (
        first.select("lang", *keys, "a", "l", "r", "score", F.posexplode(F.array(*keys)).alias("at", "key")).where("key <> 0")
        .join(frequent.select("key", "word"), "key").groupBy("lang", *keys, "a", "l", "r", "score")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    )
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
