"""Benchmark decontamination by template canonicalisation.

Texts are read as lower-cased words; numbers (with separators and decimals), units after a number and names (runs of
capitalised words) become typed placeholders, one each. Windows are hashed twice, of words as they stand and with
placeholders, and joined to the windows of the benchmark items. Hits of one item within a span of the text form a
match, however many places words were put in or left out at; where placeholders stand for other values than in the
item, they count only if the values were replaced consistently; windows matched as they stand count by themselves. So
a question with other numbers is caught, and a sentence that only has the same form is not.

What a task holds of the benchmark is a bitmap of fixed size that lets few other windows pass; the join is a
shuffle on the window's hash, for benchmarks of any size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, whole
from quillspark.llm.words import Words, byte_class, grams, mix
from quillspark.session import materialize

WINDOW = 8
MIN_LITERALS = 4
FILTER_BITS = 22

# Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "ms", "s", "sec", "seconds", "min", "minutes", "h",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "inch", "inches", "foot",
    "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds", "percent", "euro", "euros",
    "dollar", "dollars", "cent", "cents", "degrees", "liters", "litres", "meters", "metres", "grams", "mph", "kmh",
)
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_SLOT = pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("value", pa.int64())])
_HIT = pa.struct([("pos", pa.int64()), ("span", pa.int64()), ("size", pa.int32()), ("gram", pa.int64()), ("slots", pa.list_(_SLOT))])
_HITS = "array<struct<pos: bigint, span: bigint, size: int, gram: bigint, slots: array<struct<at: int, kind: int, value: bigint>>>>"


class Canonical:
    """Windows of texts, as they stand and with placeholders."""

    def __init__(self, is_word: np.ndarray, units: tuple[str, ...], window: int, min_literals: int):
        self.words, self.window, self.min_literals = Words(is_word), window, min_literals
        self.units = np.sort(np.array([self.words.of(np.frombuffer(u.encode(), np.uint8))[2][0] for u in units]))
        self.stops = byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3A), (0x3F, 0x3F))
        self.in_number = byte_class((0x27, 0x27), (0x2C, 0x2C), (0x2E, 0x2E))
        self.in_name = byte_class((0x20, 0x20), (0x27, 0x27), (0x2D, 0x2D))
        self.placeholders = mix(np.arange(1, 4, dtype=np.uint64))
        # letters that take another number of bytes in lower case; no letter beyond this range has one
        other = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if len(c.lower().encode()) != len(c.encode())]
        self.uneven = re.compile("([" + "".join(other) + "])")

    def lowered(self, text: str) -> str:
        """Lower case with every letter at the bytes where it stood: letters that would grow or shrink stay as they are."""
        if text.isascii():
            return text.lower()
        return "".join(part if k % 2 else part.lower() for k, part in enumerate(self.uneven.split(text)))

    def kinds(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """0 literal, 1 number, 2 unit, 3 name. A name is capitalised and does not begin a sentence."""
        first = data[starts]
        following = data[np.minimum(starts + 1, len(data) - 1)]
        number = (first >= 0x30) & (first <= 0x39)
        capital = ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (following >= 0x80) & (following <= 0x9E))
        stops = np.concatenate([[0], np.cumsum(self.stops[data])])
        opens = np.ones(len(starts), dtype=bool)
        opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
        after_number = np.concatenate([[False], number[:-1]])
        at = np.minimum(np.searchsorted(self.units, hashes), len(self.units) - 1)
        unit = after_number & (self.units[at] == hashes)
        return np.where(number, 1, np.where(unit, 2, np.where(capital & ~opens, 3, 0)))

    def tokens(self, data, starts, ends, hashes):
        """Words, with those of one number or name together: (first word, kind, value); at the end the number of words."""
        kinds = self.kinds(data, starts, ends, hashes)
        fresh = np.ones(len(hashes), dtype=bool)
        gap = data[ends[:-1]]
        alike = (kinds[1:] == kinds[:-1]) & (starts[1:] - ends[:-1] == 1)
        fresh[1:] = ~(alike & ((kinds[1:] == 1) & self.in_number[gap] | (kinds[1:] == 3) & self.in_name[gap]))
        first = np.flatnonzero(fresh)
        rank = np.arange(len(hashes)) - np.repeat(first, np.diff(np.concatenate([first, [len(hashes)]])))
        values = np.add.reduceat(hashes * mix(rank.astype(np.uint64) + np.uint64(1)), first)
        kind = kinds[first]
        return np.concatenate([first, [len(hashes)]]), kind, np.where(kind > 0, values, hashes[first])

    def hits(self, data, starts, ends, hashes, passes, short: tuple[set, set] | None = None) -> tuple[list[dict], bool]:
        """Windows whose hash ``passes``, and whether the text has enough literals to be looked for inside others.

        Windows are given by first word and number of words; those with placeholders carry their values. ``short``:
        further sizes, of windows as they stand and with placeholders; None: the whole text, if it is shorter.
        """
        n = len(hashes)
        if n == 0:
            return [], False
        out: list[dict] = []
        for size in sorted({min(n, self.window), *(k for k in (short or ((), ()))[0] if k <= n)}):
            plain = grams(hashes, size)
            out += [{"pos": i, "span": size, "size": size, "gram": int(g), "slots": []} for i, g in _taken(plain, passes(plain))]
        first, kinds, values = self.tokens(data, starts, ends, hashes)
        enough = int((kinds == 0).sum()) >= self.min_literals
        if not kinds.any():
            return out, enough
        said = np.where(kinds > 0, self.placeholders[np.maximum(kinds, 1) - 1], values)
        slots = np.concatenate([[0], np.cumsum(kinds > 0)])
        sizes = {min(self.window, len(kinds))} if short is None else {self.window, *short[1]}
        for size in sorted(k for k in sizes if k <= len(kinds)):
            held = slots[size:] - slots[:-size]
            counts = (held > 0) & (size - held >= self.min_literals)
            if not counts.any():
                continue
            shaped = mix(grams(said, size) + np.uint64(1))
            for i, g in _taken(shaped, counts & passes(shaped)):
                at = np.flatnonzero(kinds[i : i + size])
                found = values[i + at].view(np.int64)
                out.append({"pos": int(first[i]), "span": int(first[i + size] - first[i]), "size": size, "gram": int(g), "slots": [
                    {"at": int(a), "kind": int(kinds[i + a]), "value": int(v)} for a, v in zip(at, found, strict=True)
                ]})
        return out, enough


def _taken(hashes: np.ndarray, mask: np.ndarray):
    at = np.flatnonzero(mask)
    return zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True)


def _windows(
    rows: DataFrame, bitmap: np.ndarray | None, window: int, min_literals: int, short: tuple[set, set] | None = None
) -> DataFrame:
    """``key, n_words, enough, hits`` of rows ``(key, text)``; with a bitmap only the windows that pass it."""
    key_type = rows.schema["key"].dataType.simpleString()
    is_word, units = WORD_BYTES, UNITS
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Canonical(is_word, units, window, min_literals)
        bits = None if bitmap is None else np.unpackbits(bitmap).view(bool)
        passes = (lambda h: np.ones(len(h), dtype=bool)) if bits is None else (lambda h: bits[h >> shift])
        for batch in batches:
            counts, hits, enough = [], [], []
            texts = batch.column(1).to_pylist()
            for i, _, starts, ends, hashes in reader.words.each([reader.lowered(t) for t in texts]):
                data = np.frombuffer(texts[i].encode(), dtype=np.uint8)  # capital letters tell names
                counts.append(len(hashes))
                found = reader.hits(data, starts, ends, hashes, passes, short)
                hits.append(found[0])
                enough.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(enough, pa.bool_()), pa.array(hits, pa.list_(_HIT))],
                ["key", "n_words", "enough", "hits"],
            )

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"key {key_type}, n_words bigint, enough boolean, hits {_HITS}")


def _consistent(pairs: set) -> bool:
    """One value of the item always stands for one value of the text.

    Several may become equal, but not equal to one of them that stays: then a place has the value of another.
    """
    stands = defaultdict(set)
    for k, a, b in pairs:
        stands[k, b].add(a)
    return len({(k, a) for k, a, _ in pairs}) == len(pairs) and all(
        len(a) == 1 or b not in a for (_, b), a in stands.items()
    )


def _copies(hits: list[dict]) -> Iterator[list[dict]]:
    """Hits that may be of one copy of an item: each diagonal, and with each the others that go on in both orders.

    ``hits`` are of one item in one span. Diagonals are taken by their number of hits, others by nearness to them.
    """
    lines = defaultdict(list)
    for h in hits:
        lines[h["pos"] - h["j"]].append(h)
    ends = {d: (min(h["j"] for h in v), max(h["j"] for h in v)) for d, v in lines.items()}
    used = set()
    for d in sorted(lines, key=lambda d: (-len(lines[d]), d)):
        yield lines[d]
        if d in used or len(lines) == 1:
            continue
        chosen = [d]
        for e in sorted(lines, key=lambda e: (abs(e - d), e)):
            (a, b), p, q = ends[e], ends[e][0] + e, ends[e][1] + e
            if e != d and all(
                a > ends[c][1] and p > ends[c][1] + c or b < ends[c][0] and q < ends[c][0] + c for c in chosen
            ):
                chosen.append(e)
        used.update(chosen)
        if len(chosen) > 1:
            yield [h for c in chosen for h in lines[c]]


def _judge(n_windows: int, min_share: float, hits: list[dict]) -> tuple | None:
    """Best (matched, share, n_slots, changed) of the hits of one item in one span; None if none counts."""
    best = None
    as_they_stand = [h for h in hits if not h["pairs"]]
    for copy in [as_they_stand, *_copies(hits)]:
        pairs = {(p["kind"], p["item"], p["doc"]) for h in copy for p in h["pairs"]}
        matched = len({j for h in copy for j in range(h["j"], h["last"] + 1)})
        if matched / n_windows >= min_share and _consistent(pairs):
            found = (matched, matched / n_windows, len(pairs), sum(a != b for _, a, b in pairs))
            best = max(best or found, found)
    return best


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = 0.4, min_literals: int = MIN_LITERALS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item, one row for each pair.

    ``doc_id, item_id, matched`` (windows of the item that were met), ``share`` (of its windows), ``n_slots``
    (placeholders met with their values) and ``changed`` (of these, values that differ from the item's: above 0
    the question was given other parameters). A pair counts if ``share`` is at least ``min_share``, of windows as they
    stand or of these and windows with placeholders that are consistent: one value of the item always stands for one
    value of the text, and no other value of the item has become equal to one that stays.

    * Items of fewer words than a window are one window of all their words; texts offer windows of these sizes too.
      Items of fewer than ``min_literals`` words that are no placeholders are met only by texts of the same words.
    * Null and empty texts hold nothing; null items are met by nothing. Empty tables give no rows.
    * Windows are added up over spans of four times the item's words that overlap by half, so that words put in or
      left out, anywhere, cost only the windows they are in.
    * Rows with equal ids are searched apart and count as one document; other columns are not read, whatever their names.
    * A passage found in a third of all documents makes one hash hot: its rows are a join without
      aggregation on that key, whose large partitions Spark splits. Groups are never larger than a span.
    """
    spark = docs.sparkSession
    items = materialize(_windows(
        benchmark.select(F.col(item_id).alias("key"), whole(item_text).alias("text")), None, window, min_literals
    ))
    bench = items.select(F.col("key").alias("item_id"), "n_words", "enough", F.inline("hits")).select(
        "item_id", "n_words", "enough", "size", F.col("pos").alias("j"), (F.col("pos") + F.greatest(F.col("span") - window, F.lit(0))).alias("last"),
        "gram", F.col("slots").alias("item_slots"),
    )
    # At most 2**FILTER_BITS numbers, whatever the size of the benchmark.
    buckets = bench.select(F.shiftrightunsigned("gram", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toArrow()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[buckets.column(0).to_numpy()] = True
    sizes = bench.where(F.col("enough") & (F.col("size") < window)).select(F.size("item_slots") > 0, "size").distinct().collect()
    short = tuple({k for shaped, k in sizes if shaped == kind} for kind in (False, True))
    key = F.struct(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    hits = _windows(
        docs.select(key.alias("key"), whole(text).alias("text")), np.packbits(bits), window, min_literals, short
    ).where(F.size("hits") > 0).select("key", F.col("n_words").alias("doc_words"), F.inline("hits")).drop("size")
    pairs = F.zip_with("slots", "item_slots", lambda a, b: F.struct(
        b["kind"].alias("kind"), b["value"].alias("item"), a["value"].alias("doc")
    ))
    part = F.floor(F.col("pos") / (2 * F.col("n_words")))
    met = hits.join(bench, "gram").where(F.size("slots") == F.size("item_slots")).where(
        F.col("enough") | (F.col("doc_words") == F.col("n_words")) | (F.col("n_words") >= window)
    ).select(
        "key", "item_id", "n_words", F.explode(F.array(part, part - 1)).alias("part"),
        F.struct("pos", "j", "last", pairs.alias("pairs")).alias("hit"),
    ).where("part >= 0")
    n_windows = F.greatest(F.col("n_words") - window + 1, F.lit(1))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["j"], h["last"])))))
    groups = met.groupBy("key", "item_id", "n_words", "part").agg(F.collect_set("hit").alias("hits")).where(
        covered >= min_share * n_windows
    ).select("key.doc_id", "item_id", n_windows.alias("n_windows"), "hits")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_windows").to_pylist()
            found = [_judge(n, min_share, h.as_py()) for n, h in zip(sizes, batch.column("hits"), strict=True)]
            kept = batch.filter(pa.array([f is not None for f in found], pa.bool_()))
            values = list(zip(*[f for f in found if f], strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), kept.column("item_id"), *map(pa.array, values, kinds)],
                ["doc_id", "item_id", "matched", "share", "n_slots", "changed"],
            )

    ids = [groups.schema["doc_id"], groups.schema["item_id"]]
    counts = T._parse_datatype_string("matched bigint, share double, n_slots int, changed int").fields
    return (
        groups.mapInArrow(judged, T.StructType([*ids, *counts])).groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("matched", "share", "n_slots", "changed")).alias("best"))
        .select("doc_id", "item_id", "best.*")
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id stay unless they do."""
    found = benchmark_matches(docs, benchmark, doc_id=doc_id, **options).select("doc_id").distinct()
    return docs.join(found, docs[doc_id].eqNullSafe(found["doc_id"]), "left_anti")
