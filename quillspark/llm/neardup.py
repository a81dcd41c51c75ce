"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates, links on full sets.

1. A sketch of each text: the number and a digest of its distinct word shingles, and one key for each band. One
   hash of each shingle serves all bins (its high bits choose the bin, the least hash in a bin is the bin's
   value); an empty bin takes the value of the first filled bin in a fixed random order of its own, which is
   the same for all texts (optimal densification).
2. Texts with equal sets are one class; only class representatives go on.
3. In each bucket of a band every member is a candidate of one member, the star's center: a bucket of n gives
   n - 1 candidates. They are confirmed on the full sets, read again from the texts.
4. Stars alone could miss links between two members that are both unlike their center. Where the rest of a
   bucket still falls into several components, all members outside the largest are compared with all
   others, in blocks: a task holds the sets of one block and streams the others past, and reports only
   links that join components. No pairs are ever made as rows.

With ``BANDS`` bands of ``ROWS`` bins a pair of similarity 0.8 shares no bucket once in 300,000 cases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, key128, named, unpacked, whole
from quillspark.llm.words import Words, byte_class, grams, mix
from quillspark.operators.components import connected
from quillspark.session import materialize

BANDS, ROWS = 24, 4
#: Shingles of the sets that a task holds at once, and of those that stream past them.
HELD, STREAMED = 200_000, 2_000_000
WORD_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text's words; all its words as one if they are fewer than ``size``."""
    return np.unique(grams(hashes, size))


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set, as two signed numbers."""
    halves = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype="<i8")
    return int(halves[0]), int(halves[1])


class Bands:
    """Band keys of sets by one-permutation hashing with optimal densification."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        random = np.random.default_rng(seed)
        self.order = np.array([random.permutation(self.bins) for _ in range(self.bins)])
        self.factors = random.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of each bin. Bins are ranges of the hash, so in a sorted set each starts with its least."""
        bins = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        starts = np.searchsorted(bins, np.arange(self.bins, dtype=np.uint64))
        filled = np.zeros(self.bins, dtype=bool)
        filled[bins.astype(np.int64)] = True
        source = np.arange(self.bins)
        empty = np.flatnonzero(~filled)
        if len(empty):
            tried = self.order[empty]
            source[empty] = tried[np.arange(len(empty)), filled[tried].argmax(axis=1)]
        return shingles[starts[source]]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        by_band = self.values(shingles).reshape(self.bands, self.rows)
        return mix((by_band * self.factors).sum(axis=1, dtype=np.uint64) + self.number).view(np.int64)


def sketches(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text", text_key: bool = False) -> DataFrame:
    """``doc_id, n_shingles, h1, h2`` (digest of the set) and ``bands`` (keys, none for an empty set) of every row.

    With ``text_key`` also ``t1, t2``, 128 bits of the text itself.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    is_word = WORD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands = Words(is_word), Bands()
        for batch in batches:
            counts, first, second, keys = [], [], [], []
            for _, _, _, _, hashes in words.each(batch.column(1).to_pylist()):
                shingles = shingle_set(hashes, shingle)
                h1, h2 = set_digest(shingles)
                counts.append(len(shingles))
                first.append(h1)
                second.append(h2)
                keys.append(bands.keys(shingles) if len(shingles) else np.zeros(0, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            longs = [pa.array(c, pa.int64()) for c in (counts, first, second)]
            columns = [batch.column(0), *longs, lists, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "bands", "t1", "t2"][: len(columns)])

    keys = [k.alias(f"t{n}") for n, k in enumerate(key128(whole(text)), 1)] if text_key else []
    return docs.select(named([doc_id])[0].alias("doc_id"), whole(text).alias("text"), *keys).mapInArrow(
        run, f"doc_id {id_type}, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>" + ", t1 bigint, t2 bigint" * text_key
    )


def confirmed_links(work: DataFrame, docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links ``a, b`` between components, confirmed on full sets.

    ``work`` has rows ``block, role, node, comp, first_id, h1, h2``: in each block the sets of role 0 are held
    and those of role 1 stream past. Texts are found by id and told apart by the digest of their sets.
    """
    bounded_batches(docs.sparkSession)
    is_word = WORD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(is_word)
        block, held, index, parent = None, [], None, {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for batch in batches:
            links: list[tuple[int, int]] = []
            columns = {n: batch.column(n).to_pylist() for n in ("block", "role", "node", "comp", "h1", "h2", "text")}
            for i, _, _, _, hashes in words.each(columns["text"]):
                shingles = shingle_set(hashes, shingle)
                if set_digest(shingles) != (columns["h1"][i], columns["h2"][i]):
                    continue  # another text of the same id
                if columns["block"][i] != block:
                    block, held, index, parent = columns["block"][i], [], None, {}
                node, comp = columns["node"][i], columns["comp"][i]
                if columns["role"][i] == 0:
                    held.append((node, comp, shingles))
                    continue
                if not held:
                    continue
                if index is None:
                    every = np.concatenate([h[2] for h in held])
                    order = np.argsort(every, kind="stable")
                    owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])[order]
                    index = every[order], owner, np.array([len(h[2]) for h in held])
                every, owner, sizes = index
                low, high = np.searchsorted(every, shingles), np.searchsorted(every, shingles, side="right")
                counts = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                common = np.bincount(owner[at], minlength=len(held))
                for k in np.flatnonzero(100 * common >= percent * (sizes + len(shingles) - common)).tolist():
                    x, y = root(comp), root(held[k][1])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((comp, held[k][1]))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    texts = docs.select(F.col(doc_id).alias("first_id"), whole(text).alias("text")).alias("d")
    w = work.alias("w")
    return (
        w.join(texts, F.col("w.first_id").eqNullSafe(F.col("d.first_id")))
        .select("block", "role", "node", "comp", "h1", "h2", "text")
        .repartition("block").sortWithinPartitions("block", "role")
        .mapInArrow(run, "a bigint, b bigint").distinct()
    )


def _blocks(held: DataFrame, streamed: DataFrame, group: str) -> DataFrame:
    """Rows of blocks for groups of ``held`` and ``streamed`` sets (``group, node, comp, n_shingles, first_id, h1, h2``).

    A group gets as many blocks as its held sets fill, times as many shares as its streamed sets fill; each
    streamed set goes to all blocks of one share, each held set to all shares of one block.
    """
    keep = ["node", "comp", "first_id", "h1", "h2"]
    n_held = held.groupBy(group).agg(F.ceil(F.sum("n_shingles") / HELD).cast("int").alias("n_blocks"))
    n_streamed = streamed.groupBy(group).agg(F.ceil(F.sum("n_shingles") / STREAMED).cast("int").alias("n_shares"))
    shape = n_held.join(n_streamed, group)
    pick = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = F.xxhash64(group, "_b", "_s").alias("block")
    parts = []
    for role, rows, own, other in ((0, held, "n_blocks", "n_shares"), (1, streamed, "n_shares", "n_blocks")):
        mine, others = ("_b", "_s") if role == 0 else ("_s", "_b")
        placed = rows.join(shape, group).withColumn(mine, pick(own)).withColumn(others, upto(other))
        parts.append(placed.select(block, F.lit(role).alias("role"), *keep))
    return parts[0].unionByName(parts[1])


def _labelled(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str, text_key: bool = False) -> DataFrame:
    """Every row as ``doc_id, n_shingles, final, component_id``, and with ``text_key`` a 128-bit key of its text as ``t1, t2``.

    ``final`` names the component (null without words), ``component_id`` is its smallest id.
    """
    sketch = materialize(sketches(docs, shingle, doc_id, text, text_key).withColumn("row", F.monotonically_increasing_id()))
    filled = sketch.where("n_shingles > 0")
    classes = materialize(
        filled.groupBy("h1", "h2").agg(
            F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n_shingles")
        )
    )
    reps = filled.select(F.col("row").alias("node"), "bands").join(classes.select("node"), "node")
    keyed = materialize(reps.select("node", F.explode("bands").alias("key")))
    stars = keyed.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keyed.join(stars, "key").where("node <> center").select("key", "node", "center", "n"))

    facts = classes.select("node", "first_id", "h1", "h2", "n_shingles")
    spokes = members.select("center", "node").distinct().join(facts, "node").withColumn("comp", F.col("node"))
    hubs = (
        members.select("center").distinct()
        .join(facts.withColumnRenamed("node", "center"), "center")
        .withColumn("node", F.col("center")).withColumn("comp", F.col("center"))
    )
    first = confirmed_links(_blocks(hubs, spokes, "center"), docs, shingle, percent, doc_id, text)
    labels = connected(first)

    known = labels.select("node", F.col("label").alias("comp"))
    rest = members.where("n > 2").join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # the largest component of each bucket; buckets of one component are done, equal ones are taken once
    by_comp = rest.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    )
    open_keys = by_comp.groupBy("key").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("size", "comp"))["comp"].alias("main"),
        F.sum("mark").alias("mark"), F.sum("size").alias("size"),
    ).where("comps > 1").groupBy("mark", "size").agg(F.min(F.struct("key", "main")).alias("k")).select("k.*")
    todo = materialize(rest.select("key", "node", "comp").join(open_keys, "key").join(facts, "node"))
    second = confirmed_links(_blocks(todo.where("comp <> main"), todo, "key"), docs, shingle, percent, doc_id, text)
    joined = connected(second).select(F.col("node").alias("comp"), F.col("label").alias("final"))

    placed = (
        classes.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        .join(joined, "comp", "left").withColumn("final", F.coalesce("final", "comp"))
    )
    smallest = placed.groupBy("final").agg(F.min("first_id").alias("component_id"))
    ids = placed.join(smallest, "final").select("h1", "h2", "final", "component_id")
    return sketch.drop("row", "bands").join(ids, ["h1", "h2"], "left").drop("h1", "h2")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct
    shingles of ``shingle`` words, or all its words as one if they are fewer. Documents are linked if
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id that links lead to, and
    ``kept`` says whether it is the row's own.

    * Null or empty text, or without words: no shingles, linked with nothing, kept.
    * Equal texts are one class, however many rows they have; the class is counted before anything is
      shuffled whole. Equal rows (same id and text) are all kept or all not.
    * A null id is never the smallest unless all ids of the component are null. Other columns are not read.
    * Very long texts: sets are handled one at a time, and held by their number of shingles.
    """
    rows = _labelled(docs, shingle, percent, doc_id, text)
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates: that of the smallest id.

    Rows are judged, not ids: rows of one id whose texts are unlike all stay, and rows without an id stay only if no row of
    their group has one, the one with the smallest key of its text. Of rows that are equal in id and text one stays. Rows
    without words are linked with nothing and all stay. Columns of any name may stand in ``docs``.
    """
    rows = _labelled(docs, shingle, percent, doc_id, text, text_key=True).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2"))
    chosen = materialize(rows.groupBy("final").agg(first.alias("m")).select(F.col("m.doc_id").alias("_id"), "m.t1", "m.t2"))
    t1, t2 = key128(whole(text))
    worded = whole(text).rlike(r"[^\x20\x09-\x0D]")
    own = docs.select(F.struct(*named(docs.columns)).alias("row"), named([doc_id])[0].alias("id"), t1.alias("u1"), t2.alias("u2"), worded.alias("worded"))
    met = own.join(chosen.withColumn("met", F.lit(True)), F.col("id").eqNullSafe(F.col("_id")) & (F.col("u1") == F.col("t1")) & (F.col("u2") == F.col("t2")), "left")
    # equal rows are one group, combined before the shuffle; a row without words is a group of its own
    alone = F.when(F.col("worded"), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    kept = met.where("met or not worded").groupBy("id", "u1", "u2", alone.alias("alone")).agg(F.first("row").alias("row"))
    return kept.select(*unpacked("row", docs.columns))
