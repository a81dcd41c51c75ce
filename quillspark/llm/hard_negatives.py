"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

1. Vectors become whole numbers and are ordered along a Hilbert curve. Each stretch of ``BLOCK_ROWS`` is one row
   of a Parquet table, with the least and greatest value of every dimension (its zone) in columns of their own;
   ``GROUP_BLOCKS`` neighbouring blocks are a group. Ties on the curve are split by id, so equal vectors of any
   number fill blocks like others.
2. An anchor's own block gives a first floor under its positives.
3. Interval arithmetic over a zone bounds every score that the block can give. Zones stream past shares of anchors
   (``SHARE`` at most), and say which blocks each anchor's window must read: for positives all scores from the
   floor up, for negatives 0.8 of a positive's score up to that score.
4. Each group of blocks is held by one task and the requests stream past. It keeps the best few rows of
   each window, so at most ``count`` rows a window and group are shuffled.

Sums are exact: products are taken in float64 where no sum can reach 2**53, else in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches
from quillspark.session import materialize

BLOCK_ROWS, GROUP_BLOCKS = 1024, 16
SHARE, REQUEST = 8192, 512
CURVE_BITS = 4
FLOOR = -(1 << 62)


def _matrix(data: list[bytes], lengths: list[int]) -> np.ndarray:
    """Rows of 64-bit numbers; shorter vectors end in zeros."""
    width = max(lengths, default=0)
    out = np.zeros((len(data), width), dtype=np.int64)
    for i, raw in enumerate(data):
        out[i, : lengths[i]] = np.frombuffer(raw, dtype="<i8")
    return out


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of whole numbers."""
    width = max(a.shape[1], b.shape[1])
    a, b = widen(a, width), widen(b, width)
    largest = [int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in (a, b)]
    bound = largest[0] * largest[1] * max(width, 1)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    raise OverflowError("a score can pass 62 bits")


def score_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor with any vector between ``low`` and ``high`` of each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def hilbert_keys(x: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Positions on a Hilbert curve through cells of ``2 ** bits`` steps a dimension, as sortable bytes.

    Values are pressed into the steps by ``v / (|v| + 32)``, so no pass over the data has to find their range.
    """
    n, width = x.shape
    if not width:
        return [b""] * n
    v = x.astype(np.float64)
    cell = ((0.5 + 0.5 * v / (np.abs(v) + 32.0)) * (1 << bits)).astype(np.int64).clip(0, (1 << bits) - 1)
    cells = [cell[:, d].copy() for d in range(width)]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        for d in range(width):
            turn = (cells[d] & q) != 0
            swap = np.where(turn, 0, (cells[0] ^ cells[d]) & (q - 1))
            cells[0] ^= np.where(turn, q - 1, swap)
            if d:
                cells[d] ^= swap
        q >>= 1
    for d in range(1, width):  # Gray code
        cells[d] ^= cells[d - 1]
    t = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(cells[-1] & q, q - 1, 0)
        q >>= 1
    planes = np.array([((c ^ t) >> b) & 1 for b in range(bits - 1, -1, -1) for c in cells], dtype=np.uint8).T
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def candidates(rows: DataFrame, scale: int, vec_id: Column, embedding: Column, label: Column) -> DataFrame:
    """``vec_id, label, vec`` (64-bit numbers as bytes), ``curve`` of the rows that take part."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            whole = np.floor(scale * flat)
            if np.abs(whole).max(initial=0) >= 1 << 62:
                raise OverflowError("a component can pass 62 bits")
            numbers = whole.astype("<i8")
            ends = np.cumsum(sizes)
            vecs = [numbers[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            keys: list[bytes] = [b""] * len(sizes)
            for width in np.unique(sizes):  # one matrix for each length
                at = np.flatnonzero(sizes == width)
                for i, key in zip(at.tolist(), hilbert_keys(_matrix([vecs[i] for i in at], [int(width)] * len(at))), strict=True):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "vec", "curve"]
            )

    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    taken = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), embedding.cast("array<double>").alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & finite
    )
    return taken.mapInArrow(run, "vec_id bigint, label bigint, vec binary, curve binary")


BLOCKS = (
    "grp bigint, no int, n int, dim int, ids array<bigint>, labels array<bigint>, vectors binary, "
    "low binary, high binary, label_bits bigint, only_label bigint"
)


def curve_blocks(rows: DataFrame, n_rows: int) -> DataFrame:
    """The stored blocks of :func:`candidates`, in the order of the curve."""
    parts = max(1, -(-n_rows // (BLOCK_ROWS * GROUP_BLOCKS)))

    def pack(grp: int, no: int, held: list) -> dict:
        x = _matrix([r[2] for r in held], [len(r[2]) // 8 for r in held])
        labels = [r[1] for r in held]
        bits = 0
        for v in set(labels):
            bits |= 1 << (v % 63)
        return {
            "grp": grp, "no": no, "n": len(held), "dim": x.shape[1], "ids": [r[0] for r in held], "labels": labels,
            "vectors": x.astype("<i8").tobytes(), "low": x.min(axis=0).astype("<i8").tobytes(), "high": x.max(axis=0).astype("<i8").tobytes(),
            "label_bits": bits, "only_label": labels[0] if len(set(labels)) == 1 else None,
        }

    schema = pa.schema([
        ("grp", pa.int64()), ("no", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())),
        ("vectors", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("label_bits", pa.int64()), ("only_label", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        count = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vec")), strict=True):
                held.append(row)
                if len(held) == BLOCK_ROWS:
                    yield pa.RecordBatch.from_pylist([pack((part << 32) + count // GROUP_BLOCKS, count % GROUP_BLOCKS, held)], schema)
                    held, count = [], count + 1
        if held:
            yield pa.RecordBatch.from_pylist([pack((part << 32) + count // GROUP_BLOCKS, count % GROUP_BLOCKS, held)], schema)

    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "curve", "vec_id", "tie")
    ordered = spread.sortWithinPartitions("curve", "vec_id", "tie").withColumn("part", F.spark_partition_id().cast("long"))
    return materialize(ordered.mapInArrow(run, BLOCKS))


def _best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Of the places ``at`` the first ``count`` by score (highest first), then id."""
    if len(at) > count:
        own = scores[at]
        at = at[own >= np.partition(own, len(own) - count)[len(own) - count]]
    return at[np.lexsort((ids[at], -scores[at]))[:count]]


def anchors_of(blocks: DataFrame, every: int, count: int) -> DataFrame:
    """``akey, anchor_id, label, dim, vec, windows`` of the anchors, with a floor under their positives from their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for b in batch.to_pylist():
                ids, labels = np.array(b["ids"], dtype=np.int64), np.array(b["labels"], dtype=np.int64)
                x = np.frombuffer(b["vectors"], dtype="<i8").reshape(b["n"], b["dim"])
                places = np.flatnonzero(ids % every == 0)
                for at in np.array_split(places, max(1, len(places) // 128)):
                    for p, scores in zip(at.tolist(), product(x[at], x) if len(at) else (), strict=True):
                        same = labels == labels[p]
                        same[p] = False
                        own = np.sort(scores[same])
                        floor = int(own[-count]) if len(own) >= count else FLOOR
                        key = ((b["grp"] * GROUP_BLOCKS + b["no"]) * BLOCK_ROWS) + p
                        out.append((key, int(ids[p]), int(labels[p]), b["dim"], x[p].astype("<i8").tobytes(), [floor]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["akey", "anchor_id", "label", "dim", "vec", "windows"])

    return blocks.select("grp", "no", "n", "dim", "ids", "labels", "vectors").mapInArrow(
        run, "akey bigint, anchor_id bigint, label bigint, dim int, vec binary, windows array<bigint>"
    )


REQUESTS = "grp bigint, akeys array<bigint>, labels array<bigint>, dim int, vectors binary, masks array<int>, windows array<array<bigint>>"


def requests(anchors: DataFrame, blocks: DataFrame, same_label: bool, share_of: int) -> DataFrame:
    """Which blocks of each group each anchor must read, as packed rows of ``REQUESTS``.

    ``windows`` of an anchor: with ``same_label`` the floor of its positives, else the scores of its positives.
    """
    shares = max(1, -(-share_of // SHARE))
    none = lambda t: F.lit(None).cast(t)
    left = anchors.select(
        F.pmod(F.xxhash64("akey"), F.lit(shares)).cast("int").alias("share"), F.lit(0).alias("role"), F.col("akey").alias("grp"), F.lit(0).alias("no"),
        "dim", "vec", none("binary").alias("high"), F.col("label").alias("bits"), none("bigint").alias("only_label"), "windows",
    )
    zones = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(1).alias("role"), "grp", "no", "dim", F.col("low").alias("vec"), "high",
        F.col("label_bits").alias("bits"), "only_label", none("array<bigint>").alias("windows"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, x, keys, labels = None, [], None, None, None
        schema = pa.schema([
            ("grp", pa.int64()), ("akeys", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("dim", pa.int32()), ("vectors", pa.binary()),
            ("masks", pa.list_(pa.int32())), ("windows", pa.list_(pa.list_(pa.int64()))),
        ])
        for batch in batches:
            zone: list[dict] = []
            for r in [*batch.to_pylist(), None]:
                if r and r["share"] == share and r["role"] == 1 and held:
                    zone.append(r)
                    continue
                if zone:
                    if x is None:
                        x = _matrix([h["vec"] for h in held], [h["dim"] for h in held])
                        keys = np.array([h["grp"] for h in held], dtype=np.int64)
                        labels = np.array([h["bits"] for h in held], dtype=np.int64)
                    for packed in chosen(x, keys, labels, [h["windows"] for h in held], zone):
                        yield pa.RecordBatch.from_pylist([packed], schema)
                    zone = []
                if r and r["share"] != share:
                    share, held, x = r["share"], [], None
                if r and r["role"] == 0:
                    held.append(r)

    def chosen(x, keys, labels, windows, zone) -> Iterator[dict]:
        low, high = (_matrix([z[c] for z in zone], [z["dim"] for z in zone]) for c in ("vec", "high"))
        # a shorter vector ends in zeros, which its anchor's further components meet
        least, most = score_bounds(x, low, high)
        if same_label:
            bits = np.array([z["bits"] for z in zone], dtype=np.int64)
            need = (most >= np.array([w[0] for w in windows])[:, None]) & ((bits[None, :] >> (labels % 63)[:, None]) & 1 == 1)
        else:
            need = np.zeros(most.shape, dtype=bool)
            for k in range(max((len(w) for w in windows), default=0)):
                p = np.array([w[k] if k < len(w) else -1 for w in windows], dtype=np.int64)
                need |= (p >= 0)[:, None] & (most >= (p - p // 5)[:, None]) & (least <= p[:, None])
            only = [z["only_label"] for z in zone]
            need &= np.array([[o is None or o != v for o in only] for v in labels.tolist()]).reshape(need.shape)
        grp = np.array([z["grp"] for z in zone], dtype=np.int64)
        bit = np.array([1 << z["no"] for z in zone], dtype=np.int64)
        for g in np.unique(grp):
            masks = (need[:, grp == g] * bit[grp == g]).sum(axis=1)
            wanted = np.flatnonzero(masks)
            for at in range(0, len(wanted), REQUEST):
                part = wanted[at : at + REQUEST]
                yield {
                    "grp": int(g), "akeys": keys[part].tolist(), "labels": labels[part].tolist(), "dim": x.shape[1], "vectors": x[part].astype("<i8").tobytes(),
                    "masks": masks[part].tolist(), "windows": [windows[i] for i in part.tolist()],
                }

    together = left.unionByName(zones).repartition(shares, "share").sortWithinPartitions("share", "role", "grp", "no")
    return materialize(together.mapInArrow(run, REQUESTS))


def read_blocks(asked: DataFrame, blocks: DataFrame, same_label: bool, count: int) -> DataFrame:
    """``akey, window, vec_id, score``: of each group and window the first ``count`` rows, over the asked blocks only."""
    wanted = asked.select("grp", F.explode("masks").alias("m")).groupBy("grp").agg(F.bit_or("m").alias("m"))
    needed = blocks.join(wanted, "grp").where(F.expr("shiftright(m, no) & 1 = 1"))
    none = lambda t: F.lit(None).cast(t)
    held = needed.select(
        "grp", F.lit(0).alias("role"), "no", "dim", "ids", "labels", "vectors", none("array<int>").alias("masks"), none("array<array<bigint>>").alias("windows")
    )
    streamed = asked.select("grp", F.lit(1).alias("role"), F.lit(0).alias("no"), "dim", F.col("akeys").alias("ids"), "labels", "vectors", "masks", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, ready = None, [], None
        names, types = ["akey", "window", "vec_id", "score"], (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            for r in batch.to_pylist():
                if r["grp"] != grp:
                    grp, held, ready = r["grp"], [], None
                if r["role"] == 0:
                    held.append(r)
                    continue
                if ready is None:
                    width = max(h["dim"] for h in held)
                    x = np.concatenate([widen(np.frombuffer(h["vectors"], dtype="<i8").reshape(-1, h["dim"]), width) for h in held])
                    numbers = np.concatenate([np.full(len(h["ids"]), h["no"]) for h in held])
                    ids, labels = (np.concatenate([np.array(h[c], dtype=np.int64) for h in held]) for c in ("ids", "labels"))
                    place = (grp * GROUP_BLOCKS + numbers) * BLOCK_ROWS + np.concatenate([np.arange(len(h["ids"])) for h in held])
                    ready = x, numbers, ids, labels, place
                found = list(searched(r, *ready))
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(columns, types, strict=True)], names)

    def searched(r, x, numbers, ids, labels, place) -> Iterator[tuple]:
        anchors = np.frombuffer(r["vectors"], dtype="<i8").reshape(-1, r["dim"])
        for at in range(0, len(anchors), 64):
            for i, scores in enumerate(product(anchors[at : at + 64], x), at):
                allowed = (r["masks"][i] >> numbers) & 1 == 1
                if same_label:
                    allowed &= (labels == r["labels"][i]) & (place != r["ids"][i]) & (scores >= r["windows"][i][0])
                    picks = [(0, _best(scores, ids, np.flatnonzero(allowed), count))]
                else:
                    allowed &= labels != r["labels"][i]
                    picks = [
                        (k, _best(scores, ids, np.flatnonzero(allowed & (scores >= p - p // 5) & (scores <= p)), count))
                        for k, p in enumerate(r["windows"][i]) if p >= 0
                    ]
                for k, best in picks:
                    if len(best):
                        yield np.full(len(best), r["ids"][i]), np.full(len(best), k), ids[best], scores[best]

    both = held.unionByName(streamed).repartition("grp").sortWithinPartitions("grp", "role", "no")
    return both.mapInArrow(run, "akey bigint, window int, vec_id bigint, score bigint")


def first_rows(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each anchor and window, with their ``rank`` from 1."""
    order = Window.partitionBy("akey", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    rows: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, scale: int = 256, relabel_every: int = 7,
    n_labels: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``, a score is the inner product with the anchor; higher scores come first, ties by
    smaller id. Anchors are the rows whose id is divisible by ``every``; their positives the first other rows of their
    label; the negatives of a positive the first rows of other labels with 0.8 to 1 times its score. Where an id is
    divisible by ``relabel_every`` its label is first moved on by one, modulo ``n_labels``.

    * Rows take no part that have a null id, label or vector, or a null or non-finite component.
    * Equal rows are rows of their own: each is an anchor, and an other row to its copies. Equal vectors of any number
      fill blocks like others. Vectors of different lengths meet as if the shorter ended in zeros.
    * An empty table, or one without anchors, gives no rows. Other columns are not read.
    * Scores that could pass 62 bits raise an error.
    """
    moved = F.when(F.col(vec_id) % relabel_every == 0, (F.col(label).cast("long") + 1) % n_labels).otherwise(F.col(label).cast("long"))
    points = candidates(rows, scale, F.col(vec_id), F.col(embedding), moved)
    blocks = curve_blocks(points, rows.count())
    anchors = materialize(anchors_of(blocks, every, n_positives))
    n_anchors = anchors.count()
    asked = requests(anchors, blocks, True, n_anchors)
    positives = materialize(first_rows(read_blocks(asked, blocks, True, n_positives), n_positives))
    # at most n_positives rows an anchor
    windows = positives.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("rank", "score")))["score"].alias("windows"))
    asked = requests(anchors.drop("windows").join(windows, "akey"), blocks, False, n_anchors)
    negatives = first_rows(read_blocks(asked, blocks, False, n_negatives), n_negatives)
    pairs = positives.select("akey", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        negatives.join(pairs, ["akey", "window"]).join(anchors.select("akey", "anchor_id"), "akey")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
