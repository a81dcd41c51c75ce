"""Resharding by minimum-cost flow.

Old shards supply bytes, new shards have capacities; a byte that stays in the shard of its number costs nothing
and one that moves costs one. The cheapest flow says how many bytes go from where to where. Each old shard is a
line of blocks (rows in the order of a hash), and its flow cuts the line into stretches, one for each new
shard: whole blocks move together, and only blocks at a cut are split, between rows. The one row that lies
across a cut is placed last, in the shard that has most room, so that no shard differs from its capacity by
more than one row.

The solver sees sizes of shards only. Blocks are counted, cut and numbered by aggregation and windows over
blocks; their number grows with the bytes, so that a block stays near ``BLOCK_BYTES``, and what is known of them is
joined, not shipped. Texts are shuffled once, by block, and written straight into the folders of their new shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import named, unpacked, whole
from quillspark.session import checkpoint_root, materialize

BLOCK_BYTES = 64 << 20
ROW_BYTES = 8


def cheapest_flow(supply: Sequence[int], capacity: Sequence[int]) -> list[list[int]]:
    """Bytes from each old to each new shard that fill all capacities and move as few as possible.

    Successive cheapest paths through the residual graph: source, old shards, new shards, sink. The sums of
    supply and capacity must be equal.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    left: dict[int, dict[int, int]] = {v: {} for v in range(n + m + 2)}
    cost: dict[tuple[int, int], int] = {}

    def edge(a: int, b: int, room: int, price: int) -> None:
        left[a][b], left[b][a] = room, 0
        cost[a, b], cost[b, a] = price, -price

    for i, amount in enumerate(supply):
        edge(source, i, amount, 0)
        for j in range(m):
            edge(i, n + j, amount, int(i != j))
    for j, room in enumerate(capacity):
        edge(n + j, sink, room, 0)
    while True:
        price, before = {source: 0}, {}
        for _ in range(n + m + 1):  # cheapest paths by repeated relaxation
            changed = False
            for a in list(price):
                for b, room in left[a].items():
                    if room and price[a] + cost[a, b] < price.get(b, 1 << 60):
                        price[b], before[b], changed = price[a] + cost[a, b], a, True
            if not changed:
                break
        if sink not in price:
            break
        path, at = [], sink
        while at != source:
            path.append((before[at], at))
            at = before[at]
        amount = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= amount
            left[b][a] += amount
    return [[left[n + j][i] for j in range(m)] for i in range(n)]


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


def reshard(
    docs: DataFrame, old_shard: Column, n_old: int, n_new: int = 24, folder: str | None = None,
    capacities: Sequence[int] | None = None, n_blocks: int | None = None, affected_only: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write ``docs`` into ``n_new`` shards under ``folder`` and return them as read back, with ``shard`` and ``slot``.

    ``old_shard``: the shard from 0 to ``n_old`` - 1 in which a row is now. A row's size is its text's UTF-8
    bytes plus ``ROW_BYTES``. Capacities are even unless given (their sum must be that of the sizes); each shard
    ends within one row of its capacity. ``slot`` numbers the rows of a shard from 0 without gaps.
    ``affected_only`` writes and returns just the shards that gain or lose rows, for a layout whose other files stay.

    * Null text: no bytes. Rows without an old shard count as in shard 0. Ids may repeat or be null; equal rows
      are rows of their own. An empty table gives no rows.
    * Other columns are written as they are, whatever their names; columns named ``shard`` and ``slot`` are replaced.
    * An old shard may hold any share of all rows: it is a line of ``n_blocks`` blocks, cut like any other. Unless given,
      the number of blocks follows the bytes of the largest old shard, so a block stays near ``BLOCK_BYTES``.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    size = F.octet_length(whole(text)).cast("long") + ROW_BYTES
    rows = docs.select(
        F.struct(*named(own)).alias("carry"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old"),
        F.xxhash64(named([doc_id])[0], whole(text)).alias("h"), size.alias("size"),
    )
    sizes = materialize(rows.select("old", "h", "size"))
    supply = [0] * n_old
    for r in sizes.groupBy("old").agg(F.sum("size").alias("b")).collect():  # at most n_old rows
        supply[r["old"]] = r["b"]
    n_blocks = n_blocks or max(64, -(-max(supply) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.lit("block"), "h"), F.lit(n_blocks)).cast("int").alias("block")
    in_block = Window.partitionBy("old", "block").orderBy("h", "size")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    order = materialize(sizes.select("old", block, "h", "size").select(
        "old", "block", "size", F.row_number().over(in_block).alias("rank"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
    ))
    along = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = order.groupBy("old", "block").agg(F.sum("size").alias("bytes")).withColumn("at", F.coalesce(F.sum("bytes").over(along), F.lit(0)))

    capacities = list(capacities or even_capacities(sum(supply), n_new))
    flow = cheapest_flow(supply, capacities)
    lines = []
    for i, amounts in enumerate(flow):
        ends, targets, at = [], [], 0
        for j in sorted(range(n_new), key=lambda j: (j != i, j)):
            if amounts[j]:
                at += amounts[j]
                ends.append(at)
                targets.append(j)
        lines.append((i, ends, targets))
    # one row for each old shard
    cuts = F.broadcast(spark.createDataFrame(lines, "old int, ends array<bigint>, targets array<int>"))
    known = materialize(blocks.join(cuts, "old").select("old", "block", "at", "ends", "targets"))

    start, end = F.col("at") + F.col("start"), F.col("at") + F.col("start") + F.col("size")
    across = F.exists("ends", lambda e: (e > start) & (e < end))
    target = F.get("targets", F.size(F.filter("ends", lambda e: e <= start)))
    placed = materialize(order.join(known, ["old", "block"]).select("old", "block", "rank", "size", F.when(~across, target).alias("shard")))
    # at most one row lies across each cut, and there are fewer cuts than old and new shards together
    over = placed.where("shard is null").select("old", "block", "rank", "size").collect()
    room = dict(enumerate(capacities))
    for r in placed.where("shard is not null").groupBy("shard").agg(F.sum("size").alias("b")).collect():
        room[r["shard"]] -= r["b"]
    last = []
    for r in sorted(over, key=lambda r: (-r["size"], r["old"], r["block"], r["rank"])):
        j = max(room, key=lambda j: (room[j], -j))
        room[j] -= r["size"]
        last.append((r["old"], r["block"], r["rank"], j))
    chosen = F.broadcast(spark.createDataFrame(last, "old int, block int, rank int, last int"))

    settle = lambda df: df.join(chosen, ["old", "block", "rank"], "left").withColumn("shard", F.coalesce("shard", "last"))
    pieces = settle(placed).groupBy("shard", "old", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("slots", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    slots = pieces.groupBy("old", "block").agg(F.map_from_entries(F.collect_list(F.struct("shard", "slots"))).alias("slots"))
    # one row a block, stored: Spark sees its size and broadcasts it only if it is small
    per_block = materialize(known.join(slots, ["old", "block"]))

    moved = (
        rows.select("carry", "old", block, "h", "size")
        .repartition("old", "block")
        .withColumn("rank", F.row_number().over(in_block))
        .withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(per_block, ["old", "block"])
        .withColumn("shard", F.when(~across, target))
    )
    in_piece = Window.partitionBy("old", "block", "shard").orderBy("rank")
    done = settle(moved).withColumn("slot", F.element_at("slots", F.col("shard")) + F.row_number().over(in_piece) - 1)
    if affected_only:
        touched = {j for i, a in enumerate(flow) for j, b in enumerate(a) if b and i != j}
        touched |= {i for i, a in enumerate(flow) for j, b in enumerate(a) if b and i != j} | {r[3] for r in last}
        done = done.where(F.col("shard").isin(sorted(touched)))
    folder = folder or f"{checkpoint_root(spark)}/shards/{uuid.uuid4().hex}"
    out = done.select(*unpacked("carry", own), F.col("slot").cast("long").alias("slot"), "shard")
    out.write.partitionBy("shard").parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


def moved_bytes(flow: Sequence[Sequence[int]]) -> int:
    """Bytes of a flow that leave the shard of their number."""
    return sum(b for i, amounts in enumerate(flow) for j, b in enumerate(amounts) if i != j)
