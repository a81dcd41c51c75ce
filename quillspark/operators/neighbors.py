"""Exact nearest-neighbour join over a stored index of cells.

An index is cut into Voronoi cells around pivots, whose number grows with the root of its rows (the published
pivot-based kNN join). Pivots, rows with their cell, and a summary of each cell are stored; a batch of new rows is
assigned to the pivots there are and adds rows and summaries of its own, so nothing stored is read or cut again.

A query gets an upper bound on its k-th distance from the summaries, counting only rows it may have. It visits the
cells that the triangle inequality cannot exclude. Inside a cell the same test excludes rows: each row holds its
distances to the pivot of its cell and to ``REFERENCES`` fixed pivots, which bound its distance to the query from below.
Cells that most queries visit are taken together, so where nothing can be excluded (vectors of many dimensions without
structure) rows and queries travel once a block and not once a cell, and a block is compared in matrix products.
Cells and the queries visiting them are cut further into blocks of bounded size, so a hot cell is many tasks; each
block pair returns only its best k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.session import materialize, new_folder
from quillspark.sources.files import stored_or_empty

MAX_PIVOTS = 65_536  # reached at four billion index rows
BLOCK_ROWS = 65_536
LEAST_BLOCK = 1024  # blocks are not cut below this for the sake of more tasks
TASK_BLOCKS = 4  # blocks for each shuffle partition, where there is work for them
FEW = 0.1  # share of rows left by exclusion from which on a block is compared as a whole
PRODUCT = (256, 4096)  # queries and rows of one matrix product
STEP = 512  # rows compared with all pivots at once, fewer where the pivots are many
TILE = 1 << 22  # numbers in one array of distances: 32 MB
REFERENCES = 8
HEADS = 16  # nearest rows that a summary holds of each cell and batch
_PIVOTS = "number int, vector array<double>"
_PART = "run string, batch long"
_ROWS = "_iid long, _ivec array<float>, _cell int, _dist double, _refs array<double>, " + _PART
_CELLS = "_cell int, rows long, radius double, head array<struct<_dist: double, _iid: bigint>>, " + _PART


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squared, 0.0))


def _rows(df: DataFrame, row_id: str, vector: str, *more: str) -> DataFrame:
    return df.select(F.col(row_id).cast("long").alias("_iid"), F.col(vector).alias("_ivec"), *more).where("_ivec IS NOT NULL")


def _step(width: int) -> int:
    """Rows taken at once so that their distances to ``width`` points fill one tile."""
    return max(1, min(STEP, TILE // max(width, 1)))


def _not_its_own(near: np.ndarray, qids: np.ndarray, ids: np.ndarray) -> None:
    """Set the distances between rows and queries of one id to infinity; ``ids`` is sorted."""
    low, high = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")
    many = high - low
    if many.any():
        at = np.repeat(np.arange(len(qids)), many)
        near[at, np.repeat(low, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)] = np.inf


def _first_k(query: np.ndarray, value: np.ndarray, k: int, slack: np.ndarray | None = None, ids: np.ndarray | None = None):
    """Places of each query's ``k`` smallest values (ties by ``ids``), with ``slack`` also those that much above the last."""
    order = np.lexsort((value, query) if ids is None else (ids, value, query))
    q, v = query[order], value[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    sizes = np.diff(np.r_[starts, len(q)])
    place = np.arange(len(q)) - np.repeat(starts, sizes)
    keep = place < k
    if slack is not None:
        last = np.where(sizes >= k, v[np.minimum(starts + k - 1, len(q) - 1)], np.inf)
        keep |= v <= np.repeat(last, sizes) + slack[q]
    return order[keep]


def _closest(qids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, exclude_self: bool, earlier_only: bool):
    """``(query, row, squared distance)``: each query's ``k`` nearest rows, ties by id. ``ids`` is sorted.

    Matrix products in single precision give distances up to a known error; rows within it of the k-th are measured
    again in double precision, so the outcome is that of measuring all.
    """
    square = (rows * rows).sum(1)
    asked = (queries * queries).sum(1)
    reach = float(np.sqrt(max(asked.max(), square.max())))
    kind = np.float32 if reach < 1e15 else np.float64
    error = 4.0 * (rows.shape[1] + 4) * float(np.finfo(kind).eps) * (np.sqrt(asked) + np.sqrt(square.max())) ** 2
    left = np.column_stack([-2.0 * queries, np.ones(len(queries))]).astype(kind)
    right = np.ascontiguousarray(np.column_stack([rows, square]).astype(kind).T)
    found = []
    for q0 in range(0, len(queries), PRODUCT[0]):
        own = slice(q0, q0 + PRODUCT[0])
        slack, n = error[own], len(left[own])
        limit = bounds[own] ** 2 - asked[own] + slack
        q = r = np.zeros(0, dtype=np.int64)
        v = np.zeros(0)
        for r0 in range(0, len(rows), PRODUCT[1]):
            near = left[own] @ right[:, r0 : r0 + PRODUCT[1]]
            here = ids[r0 : r0 + PRODUCT[1]]
            if earlier_only:
                near[here[None, :] >= qids[own][:, None]] = np.inf
            elif exclude_self:
                _not_its_own(near, qids[own], here)
            hit = near <= limit[:, None].astype(kind)
            if np.count_nonzero(hit) > 8 * k * n and near.shape[1] > k:
                limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)
                hit = near <= limit[:, None].astype(kind)
            a, b = np.divmod(np.flatnonzero(hit), near.shape[1])
            real = near[a, b] < np.inf
            a, b = a[real], b[real]
            if len(a):
                q, r, v = np.r_[q, a], np.r_[r, b + r0], np.r_[v, near[a, b].astype(float)]
                kept = _first_k(q, v, k, 2 * slack)
                q, r, v = q[kept], r[kept], v[kept]
                full = np.bincount(q, minlength=n) >= k
                kth = np.full(n, np.inf)
                # rows are in the order of query and value: the k-th of each full query
                starts = np.searchsorted(q, np.arange(n))
                kth[full] = v[starts[full] + k - 1]
                limit = np.minimum(limit, kth + 2 * slack)
        exact = ((rows[r] - queries[own][q]) ** 2).sum(1)
        kept = _first_k(q, exact, k, ids=ids[r])
        found.append((q[kept] + q0, r[kept], exact[kept]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


@dataclass(frozen=True)
class CellIndex:
    """A stored index: folders ``pivots``, ``rows`` and ``cells`` below ``folder``, the latter two by run and batch."""

    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: str) -> DataFrame:
        return stored_or_empty(self.spark, f"{self.folder}/{name}", schema)

    def pivots(self) -> np.ndarray:
        """At most ``MAX_PIVOTS`` vectors."""
        rows = self._read("pivots", _PIVOTS).orderBy("number").select("vector").toPandas()
        return _matrix(rows["vector"]) if len(rows) else np.zeros((0, 0))

    def clear(self) -> None:
        """Forget all pivots, rows and cells."""
        for name, schema in (("pivots", _PIVOTS), ("rows", _ROWS), ("cells", _CELLS)):
            empty = self.spark.createDataFrame([], schema).write.mode("overwrite")
            (empty.partitionBy("run", "batch") if "run" in schema else empty).parquet(f"{self.folder}/{name}")

    def _choose_pivots(self, rows: DataFrame, count: int) -> np.ndarray:
        """A repeatable sample of index vectors, the root of their number; it steers pruning and never the result."""
        m = int(min(MAX_PIVOTS, max(1, np.sqrt(count))))
        sample = rows.orderBy(F.xxhash64("_iid"), "_iid").limit(m).select("_ivec").toPandas()
        chosen = list(enumerate(_matrix(sample["_ivec"]).tolist()))
        self.spark.createDataFrame(chosen, _PIVOTS).write.mode("overwrite").parquet(f"{self.folder}/pivots")
        return np.array([v for _, v in chosen])

    def add(self, df: DataFrame, row_id: str, vector: str = "embedding", run: str = "base", batch: int = 0) -> None:
        """Assign the rows of ``df`` to the stored pivots (chosen from them, if there are none yet) as one batch.

        Adding a batch again replaces it. ``df`` may bring columns ``run`` and ``batch`` of its own. Rows without a
        vector are left out.
        """
        many = {"run", "batch"} <= set(df.columns)
        placed = df if many else df.withColumns({"run": F.lit(run), "batch": F.lit(batch).cast("long")})
        rows = _rows(placed, row_id, vector, "run", "batch")
        pivots = self.pivots()
        if not len(pivots):
            count = rows.count()
            if not count:
                return
            pivots = self._choose_pivots(rows, count)

        def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = _step(len(pivots))
            for frame in batches:
                for start in range(0, len(frame), step):
                    own = frame.iloc[start : start + step]
                    d = _distances(_matrix(own["_ivec"]), pivots)
                    cell = d.argmin(1)
                    yield own.assign(_cell=cell.astype("int32"), _dist=d[np.arange(len(d)), cell], _refs=d[:, :REFERENCES].tolist())[
                        ["_iid", "_ivec", "_cell", "_dist", "_refs", "run", "batch"]]

        celled = rows.mapInPandas(to_cells, _ROWS)
        if many:
            celled = materialize(celled)
            self._write("rows", celled)
        else:
            self._write("rows", celled)
            celled = self._read("rows", _ROWS).where((F.col("run") == run) & (F.col("batch") == batch))
        nearest_first = Window.partitionBy("run", "batch", "_cell").orderBy("_dist", "_iid")
        heads = (
            celled.select("run", "batch", "_cell", "_dist", "_iid").withColumn("_r", F.row_number().over(nearest_first))
            .where(F.col("_r") <= HEADS).groupBy("run", "batch", "_cell")
            .agg(F.sort_array(F.collect_list(F.struct("_dist", "_iid"))).alias("head"))
        )
        summary = celled.groupBy("run", "batch", "_cell").agg(F.count(F.lit(1)).alias("rows"), F.max("_dist").alias("radius"))
        self._write("cells", summary.join(heads, ["run", "batch", "_cell"]))

    def _write(self, name: str, table: DataFrame) -> None:
        """Replace the batches that ``table`` holds."""
        writer = table.write.mode("overwrite").partitionBy("run", "batch").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{self.folder}/{name}")

    def merged(self, folder: str) -> CellIndex:
        """The same rows in another folder as one batch, around pivots chosen anew: after many batches outgrew the old ones."""
        other = CellIndex(self.spark, folder)
        other.add(self._read("rows", _ROWS).drop("run", "batch"), "_iid", "_ivec")
        return other

    def search(
        self, queries: DataFrame, k: int, query_id: str, vector: str = "embedding", exclude_self: bool = True,
        earlier_only: bool = False, admit: Column | None = None,
    ) -> DataFrame:
        """``_qid, _iid, _d`` (squared distance): the best ``k`` of each query and block, and ``_compared``.

        ``_compared`` is, once for each query and block, the number of rows whose distance was computed. ``admit`` is a
        condition on ``run`` and ``batch`` of the rows that count.
        """
        spark = self.spark
        every = F.lit(True) if admit is None else admit
        q = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(vector).alias("_qvec")).where("_qvec IS NOT NULL")
        summary = (
            self._read("cells", _CELLS).where(every).groupBy("_cell")
            .agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"), F.flatten(F.collect_list("head")).alias("head"))
            .withColumn("head", F.slice(F.array_sort("head"), 1, HEADS)).toPandas()
        )
        if not len(summary):
            return spark.createDataFrame([], "_qid long, _iid long, _d double, _compared long")
        pivots = self.pivots()
        cells = summary["_cell"].to_numpy()
        radius = summary["radius"].to_numpy(dtype=float)
        own_pivots, references = pivots[cells], pivots[:REFERENCES]
        head_cell = np.repeat(np.arange(len(cells)), [len(h) for h in summary["head"]])
        head_dist = np.array([r["_dist"] for h in summary["head"] for r in h], dtype=float)
        head_ids = np.array([r["_iid"] for h in summary["head"] for r in h], dtype=np.int64)
        largest = float(np.sqrt((pivots * pivots).sum(1)).max())

        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = _step(len(head_ids) + len(cells))
            for frame in batches:
                for start in range(0, len(frame), step):
                    own = frame.iloc[start : start + step]
                    x = _matrix(own["_qvec"])
                    reach = _distances(x, own_pivots)[:, head_cell] + head_dist[None, :]
                    ids = own["_qid"].to_numpy()[:, None]
                    # heads that the query may not have say nothing about its k-th distance
                    if exclude_self:
                        reach[head_ids[None, :] == ids] = np.inf
                    if earlier_only:
                        reach[head_ids[None, :] >= ids] = np.inf
                    bound = np.full(len(x), np.inf) if reach.shape[1] < k else np.partition(reach, k - 1, axis=1)[:, k - 1]
                    bound += 1e-6 * (1.0 + largest + np.sqrt((x * x).sum(1)))  # rounding of the distances
                    yield own.assign(_bound=bound, _qrefs=_distances(x, references).tolist())

        def visited(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
            """Queries, their distances to the pivots of all cells, and whether they visit them."""
            step = _step(len(cells))
            for start in range(0, len(frame), step):
                own = frame.iloc[start : start + step]
                d = _distances(_matrix(own["_qvec"]), own_pivots)
                yield own, d, d - radius[None, :] <= own["_bound"].to_numpy()[:, None]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asks, total = np.zeros(len(cells), dtype=np.int64), 0
            for frame in batches:
                for own, _, keep in visited(frame):
                    asks, total = asks + keep.sum(0), total + len(own)
            yield pd.DataFrame({"_cell": np.r_[cells, -1].astype("int32"), "asks": np.r_[asks, total]})

        number = F.monotonically_increasing_id()
        bounded = materialize(q.repartition(tasks).mapInPandas(bounds, "_qid long, _qvec array<float>, _bound double, _qrefs array<double>"))
        demand = bounded.mapInPandas(count, "_cell int, asks long").groupBy("_cell").agg(F.sum("asks").alias("asks"))
        asks = {r["_cell"]: r["asks"] for r in demand.collect()}  # one row a cell
        total = asks.get(-1, 0)

        # Cells that most queries visit share a group, up to the rows of a block; any other cell is one of its own.
        group, held, wanted, shared = {}, [], [], None
        for c, n in zip(cells.tolist(), summary["rows"].tolist()):
            popular = 2 * asks.get(c, 0) > total
            if not popular or shared is None or held[shared] + n > BLOCK_ROWS:
                held.append(0)
                wanted.append(total if popular else asks.get(c, 0))
                shared = len(held) - 1 if popular else shared
            group[c] = shared if popular else len(held) - 1
            held[group[c]] += n
        side = min(BLOCK_ROWS, max(LEAST_BLOCK, int(np.sqrt(sum(n * m for n, m in zip(held, wanted)) / (TASK_BLOCKS * tasks)))))
        # Rows are dealt to blocks by a hash of their number, so blocks of half the size on average stay below it.
        parts = lambda n: 1 if n <= side else -(-int(n) // max(1, side // 2))
        plan = [(c, g, parts(held[g]), parts(wanted[g])) for c, g in group.items()]
        blocks = F.broadcast(spark.createDataFrame(plan, "_cell int, _group int, _nx int, _nq int"))
        counts = F.broadcast(spark.createDataFrame(sorted({p[1:] for p in plan}), "_group int, _nx int, _nq int"))
        groups = np.array([group[c] for c in cells.tolist()])
        alone = np.bincount(groups, minlength=len(held))[groups] == 1

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A row for each query and group; a group of several cells has no one pivot, and no distance to it."""
            for frame in batches:
                for own, d, keep in visited(frame):
                    at, cell = np.nonzero(keep)
                    dist = np.where(alone[cell], d[at, cell], np.nan)
                    one = np.unique(np.column_stack([at, groups[cell]]), axis=0, return_index=True)[1]
                    for part in np.array_split(one, max(1, len(one) // (4 * STEP))):
                        yield own.iloc[at[part]].assign(_group=groups[cell[part]].astype("int32"), _qdist=dist[part])

        # Stored rows are dealt by their id, vector and a number: an id or vector repeated often spreads too.
        deal = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
        stored = self._read("rows", _ROWS).where(every).withColumn("_irow", number).join(blocks, "_cell").select(
            "_group", deal("_irow", "_nx").alias("_bx"), F.explode(F.expr("sequence(0, _nq - 1)")).alias("_bq"), "_iid", "_ivec", "_dist", "_refs",
        )
        visit = bounded.withColumn("_qrow", number).mapInPandas(
            visits, "_qid long, _qvec array<float>, _bound double, _qrefs array<double>, _qrow long, _group int, _qdist double")
        asked = visit.join(counts, "_group").select(
            "_group", F.explode(F.expr("sequence(0, _nx - 1)")).alias("_bx"), deal("_qrow", "_nq").alias("_bq"),
            "_qid", "_qvec", "_bound", "_qrefs", "_qdist",
        )

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[int, int, float, int]] = []
            if len(left) and len(right):
                right = right.iloc[np.argsort(right["_iid"].to_numpy(), kind="stable")]
                ids, vecs = right["_iid"].to_numpy(), _matrix(right["_ivec"])
                known = np.column_stack([right["_dist"].to_numpy(), _matrix(right["_refs"])])
                qids, qs, bounds = left["_qid"].to_numpy(), _matrix(left["_qvec"]), left["_bound"].to_numpy()
                asked_refs = np.column_stack([left["_qdist"].to_numpy(), _matrix(left["_qrefs"])])
                if np.isnan(asked_refs[0, 0]):
                    known, asked_refs = known[:, 1:], asked_refs[:, 1:]
                near_rows = lambda i: np.abs(known - asked_refs[i]).max(1) <= bounds[i]
                some = np.linspace(0, len(left) - 1, min(16, len(left))).astype(int)
                if np.mean([near_rows(i).mean() for i in some]) > FEW:
                    q, r, d = _closest(qids, qs, bounds, ids, vecs, k, exclude_self, earlier_only)
                    first = np.r_[True, q[1:] != q[:-1]][: len(q)]
                    return pd.DataFrame({"_qid": qids[q], "_iid": ids[r], "_d": d, "_compared": np.where(first, len(vecs), 0)})
                squares = (vecs * vecs).sum(1)
                for i, (qid, qv) in enumerate(zip(qids, qs)):
                    ok = near_rows(i)
                    if exclude_self:
                        ok &= ids != qid
                    if earlier_only:
                        ok &= ids < qid
                    at = np.flatnonzero(ok)
                    compared = len(at)
                    if len(at) > k:
                        near = squares[at] - 2.0 * (vecs[at] @ qv)
                        at = at[near <= np.partition(near, k - 1)[k - 1] + 1e-9 * (1.0 + float(qv @ qv) + squares[at].max())]
                    exact = ((vecs[at] - qv) ** 2).sum(1)
                    for j in np.lexsort((ids[at], exact))[:k]:
                        out.append((qid, ids[at[j]], exact[j], compared))
                        compared = 0
            return pd.DataFrame(out, columns=["_qid", "_iid", "_d", "_compared"])

        keys = ["_group", "_bx", "_bq"]
        return asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(best, "_qid long, _iid long, _d double, _compared long")

    def nearest(self, queries: DataFrame, k: int, query_id: str, vector: str = "embedding", metric: str = "l2sq", **options) -> DataFrame:
        """``(query_id, neighbor_id, distance, rank)`` of the ``k`` nearest stored rows per query, ties by id; see :func:`nearest`."""
        found = self.search(queries, k, query_id, vector, **options)
        closest = Window.partitionBy("_qid").orderBy("_d", "_iid")
        value = F.col("_d") if metric == "l2sq" else F.sqrt("_d")
        return (
            found.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= k)
            .select(F.col("_qid").alias(query_id), F.col("_iid").alias("neighbor_id"), value.alias("distance"), "rank")
        )


def nearest(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    query_id: str,
    index_id: str,
    vector: str = "embedding",
    metric: str = "l2sq",
    exclude_self: bool = True,
    earlier_only: bool = False,
) -> DataFrame:
    """``(query_id, neighbor_id, distance, rank)`` of the ``k`` nearest index rows per query, ties by id.

    ``earlier_only`` admits index rows with a smaller id only (incremental retrieval: a document sees
    those stored before it). ``metric`` is ``l2sq`` or ``l2``. Rows without a vector are nobody's neighbours,
    and have none. Ids may repeat: with ``exclude_self`` no row of the query's own id counts. The index is cut for
    this call; a :class:`CellIndex` keeps it.
    """
    spark = queries.sparkSession
    cells = CellIndex(spark, new_folder(spark))
    cells.add(index, index_id, vector)
    return cells.nearest(queries, k, query_id, vector, metric, exclude_self=exclude_self, earlier_only=earlier_only)


def first_distinct(matches: DataFrame, query_id: str, k: int) -> DataFrame:
    """Oversampled matches with repeated neighbour ids and the query itself dropped, cut back to ``k``."""
    once = matches.where(F.col("neighbor_id") != F.col(query_id)).groupBy(query_id, "neighbor_id").agg(
        F.min("rank").alias("_r"), F.min_by("distance", "rank").alias("distance")
    )
    again = F.row_number().over(Window.partitionBy(query_id).orderBy("_r"))
    return once.withColumn("rank", again).where(F.col("rank") <= k).drop("_r")


def with_score(matches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score ``1 / (1 + distance)`` and whether it reaches the confidence threshold."""
    score = 1.0 / (1.0 + F.col("distance"))
    return matches.withColumn("score", score).withColumn("is_confident", score >= threshold)


def best_matches(scored: DataFrame, query_id: str, require_confident: bool = False) -> DataFrame:
    """Scored matches plus a per-query flag for any confident one, evaluated after the filter."""
    kept = scored.where("is_confident") if require_confident else scored
    return kept.withColumn("has_confident_matches", F.bool_or("is_confident").over(Window.partitionBy(query_id)))


def empty_index(spark) -> DataFrame:
    """Index that stores and returns nothing (retrieval switched off)."""
    return spark.createDataFrame([], "doc_id long, embedding array<float>, metadata map<string,string>")
