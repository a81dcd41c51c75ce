import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import neighbors


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    # A third of the rows are copies of one vector; the rest form clusters.
    centre = rng.normal(size=(6, 8))
    rows = []
    for i in range(240):
        v = centre[0] if i % 3 == 0 else centre[i % 6] + rng.normal(scale=0.2, size=8)
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


def _brute(rows, k, earlier=False):
    m = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for i in range(len(rows)):
        d = ((m - m[i]) ** 2).sum(1)
        ok = [(round(d[j], 9), j) for j in range(len(rows)) if (j < i if earlier else j != i)]
        out[i] = [j for _, j in sorted(ok)[:k]]
    return out


@pytest.mark.parametrize("earlier", [False, True])
def test_matches_brute_force(spark, vectors, monkeypatch, earlier):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 32)
    df = spark.createDataFrame(vectors, "id long, embedding array<float>")
    got: dict = {i: [] for i, _ in vectors}
    rows = neighbors.nearest(df, df, 5, "id", "id", earlier_only=earlier).orderBy("id", "rank").collect()
    for r in rows:
        got[r["id"]].append(r["neighbor_id"])
    assert got == _brute(vectors, 5, earlier)


def test_scores_and_flags(spark):
    df = spark.createDataFrame([(1, 2, 0.0, 1), (1, 3, 1.0, 2), (4, 5, 3.0, 1)],
                               "id long, neighbor_id long, distance double, rank int")
    scored = neighbors.with_score(df, 0.7)
    got = {r["neighbor_id"]: (r["score"], r["is_confident"]) for r in scored.collect()}
    assert got == {2: (1.0, True), 3: (0.5, False), 5: (0.25, False)}
    flags = {r["id"]: r["has_confident_matches"] for r in neighbors.best_matches(scored, "id").collect()}
    assert flags == {1: True, 4: False}
    assert neighbors.best_matches(scored, "id", require_confident=True).count() == 1


def test_oversampled_ids_are_kept_once(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 0.1, 2), (1, 2, 0.1, 3), (1, 3, 0.2, 4)],
                               "id long, neighbor_id long, distance double, rank int")
    got = [(r["neighbor_id"], r["rank"]) for r in neighbors.first_distinct(df, "id", 2).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]


def test_repeated_ids_and_missing_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(0, [0.0, float(i) / 1000]) for i in range(8)] + [(i, rng.normal(size=2).tolist()) for i in range(1, 101)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.where("id in (0, 7, 200)").dropDuplicates(["id"])
    got = {}
    for r in neighbors.nearest(asked, df, 5, "id", "id").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor_id"]))
    assert {k: len(v) for k, v in got.items()} == {0: 5, 7: 5}
    query = next(r["embedding"] for r in asked.collect() if r["id"] == 0)
    far = sorted((float(((np.float32(v) - np.float32(query)) ** 2).sum()), i) for i, v in rows[8:108])[:5]
    assert [i for _, i in sorted(got[0])] == [i for _, i in far]


def test_blocks_stay_below_their_size(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 50)
    rows = [(i, [0.0, 0.0] if i % 2 else [float(i % 5), 1.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(60)  # many small batches
    number, parts = F.monotonically_increasing_id(), F.lit(300 // 25)  # as many as the operator takes for 300 rows
    dealt = df.where("id % 2 = 1").withColumn("_r", number).groupBy(F.pmod(F.xxhash64("_r"), parts)).count()
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) == 12 and max(sizes) <= 50
    got = neighbors.nearest(df.where("id < 20"), df, 3, "id", "id")
    assert got.count() == 60


def _cells(spark):
    from quillspark.session import new_folder

    return neighbors.CellIndex(spark, new_folder(spark))


def _found(rows):
    got: dict = {}
    for r in rows.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor_id"])
    return got


def test_batches_are_added_to_stored_cells(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, "id long, embedding array<float>")
    index = _cells(spark)
    assert index.nearest(df, 3, "id").count() == 0
    index.add(df.where("id < 150"), "id", batch=0)
    first = {r["_iid"]: r["_cell"] for r in spark.read.parquet(f"{index.folder}/rows").collect()}
    chosen = index.pivots()
    monkeypatch.setattr(neighbors.CellIndex, "_choose_pivots", None)  # no pivots are chosen again
    index.add(df.where("id >= 150"), "id", batch=1)
    files = {r["file"]: r["batch"] for r in spark.read.parquet(f"{index.folder}/rows").select(F.input_file_name().alias("file"), "batch").distinct().collect()}
    again = {r["_iid"]: r["_cell"] for r in spark.read.parquet(f"{index.folder}/rows").collect()}
    assert {i: again[i] for i in first} == first and set(files.values()) == {0, 1} and np.array_equal(chosen, index.pivots())
    assert _found(index.nearest(df, 5, "id")) == _brute(vectors, 5)
    only = _found(index.nearest(df, 5, "id", admit=F.col("batch") < 1))
    assert only == {i: [j for j in _brute(vectors, 239)[i] if j < 150][:5] for i, _ in vectors}
    index.add(df.where("id >= 150"), "id", batch=1)  # again: replaced, not repeated
    assert spark.read.parquet(f"{index.folder}/rows").count() == 240


def test_a_merged_index_gives_the_same_rows(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, embedding array<float>")
    index = _cells(spark)
    for batch in range(3):
        index.add(df.where(F.col("id") % 3 == batch), "id", batch=batch)
    merged = index.merged(_cells(spark).folder)
    assert len(merged.pivots()) > len(index.pivots())
    assert _found(merged.nearest(df, 4, "id", earlier_only=True)) == _found(index.nearest(df, 4, "id", earlier_only=True))


def test_rows_are_excluded_by_reference_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=64) * 0.2 * (1 + i % 7)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = _cells(spark)
    index.add(df, "id")
    asked = df.where("id % 10 = 0")
    compared = index.search(asked, 5, "id").agg(F.sum("_compared")).first()[0]
    assert compared < 0.1 * 300 * 3000  # of the pairs of all queries and rows


def test_arrays_of_distances_stay_below_a_tile(spark, vectors, monkeypatch):
    shapes = []
    whole = neighbors._distances
    assert neighbors._step(65_536 * (neighbors.HEADS + 1)) * 65_536 * (neighbors.HEADS + 1) <= neighbors.TILE
    assert all(neighbors._step(n) * n <= max(n, neighbors.TILE) for n in (1, 100, 10_000, 1_000_000, 10_000_000))
    monkeypatch.setattr(neighbors, "TILE", 40)
    df = spark.createDataFrame(vectors, "id long, embedding array<float>")
    monkeypatch.setattr(neighbors, "_distances", lambda a, b: shapes.append((len(a), len(b))) or whole(a, b))
    assert _found(neighbors.nearest(df.where("id < 30"), df, 5, "id", "id")) == {i: v for i, v in _brute(vectors, 5).items() if i < 30}


@pytest.mark.parametrize("how", [{}, {"exclude_self": False}, {"earlier_only": True}])
def test_vectors_without_structure_travel_once_a_block(spark, monkeypatch, how):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[i % 5][1]) for i in range(40)]  # copies: ties by id
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = _cells(spark)
    index.add(df, "id")
    found = index.search(df, 5, "id", **how)
    assert found.count() <= 640 * 5 * 4  # 25 cells, each of which every query visits
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 100)
    monkeypatch.setattr(neighbors, "PRODUCT", (32, 48))
    m = np.array([v for _, v in rows])
    want = {}
    for i in range(640):
        d = ((m - m[i]) ** 2).sum(1)
        ok = [(d[j], j) for j in range(640) if (j < i if "earlier_only" in how else j != i or how)]
        if ok:
            want[i] = [j for _, j in sorted(ok)[:5]]
    assert _found(index.nearest(df, 5, "id", **how)) == want
