import random

from pyspark.sql import functions as F

from quillspark.operators import ordered


def _rows(n=400, seed=1):
    rnd = random.Random(seed)
    # One key holds most rows, and many rows share a timestamp.
    return [(i, "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", rnd.randrange(6), rnd.random()) for i in range(n)]


def test_position_per_key_and_global(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, key string, at int, v double")
    got = {r["id"]: r["position"] for r in ordered.with_position(df, ["key"], ["at", "id"]).collect()}
    seen: dict[str, int] = {}
    for i, key, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[key] = seen.get(key, 0) + 1
        assert got[i] == seen[key]
    everywhere = {r["id"]: r["position"] for r in ordered.with_position(df, [], ["at", "id"]).collect()}
    for n, row in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        assert everywhere[row[0]] == n


def test_chunks(spark):
    df = spark.range(45)
    got = sorted((r["id"], r["chunk"], r["index_in_chunk"]) for r in ordered.chunked(df, ["id"], 20).collect())
    assert got == [(i, i // 20, i % 20 + 1) for i in range(45)]


def test_moving_average(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, key string, at int, v double")
    got = {r["key"]: r for r in ordered.moving_average(df, ["key"], ["at", "id"], "v").collect()}
    want: dict[str, float] = {}
    n: dict[str, int] = {}
    for _, key, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[key] = v if key not in want else 0.8 * want[key] + 0.2 * v
        n[key] = n.get(key, 0) + 1
    assert got.keys() == want.keys()
    for key in want:
        assert abs(got[key]["confidence"] - want[key]) < 1e-9 and got[key]["usage_count"] == n[key]
    three = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1.0), (3, "a", 0.0)], "id long, key string, v double")
    assert abs(ordered.moving_average(three, ["key"], ["id"], "v").first()["confidence"] - 0.48) < 1e-9


def test_running_max_and_asof(spark):
    rows = _rows(300, 7)
    df = spark.createDataFrame(rows, "id long, key string, at int, v double")
    got = {r["id"]: r["m"] for r in ordered.running_max(df, ["key"], ["at", "id"], F.col("v"), "m").collect()}
    top: dict[str, float] = {}
    for i, key, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        top[key] = max(top.get(key, -1.0), v)
        assert got[i] == top[key]

    facts = df.where("id % 3 = 0").withColumn("at", F.col("at") * 100 + F.col("id") % 7)
    asks = df.where("id % 3 = 1").withColumn("at", F.col("at") * 100 + 3)
    found = {int(r["id"]): r["v"] for r in ordered.asof_backward(asks, facts, ["key"], "at", "id", "id", "v").collect()}
    known = [(r["key"], r["at"], str(r["id"]), r["v"]) for r in facts.collect()]
    for r in asks.collect():
        before = [f for f in known if f[0] == r["key"] and f[1] <= r["at"]]
        want = max(before, key=lambda f: (f[1], f[2]))[3] if before else None
        assert found[r["id"]] == want
