import random

from quillspark.operators import callgraph


def plain(edges, start, most):
    seen, now = {start: 0}, [start]
    for hop in range(1, most + 1):
        now = sorted({b for a, b in edges if a in now} - set(seen))
        seen |= {n: hop for n in now}
    return seen


def test_hops_on_cycles_and_hubs(spark):
    rnd = random.Random(2)
    ring = [(f"n{i}", f"n{(i + 1) % 12}") for i in range(12)]
    hub = [(f"n{i}", "hub") for i in range(12)] + [("hub", "n5"), ("hub", "hub")]
    more = [(f"n{rnd.randrange(30)}", f"m{rnd.randrange(30)}") for _ in range(40)]
    edges = [*ring, *hub, *more, *more]
    df = spark.createDataFrame([("p", *e) for e in edges] + [("q", "n0", "elsewhere")], "project string, src string, dst string")
    names = ["n0", "n3", "hub", "m1", "unknown"]
    starts = spark.createDataFrame([("p", n) for n in [*names, "n0"]], "project string, start string")
    for way, real in (("callees", edges), ("callers", [(b, a) for a, b in edges])):
        for most in (0, 1, 3, 20):
            got = {(r["start"], r["node"]): r["hops"] for r in callgraph.hops(df, starts, most, way).collect()}
            assert got == {(s, n): h for s in names for n, h in plain(real, s, most).items()}
    near = {(r["src"], r["dst"]) for r in callgraph.call_graph(df, starts.where("start = 'n3'"), 1).collect()}
    inside = set(plain(edges, "n3", 1)) | set(plain([(b, a) for a, b in edges], "n3", 1))
    assert near == {(a, b) for a, b in edges if a in inside and b in inside}
