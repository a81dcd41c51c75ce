import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import patterns


def _words(text):
    return set(text.lower().split())


def _jaccard(a, b):
    a, b = _words(a), _words(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def _norm(name):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", "", name.lower().strip()))


def _sequential_groups(cases):
    """The rule stated as one ordered loop."""
    seeds, out = [], {}
    for seq, name, desc in cases:
        n, best, score = _norm(name), None, 0.0
        for s, sn, sd in seeds:
            if sn == n:
                best = s
                break
            if n in sn or sn in n:
                by_name = min(len(n), len(sn)) / max(len(n), len(sn))
            else:
                by_name = _jaccard(n, sn)
            by_desc = _jaccard(desc, sd) if desc and sd else 0.0
            total = by_name * 0.7 + by_desc * 0.3
            if (by_name >= 0.8 or (by_name >= 0.5 and by_desc >= 0.6)) and total > score:
                best, score = s, total
        if best is None:
            seeds.append((seq, n, desc))
            best = seq
        out[seq] = best
    return out


def test_group_similar_matches_ordered_loop(spark):
    rnd = random.Random(3)
    vocab = ["agent", "tool", "mock", "smart", "art", "loop", "Check!", "flow"]
    cases = []
    for i in range(160):
        name = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 4)))
        desc = " ".join(rnd.choice(["uses", "a", "mock", "server", "tool"]) for _ in range(rnd.randint(0, 4)))
        cases.append((i, name, desc))
    df = spark.createDataFrame(cases, "seq long, pattern_name string, description string")
    got = {r["seq"]: r["pattern_seq"] for r in patterns.group_similar(df).collect()}
    assert got == _sequential_groups(cases)


def test_repeated_cases_join_better_patterns_created_since(spark):
    """A case that joined a pattern is repeated after one that fits it better was created."""
    rnd = random.Random(8)
    kinds = [(" ".join(rnd.sample(["red", "blue", "gear", "bolt", "small", "large"], 3)), rnd.choice(["m n", "m o", "p"])) for _ in range(60)]
    cases = [(i, *rnd.choice(kinds)) for i in range(500)]
    want = _sequential_groups(cases)
    first = {}
    assert any(first.setdefault(c[1:], want[c[0]]) != want[c[0]] for c in cases)  # some change their pattern
    df = spark.createDataFrame(cases, "seq long, pattern_name string, description string")
    assert {r["seq"]: r["pattern_seq"] for r in patterns.group_similar(df).collect()} == want


def _merge_loop(found):
    out, used = {}, set()
    for i, (name, cat, ind) in enumerate(found):
        if i in used:
            continue
        out[i] = i
        for j in range(i + 1, len(found)):
            if j in used:
                continue
            n2, c2, i2 = found[j]
            a, b = set(name.lower().replace("_", " ").split()), set(n2.lower().replace("_", " ").split())
            x, y = set(ind), set(i2)
            by_name = len(a & b) / max(len(a), len(b))
            by_ind = len(x & y) / max(len(x), len(y)) if x and y else 0.0
            if cat == c2 and (by_name > 0.6 or by_ind > 0.5):
                used.add(j)
                out[j] = i
    return out


def test_merge_groups_match_ordered_loop(spark):
    rnd = random.Random(5)
    found = []
    for _ in range(150):
        name = "_".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
        ind = [rnd.choice("uvwxyz") for _ in range(rnd.randint(0, 4))]
        found.append((name, rnd.choice(["p", "q"]), ind))
    rows = [(i, n, "d", c, 0.5, [], ind) for i, (n, c, ind) in enumerate(found)]
    schema = ("pattern long, pattern_name string, pattern_description string, pattern_category string, "
              "confidence_score double, distinguishing_features array<string>, code_indicators array<string>")
    df = spark.createDataFrame(rows, schema)
    got = {r["pattern"]: r["seed"] for r in patterns.merge_groups(df).collect()}
    assert got == _merge_loop(found)


def test_merge_keeps_most_confident_name_and_distinct_references(spark):
    schema = ("pattern long, pattern_name string, pattern_description string, pattern_category string, "
              "confidence_score double, distinguishing_features array<string>, code_indicators array<string>")
    df = spark.createDataFrame(
        [(1, "mock agent", "d1", "c", 0.6, ["f1"], ["i2"]), (2, "Mock Agent", "d2", "c", 0.8, ["f0", "f1"], ["i1"])],
        schema,
    )
    refs = spark.createDataFrame([(1, "a.py", "1", "p"), (2, "a.py", "1", "p"), (2, "b.py", "2", "p")],
                                 "pattern long, file_path string, doc_id string, project string")
    merged, kept = patterns.merge_similar(df, refs)
    row = merged.first()
    assert row["pattern_name"] == "Mock Agent" and abs(row["confidence_score"] - 0.7) < 1e-9
    assert row["distinguishing_features"] == ["f0", "f1"] and row["code_indicators"] == ["i1", "i2"]
    assert row["example_count"] == 2 and kept.count() == 2


def test_similar_sets_match_brute_force(spark):
    rnd = random.Random(9)
    sets = [(i, sorted({rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 5))})) for i in range(80)]
    df = spark.createDataFrame(sets, "item long, tokens array<string>")
    got = {(r["item_a"], r["item_b"]) for r in patterns.similar_sets(df, 0.5).collect()}
    first: dict = {}
    for i, t in sets:
        first.setdefault(tuple(t), i)
    reps = sorted((i, set(t)) for t, i in first.items())
    want = {(a, b) for n, (a, x) in enumerate(reps) for b, y in reps[n + 1:] if len(x & y) / len(x | y) >= 0.5}
    assert got == want


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "example_count long, confidence_score double, usage_count long")
    assert tuple(patterns.statistics(none).first()) == (0, 0, 0.0, 0.0)


def test_normalised_names(spark):
    from quillspark.functions.text import normalize_name

    df = spark.createDataFrame([("  My  Pattern! ",), ("Ünï_Code-x  y?",)], "n string")
    assert [r[0] for r in df.select(normalize_name(F.col("n"))).collect()] == ["my pattern", "ünï_code-x y"]


def test_chains_take_few_phases(spark, monkeypatch):
    from quillspark.operators import seeds

    # item i matches i + 1 only: every other item is a seed, and a plain walk needs 500 rounds
    items = spark.range(1000).withColumnRenamed("id", "item")
    buckets = items.select("item", F.explode(F.array("item", F.col("item") + 1)).alias("bucket"))
    stored = []
    monkeypatch.setattr(seeds, "materialize", lambda df, keep=seeds.materialize: stored.append(1) or keep(df))
    out = seeds.greedy_seeds(items, buckets, lambda a, b: F.when(F.col(f"{b}item") - F.col(f"{a}item") == 1, F.lit(1.0)), front=1)
    got = {r["item"]: r["seed"] for r in out.collect()}
    assert got == {i: i - i % 2 for i in range(1000)} and len(stored) < 30


def test_dense_random_matches_follow_the_ordered_walk(spark):
    from quillspark.operators import seeds

    rnd = random.Random(8)
    match = {(a, b) for a in range(120) for b in range(a + 1, 120) if rnd.random() < 0.06}
    items = spark.range(120).withColumnRenamed("id", "item")
    pairs = spark.createDataFrame(sorted(match), "a long, b long")
    buckets = pairs.select(F.explode(F.array("a", "b")).alias("item"), F.concat_ws("-", "a", "b").alias("bucket"))
    listed = F.array(*[F.lit(a * 1000 + b) for a, b in sorted(match)])
    rank = lambda l, r: F.when(F.array_contains(listed, (F.col(f"{l}item") * 1000 + F.col(f"{r}item")).cast("int")), F.lit(1.0))  # noqa: E731, E741
    got = {r["item"]: r["seed"] for r in seeds.greedy_seeds(items, buckets, rank, front=1).collect()}
    want, found = {}, []
    for i in range(120):
        mine = [s for s in found if (s, i) in match]
        want[i] = mine[0] if mine else i
        found += [] if mine else [i]
    assert got == want


def test_candidates_of_a_popular_word_are_few(spark):
    from quillspark.operators.seeds import candidates, jaccard_prefixes

    n = 8000
    sets = spark.range(n).select(F.col("id").alias("item"), F.array(F.lit("check"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("tokens"))
    rows = jaccard_prefixes(sets, 0.5).withColumnRenamed("token", "bucket")
    assert candidates(rows, rows, 0.5).count() < 10 * n


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_candidates_hold_every_similar_pair(spark, threshold):
    from quillspark.operators.seeds import candidates, jaccard_prefixes

    rnd = random.Random(11)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    sets = sorted({tuple(sorted({rnd.choice(words) for _ in range(rnd.randint(1, 9))})) for _ in range(260)})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "item long, tokens array<string>")
    rows = jaccard_prefixes(df, threshold).withColumnRenamed("token", "bucket")
    got = {tuple(r) for r in candidates(rows, rows, threshold).collect()}
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len({*a} & {*b}) >= threshold * len({*a} | {*b}) - 1e-9}
    assert similar <= got
