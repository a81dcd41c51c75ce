"""Operators against plain versions, and rows that callers really have: odd letters, repeated ids, clashing columns, other id types."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, fingerprints, licenses, neardup, sharding, token_counts, toxicity, warc
from quillspark.session import checkpoint_root

ITEM = "A shop in Boston sells 12 apples and 30 pears each day while the old baker called Miller keeps 7 large loaves for the poor people near the river"
OTHER = "A shop in Dallas sells 15 apples and 44 pears each day while the old baker called Turner keeps 9 large loaves for the poor people near the river"


@pytest.mark.parametrize("odd", [" İstanbul", " Far away İzmir", " ẞ Ⱥ", " K Å Ω"])
def test_odd_letters_hide_no_names(spark, odd):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    half = OTHER.index(" while")
    texts = [OTHER, OTHER + odd, odd.strip() + " is not so near. " + OTHER, OTHER[:half] + odd + OTHER[half:], "nothing of it" + odd]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in decontamination.benchmark_matches(docs, bench).collect()}
    assert found == {0, 1, 2, 3}


def plain_matches(docs, items, window, min_share):
    """Items without numbers or names: windows of the item met in one span of four times its words."""
    out = set()
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            own = item.lower().split()
            wanted = {}
            for j in range(len(own) - window + 1):
                wanted.setdefault(tuple(own[j : j + window]), []).append(j)
            n = len(own) - window + 1
            hits = [(p, j) for p in range(len(words) - window + 1) for j in wanted.get(tuple(words[p : p + window]), ())]
            for part in range(len(words) // (2 * len(own)) + 1):
                met = {j for p, j in hits if part <= p // (2 * len(own)) <= part + 1}
                if len(met) >= min_share * n:
                    out.add((d, i, max(len(met), 0)))
    best = {}
    for d, i, met in out:
        best[d, i] = max(best.get((d, i), 0), met)
    return best


def test_decontamination_equals_plain_windows(spark):
    rnd = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(12, 40)))) for k in range(6)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(3):
            words = rnd.choice(items)[1].split()
            at, to = sorted(rnd.sample(range(len(words) + 1), 2))
            parts.append(" ".join(words[at:to]) + " " + " ".join(rnd.choices(vocabulary, k=rnd.randrange(0, 6))))
        docs.append((d, " ".join(parts)))
    got = decontamination.benchmark_matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = plain_matches(docs, items, 8, 0.4)
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in got.collect()} == want and len(want) > 20


def test_sample_of_labels_is_bounded_by_rows(spark):
    docs = spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(8, "b"), (9, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, 0, 1), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, toxicity.CATEGORIES, 10, "doc_id", "text")
    assert sorted((r["doc_id"], r["text"], r["y"]) for r in sample.collect()) == [(7, "text 0", [0, 1]), (8, "b", [1, 1]), (9, "", [0, 0])]
    assert toxicity.labelled_sample(docs, labels, toxicity.CATEGORIES, 2, "doc_id", "text").count() == 2


@pytest.fixture(scope="module")
def chain(spark):
    docs = spark.createDataFrame([(i, f"{'awful stuff here' if i % 3 == 0 else 'kind words there'} number {i}") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    return toxicity.train_chain(docs, labels, n_features=64)


def test_scores_equal_a_plain_chain(spark, chain):
    texts = ["Awful stuff here, awful stuff here, AWFUL STUFF HERE", "kind words", "", None, "é" * 50, "awful stuff " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_chain(docs, chain).collect()}
    for i, text in enumerate(texts):
        data = "".join(c.lower() if c < "\x80" else c for c in text or "").encode()
        counts = {}
        for size in toxicity.GRAMS:
            for at in range(len(data) - size + 1):
                value = int.from_bytes(data[at : at + size], "big")
                bucket = (value * (0x9E3779B97F4A7C15 + 2 * size)) % (1 << 64) >> (64 - toxicity.BUCKET_BITS)
                if chain.slot[bucket] >= 0:
                    counts[int(chain.slot[bucket])] = counts.get(int(chain.slot[bucket]), 0) + 1
        probabilities = []
        for bias, weights, earlier in zip(chain.bias, chain.weights, chain.earlier, strict=True):
            z = bias + sum(weights[f] + (weights[f + chain.n_features] if n >= toxicity.OFTEN else 0) for f, n in counts.items())
            z += sum(e * p for e, p in zip(earlier, probabilities, strict=False))
            probabilities.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        assert [got[i]["p_low_quality"], got[i]["p_toxic"]] == pytest.approx(probabilities)
        assert got[i]["rejected"] == (probabilities[1] >= chain.threshold[1])


CLASHING = "doc_id long, text string, _p string, p string, row string, _id int, _rank int, id int, u1 int, met boolean, _from int, _at int, _slots int, _last int, carry int, old int, block int"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"text of its own number {i} and so on with {i * 7} and {i * 13}", "p", "q", "r", *range(4), True, *range(6), 17) for i in range(40)]
    return spark.createDataFrame([(*r[:16], 99) for r in rows], CLASHING)


def as_rows(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_columns_of_any_name_stay(spark, clashing, chain):
    want = as_rows(clashing, clashing.columns)
    scored = toxicity.score_chain(clashing, chain)
    assert scored.columns == [*clashing.columns, "p_low_quality", "p_toxic", "rejected"] and as_rows(scored, clashing.columns) == want
    left = neardup.without_near_duplicates(clashing)
    assert left.columns == clashing.columns and as_rows(left, clashing.columns) == want
    shards = sharding.reshard(clashing, F.col("doc_id") % 3, 3, n_new=4, folder=f"{checkpoint_root(spark)}/clashing")
    assert shards.columns == [*clashing.columns, "slot", "shard"] and as_rows(shards, clashing.columns) == want


def test_near_duplicates_judge_rows(spark):
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    near = same + " words"
    other = "quite another text that has nothing to do with the first one at all"
    rows = [(1, same, "a"), (1, other, "b"), (2, near, "c"), (1, same, "d"), (None, other, "e"), (None, "no twin has this text here", "f"),
            (None, "no twin has this text here", "g"), (5, "", "h"), (5, "", "i"), (None, None, "j"), (None, " \n", "k")]
    left = neardup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3))
    found = sorted((r["doc_id"] or 0, r["text"] or "", r["tag"]) for r in left.collect())
    tags = {t for *_, t in found}
    assert {"b", "h", "i", "j", "k"} <= tags and not tags & {"c", "e"}
    assert len(tags & {"a", "d"}) == 1 and len(tags & {"f", "g"}) == 1 and len(found) == 7


def plain_digest(data):
    counts = [0] * fingerprints.BUCKETS
    for at in range(len(data) - 2):
        counts[(int.from_bytes(data[at : at + 3], "big") * 2654435761) % (1 << 32) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k * len(counts) // 4 - 1] for k in (1, 2, 3))
    spread = (15 * q1 // q3, 15 * q2 // q3) if q3 else (0, 0)
    return [min(255, round(8 * math.log2(len(data) + 1))), *spread, *((c > q1) + (c > q2) + (c > q3) for c in counts)]


def test_digest_and_likeness_equal_plain_ones():
    rnd = random.Random(6)
    texts = [b"", b"ab", b"abc", b"abc" * 4000, *(bytes(rnd.choices(b"abcdef gh", k=rnd.randrange(3, 3000))) for _ in range(8))]
    plain = [plain_digest(t) for t in texts]
    for t, p in zip(texts, plain, strict=True):
        assert fingerprints.digest(t).tolist() == p
        assert fingerprints.from_text(fingerprints.as_text(fingerprints.digest(t))).tolist() == p
    for a, p in zip(texts, plain, strict=True):
        for b, q in zip(texts, plain, strict=True):
            apart = sum(abs(x - y) for x, y in zip(p, q, strict=True))
            assert fingerprints.likeness(fingerprints.digest(a), fingerprints.digest(b)) == pytest.approx(1 - min(apart, fingerprints.BOUND) / fingerprints.BOUND)


def test_fingerprints_of_text_ids(spark):
    rows = [(f"id{i:03d}", f"text number {i} " * (i % 5)) for i in range(300)] + [(None, "none")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    following = {rows[k][0]: rows[k + 1][1] for k in range(299)} | {None: rows[0][1], "id299": "none"}
    digests = {i: fingerprints.digest(t.encode()) for i, t in rows}
    texts = {i: fingerprints.digest(t.encode()) for i, t in following.items()}
    assert len(got) == 301
    for r in got:
        assert r["near_next"] == pytest.approx(fingerprints.likeness(digests[r["doc_id"]], texts[r["doc_id"]]))


def test_no_license_templates(spark):
    docs = spark.createDataFrame([(1, "under the mit license and more"), (2, None)], "doc_id long, text string")
    got = licenses.license_report(docs, base=(), notices=()).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["labels"], r["score"]) for r in got) == [(1, 6, 0, "", 0.0), (2, 0, 0, "", 0.0)]


def test_shards_equal_plain_placement(spark):
    rnd = random.Random(8)
    docs = spark.createDataFrame([(i, "x" * rnd.randrange(0, 400)) for i in range(500)], "doc_id long, text string")
    old, n_old, n_new, n_blocks = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 5), 5, 7, 11
    h = F.xxhash64("doc_id", "text")
    lines = docs.select("doc_id", old.alias("old"), h.alias("h"), (F.octet_length("text") + 8).alias("size"),
                        F.pmod(F.xxhash64(F.lit("block"), h), F.lit(n_blocks)).alias("block")).collect()
    supply = [sum(r["size"] for r in lines if r["old"] == k) for k in range(n_old)]
    capacities = sharding.even_capacities(sum(supply), n_new)
    flow = sharding.cheapest_flow(supply, capacities)
    want, over, room = {}, [], list(capacities)
    for k in range(n_old):
        cuts, at = [], 0
        for j in sorted(range(n_new), key=lambda j: (j != k, j)):
            if flow[k][j]:
                at += flow[k][j]
                cuts.append((at, j))
        at = 0
        for r in sorted((r for r in lines if r["old"] == k), key=lambda r: (r["block"], r["h"])):
            j = next(j for end, j in cuts if end > at)
            if any(at < end < at + r["size"] for end, _ in cuts):
                over.append(r)
            else:
                want[r["doc_id"]] = j
                room[j] -= r["size"]
            at += r["size"]
    for r in sorted(over, key=lambda r: (-r["size"], r["old"], r["block"], r["h"])):
        j = max(range(n_new), key=lambda j: (room[j], -j))
        room[j] -= r["size"]
        want[r["doc_id"]] = j
    got = sharding.reshard(docs, old, n_old, n_new=n_new, n_blocks=n_blocks, folder=f"{checkpoint_root(spark)}/placed").collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want


def test_number_of_blocks_follows_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BYTES", 64)
    docs = spark.createDataFrame([(i, "y" * 92) for i in range(200)], "doc_id long, text string")
    got = sharding.reshard(docs, F.lit(0), 1, n_new=3, folder=f"{checkpoint_root(spark)}/blocks").collect()
    sizes = [sum(100 for r in got if r["shard"] == k) for k in range(3)]
    assert len(got) == 200 and max(sizes) - min(sizes) <= 100


def test_records_of_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>a</p>"), (1, "u1", "<p>a</p>"), (2, "u2", None), (None, "u3", "<p>c</p>"), (4, None, "<p>d</p>" * 5000)],
                                  "page_id long, url string, html string").repartition(2)
    index = warc.write_archive(pages, f"{checkpoint_root(spark)}/records", frame_bytes=300)
    ask = lambda *ids: sorted((r["record_id"], bytes(r["payload"] or b"")[:8]) for r in warc.fetch_records(index, spark.createDataFrame([(i,) for i in ids], "page_id long")).collect())
    assert ask(None, None) == [("urn:page:none", b"<p>c</p>")]
    assert ask(1) == [("urn:page:1", b"<p>a</p>")] * 2
    assert ask(4, 2, 77) == [("urn:page:2", b""), ("urn:page:4", b"<p>d</p>")]


def test_token_counts_of_repeated_and_long_rows(spark):
    import tiktoken  # noqa: F401

    rows = [(1, "a word"), (1, "a word"), (2, None), (3, "long text " * 40_000)]
    counts = token_counts.with_token_count(spark.createDataFrame(rows, "doc_id long, text string"), "/opt/tokenizers/byte_bpe_50k.tiktoken")
    found = sorted((r["doc_id"], r["n_tokens"]) for r in counts.collect())
    assert found[0] == found[1] and found[2] == (2, 0) and found[3][1] >= 40_000
    histogram = token_counts.length_histogram(counts).collect()
    assert sum(r["n_docs"] for r in histogram) == 4 and max(r["tokens_at_least"] for r in histogram) == sum(n for _, n in found)
