"""Each operator on small rows with all the odd cases, against a plain version."""

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import (
    decontamination, fingerprints, licenses, line_dedup, neardup, pieces, sharding, token_counts, toxicity, warc,
)
from quillspark.llm.words import SEGMENT, Words, byte_class, grams
from quillspark.operators.components import connected
from quillspark.session import checkpoint_root

SCHEMA = "doc_id long, text string, lang string, kept string, row string, `a.b` int"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def rows(*texts, start=1):
    return [(start + i, t, "en", "k", "r", i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, repeated rows, equal texts, a null id, a very long text."""
    some = rows("One line here is long enough\nshort\nOne Line here is long enough  ", None, "", " \n\t\n", "same text", "same text", LONG)
    return spark.createDataFrame([*some, some[4], (None, "no id", None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


# words


def test_words_of_odd_texts():
    words = Words(~byte_class((0x20, 0x20), (0x09, 0x0D)))
    texts = [None, "", "\n", "a  B\tc", "É é", "x" * (SEGMENT + 5) + " y", LONG]
    hashes = {}
    for i, data, starts, ends, found in words.each(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", low(texts[i]))
        assert [bytes(words.lower[data[a:b]]).decode() for a, b in zip(starts, ends, strict=True)] == want
        for w, h in zip(want, found.tolist(), strict=True):
            assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)
    assert len(grams(np.zeros(0, np.uint64), 3)) == 0 and len(grams(np.arange(2, dtype=np.uint64), 3)) == 1


# 1 lines


def plain_lines(docs, min_chars=20, min_docs=3):
    """docs: (id, text); the contract, one line at a time."""
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    drop = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if drop.get(key(x), d) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines(spark):
    common, accented = "This line is in many documents.", "ÉTÉ À LA PLAGE AVEC NOUS TOUS"
    texts = [
        f"{common}\nown one", f"  {common.upper()}\t\n{common}\n\nx", f"y\n{common}", common, f"{common}\n{common}\nlast", None, "",
        accented, accented.lower(), accented, accented + "\r", "a" * 19, "a" * 19, "a" * 19, "b" * 20, "b" * 20, "b" * 20 + "\n",
    ]
    docs = rows(*texts)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted(plain_lines([d[:2] for d in docs]))
    assert {(r["kept"], r["row"]) for r in got} == {("k", "r")} and got[0].asDict()["a.b"] is not None


def test_lines_of_odd_rows(odd, none):
    got = {(r["doc_id"], r["text"]): r["n_lines"] for r in line_dedup.dedup_lines(odd).collect()}
    assert got[(2, "")] == got[(3, "")] == 1 and got[(4, " \n\t\n")] == 3 and got[(None, "no id")] == 1
    assert line_dedup.dedup_lines(odd).count() == 9
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_of_repeated_and_missing_ids(spark):
    line = "a line that is long enough"
    same = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert line_dedup.dedup_lines(same).agg(F.sum("n_dropped")).first()[0] == 0  # two documents
    more = same.union(spark.createDataFrame([(None, line + "\nx")], same.schema))
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(more).collect())
    assert got == [("1", ""), ("1", ""), ("2", line), ("None", "x")]


# 2 toxicity


def test_chain_learns_and_uses_earlier_categories(spark):
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "mag", "ven") for b in ("um", "at", "is", "or")]
    rng = np.random.default_rng(3)

    def text(toxic, junk):
        said = rng.choice(words, 40).tolist()
        said[3:6] = ["vilescum"] * 3 if toxic else said[3:6]
        return (" %%% " if junk else " ").join(said)

    facts = [(i, i % 4 == 0, i % 5 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, text(t, j)) for i, t, j in facts], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(not j), int(t)) for i, t, j in facts if i < 400] + [(0, None, 1), (None, 1, 1), (599, None, None)],
        "doc_id long, quality int, toxic int",
    )
    chain = toxicity.train_chain(docs, labels)
    assert len(chain.earlier[0]) == 0 and len(chain.earlier[1]) == 1
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score_chain(docs, chain).collect()}
    wrong = sum(got[i] != t for i, t, _ in facts if i >= 400)
    assert wrong <= 2


def test_chain_without_labels(spark, odd, none):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(odd, nothing)
    got = toxicity.score_chain(odd, chain)
    assert got.count() == 9 and got.where("rejected").count() == 0
    assert {"a.b", "kept", "row", "p_toxic"} <= set(got.columns)
    assert toxicity.score_chain(none, chain).count() == 0


def test_chain_of_one_class(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_chain(odd, toxicity.train_chain(odd, labels)).where("rejected").count() == 0


# 3 fingerprints


def plain_edits(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    out = {}
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        out[d] = hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_edited_texts(spark, n):
    rng = np.random.default_rng(n)
    docs = [(int(i) * 7 % 101, "".join(rng.choice(list("abcé 漢\n"), int(rng.integers(0, 90))))) for i in range(n)]
    df = spark.createDataFrame([(d, t or None, "x") for d, t in docs], "doc_id long, text string, part string")
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()}
    assert {d: r["edited_sha256"] for d, r in got.items()} == plain_edits(docs)
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    for d, t in docs:
        assert got[d]["n_chars"] == len(t) and got[d]["fingerprint"] == prints[d]
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        assert np.array_equal(fingerprints.from_text(prints[d]), fingerprints.digest(t.encode()))


def test_likeness_orders_edits():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    said = rng.choice(words, 300).tolist()
    near, far = said[:280] + rng.choice(words, 20).tolist(), rng.choice(list("klmnopqrst"), 1800).tolist()
    a, b, c = (fingerprints.digest(s.encode()) for s in (" ".join(said), " ".join(near), "".join(far)))
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.7 > 0.3 > fingerprints.likeness(a, c)


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert len(got) == 9 and sum(r["doc_id"] is None for r in got) == 1
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert fingerprints.edited_fingerprints(none).count() == 0


# 4 decontamination


def test_reparameterised_questions(spark):
    item = "A train leaves the big station at 9 and drives 120 km to the village where Anna waits for 3 hours before the next one goes on"
    bench = spark.createDataFrame([(1, item, 7), (2, None, 7), (3, "too short", 7), (4, "", 7)], "item_id long, text string, doc_id int")
    other = item.replace("120", "85").replace(" 9 ", " 7 ").replace("Anna", "Mario").replace(" 3 ", " 4 ")
    # same form, but one value of the item stands for two
    twisted = item.replace("120", "9").replace("Anna", "Mario")
    docs = rows(
        f"Before. {item} After.", f"Well, {other}; that was it", item.upper(), twisted, "A train leaves the big station at 9",
        None, "", "completely different words " * 30, "9 120 3 " * 40, "too short", "It is too short.", LONG + " " + item,
    )
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.benchmark_matches(spark.createDataFrame(docs, SCHEMA), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (10, 3), (12, 1)}
    assert got[(1, 1)]["share"] == 1 and got[(2, 1)]["changed"] == 4 and got[(1, 1)]["changed"] == 0


def matches(spark, items, texts):
    """Pairs (document, item), numbered from 0, with their rows."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontamination.benchmark_matches(docs, bench).collect()}


def test_words_put_in_or_left_out(spark):
    words = "a farmer sells eggs on the market every morning and keeps what is left for the guests who come to eat in the evening".split()
    trip = "A bus leaves the station with 1,250 liters of fuel and goes 3.5 hours until it comes to New York where all of them sleep"
    put_in = " ".join([*words[:12], "really", *words[12:]])
    other = trip.replace("1,250", "900").replace("3.5", "4").replace("New York", "Boston")
    far = " ".join(words[:9]) + " filler" * 300 + " " + " ".join(words[12:20])
    got = matches(spark, [" ".join(words), trip], [put_in, " ".join(words[:11] + words[12:]), other, f"So: {trip}", far])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 1)}
    assert got[(0, 0)]["matched"] == len(words) - 14 and got[(2, 1)]["changed"] == 3 and got[(3, 1)]["share"] == 1


def test_windows_as_they_stand_need_no_consistency(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    words[4] = words[35] = "12"
    changed = [*words[:35], "13", *words[36:]]
    fruit = "Anna has 3 apples in the basket and buys 5 pears at the shop before she goes home to eat"
    equal = fruit.replace("3", "4").replace("5", "4")
    got = matches(spark, [" ".join(words), fruit], [" ".join(changed), equal, fruit.replace("3", "5")])
    assert set(got) == {(0, 0), (1, 1), (2, 1)}
    assert got[(0, 0)]["matched"] == 28 and got[(2, 1)]["matched"] == 10 and got[(1, 1)]["changed"] == 2


def test_short_items_in_longer_texts(spark):
    items = ["What is the capital of France?", "who wrote this long letter", "too short", "how far is 5 km"]
    around = "He asked me at the table yesterday. {} Nobody of us had any idea what to say."
    got = matches(spark, items, [around.format(t) for t in (*items, "What is the capital of Spain?", "It was.")] + ["too short", "Too short!"])
    assert set(got) == {(0, 0), (1, 1), (4, 0), (6, 2), (7, 2)}
    assert got[(4, 0)]["changed"] == 1 and got[(0, 0)]["changed"] == 0


def test_clean_documents_stay(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text"), (1, "same text")], "item_id long, text string")
    left = decontamination.without_benchmark(odd, bench)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4", "7", "None"]
    assert decontamination.without_benchmark(none, bench).count() == 0
    assert decontamination.without_benchmark(odd, bench.where("false")).count() == 9


# 5 pieces


def test_encoding_is_the_models_and_decodes(spark, odd, none):
    encoder = pieces.Encoder(MODEL)
    docs = spark.createDataFrame(rows(
        "Hello  world\n x é 漢字 😀 ", "▁ marks ▁▁of its own", " ", "a" * 200, "ab " * 90, " ".join("xy" * 40 for _ in range(9)), None, "", "Ä" * 130,
        start=100,
    ), SCHEMA).union(odd.where("doc_id is null or doc_id <> 7"))
    whole_texts = pieces.encode_documents(docs, MODEL)
    in_chunks = pieces.encode_documents(docs, MODEL, chunk=16)
    assert whole_texts.columns == ["doc_id", "lang", "kept", "row", "a.b", "n_tokens", "score", "ids"]
    back = lambda df: sorted(str((r["doc_id"], r["text"])) for r in pieces.decode_documents(df, MODEL).collect())
    want = sorted(str((r["doc_id"], r["text"] or "")) for r in docs.collect())
    assert back(whole_texts) == want and back(in_chunks) == want
    scores = lambda df: sorted((str(r["doc_id"]), round(r["score"], 3)) for r in df.collect())
    assert scores(whole_texts) == scores(in_chunks)
    for r in docs.where("text <> '' and doc_id >= 100").join(whole_texts.select("doc_id", "score", "ids"), "doc_id").collect():
        ids, score = encoder._long_word(encoder.v.codes(r["text"]))
        assert abs(score - r["score"]) < 1e-6 * abs(score) + 1e-6
    assert pieces.encode_documents(none, MODEL).count() == 0


def test_long_texts_go_in_chunks(spark):
    text = LONG[:70_000] + "é" * 20 + " " * 40
    docs = spark.createDataFrame([(1, text, 4), (1, text, 5)], "doc_id long, text string, n_tokens int")
    got = pieces.decode_documents(pieces.encode_documents(docs, MODEL, chunk=5_000), MODEL).collect()
    assert [r["text"] for r in got] == [text] * 2 and len({tuple(r["ids"]) for r in got}) == 1
    whole_text = pieces.encode_documents(docs, MODEL, chunk=1 << 20).first()
    assert abs(whole_text["score"] - got[0]["score"]) < 1e-3


def test_ids_are_those_of_the_model(spark):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [
        "The quick brown fox jumps over the lazy dog.", "  a  b ", " " * 45 + "x" + " " * 15, "a\tb\nc\x00d", "a" * 200, "xy" * 90,
        "漢字かな交じり文 " * 9, "é" * 30, "<s> <0x0A> <unk>", "price: 1,250.00 EUR (incl. 19% VAT)", LONG[:30_000], "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (7, 16, 1 << 20):
        got = {r["doc_id"]: r["ids"] for r in pieces.encode_documents(docs, MODEL, chunk=chunk).collect()}
        assert got == {i: plain.encode(t or "") for i, t in enumerate(texts)}


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(-9, 9, (3, 4, 4)).astype(float)
    assert np.array_equal(pieces.max_plus(pieces.max_plus(a, b), c), pieces.max_plus(a, pieces.max_plus(b, c)))
    stack = rng.integers(-9, 9, (11, 4, 4)).astype(float)
    step = stack[0]
    for k, prefix in enumerate(pieces.scan(stack)):
        step = step if k == 0 else pieces.max_plus(step, stack[k])
        assert np.array_equal(prefix, step)


# 6 archives


def test_archive_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "<p>é</p>\r\n\r\nWARC/1.1", "x" * 3_000_000, "<p>a</p>"]
    pages = [(i, f"http://e.x/{i} \n", h, 1) for i, h in enumerate(html)] + [(0, "u", "<p>a</p>", 1), (None, None, "<p>z</p>", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, bundle int")
    got = warc.archive_round_trip(df, f"{checkpoint_root(spark)}/warc-test/a", frame_bytes=500, bundle_bytes=300).collect()
    first = {}
    for i, _, h, _ in pages:
        first[h or ""] = min(x for x in (first.get(h or "", i), i) if x is not None) if i is not None else first.get(h or "")
    want = []
    for i, _, h, _ in pages:
        data = (h or "").encode()
        revisit = i is not None and first[h or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    few = warc.archive_round_trip(df, f"{checkpoint_root(spark)}/warc-test/b", min_revisit_bytes=1)
    assert few.where("payload_bytes = 0 and record_type = 'response'").count() == 2
    assert warc.archive_round_trip(df.where("false"), f"{checkpoint_root(spark)}/warc-test/c").count() == 0


def test_records_by_index(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    index = warc.write_archive(pages, f"{checkpoint_root(spark)}/warc-test/d", frame_bytes=2_000)
    assert index.count() == 40 and index.agg(F.max("frame")).first()[0] > 0
    wanted = spark.createDataFrame([(7,), (31,), (99,)], "page_id long")
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.fetch_records(index, wanted).collect()}
    assert got == {f"urn:page:{i}": f"<p>{i}</p>" * 50 for i in (7, 31)}
    import zstandard
    row = index.where("page_id = 31").first()
    fs, path = warc.file_system(row["bundle"])
    with fs.open_input_file(path) as source:
        frame = warc.read_seek_table(source, source.size())[row["frame"]]
        assert frame[:2] == (row["frame_at"], row["frame_bytes"])
        source.seek(row["frame_at"])
        data = zstandard.ZstdDecompressor().decompress(source.read(row["frame_bytes"]))
    assert warc.parse_record(data, row["record_at"])[0]["warc-record-id"] == "<urn:page:31>"


# 7 licenses


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hits = [(i, t.label) for t in licenses.BASE for i in range(len(words)) if words[i : i + len(t.text.split())] == t.text.split()]
    return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))


def test_licenses(spark, odd, none):
    texts = [
        "Released under the MIT License. Under the MIT license!", "licensed under the Apache License, Version 2.0", "CC BY-NC 4.0 cc by nc cc by nc",
        "under the mitt license", "under the MIT licence", None, "", "é under the\nmit\tlicense ü", "cc by", "by nc cc", LONG + " under the mit license",
        "permission is hereby granted free of any charge to any person obtaining a copy of this software",
        "this work is licensed under the gnu general public license version 3", "all rights of mine reserved", "under the KMIT license",
    ]
    got = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    for i, t in enumerate(texts, 1):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[12]["labels"] == "mit" and got[13]["labels"] == "gpl-3" and got[6]["labels"] == "" and got[14]["labels"] == ""
    assert licenses.license_report(odd).count() == 9 and licenses.license_report(none).count() == 0


def test_repeated_notices(spark):
    notice, gpl = "All rights reserved. ", "This work is licensed under the GNU general public license version 3. "
    part = "licensed under the GNU general public license version "
    texts = [notice * n for n in (1, 2, 3, 50)] + [gpl * 5, "x " + part * 3 + gpl + part * 3, "all rights all rights " * 9, "all rights kept reserved " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_report(docs).collect()}
    assert all(got[i] == ("reserved", 1.0) for i in range(4)) and got[4] == got[5] == ("gpl-3", 1.0)
    assert got[6] == got[7] == ("", 0.0)
    found = licenses.scan_licenses(docs)
    spans = [r for r in found[1].join(found[0], "row").where("doc_id = 3 and label = 'reserved'").collect()]
    assert sorted((r["first_word"], r["last_word"]) for r in spans) == [(3 * k, 3 * k + 2) for k in range(50)]


# 8 token counts


def test_token_counts(spark, odd, none):
    counts = token_counts.with_token_count(odd, RANKS)
    encode = token_counts.rank_file_encoder(RANKS)
    lengths = sorted(len(encode(r["text"] or "")) for r in odd.collect())
    assert sorted(r["n_tokens"] for r in counts.collect()) == lengths
    histogram = token_counts.length_histogram(counts)
    for r in histogram.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n) and r["total_tokens"] == n * lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert abs(r["quantile_to"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    limits = [(-1,), (0,), (1,), (2,), (5,), (4096,), (100_000,), (10_000_000,), (None,)]
    cut = token_counts.truncated_totals(histogram, spark.createDataFrame(limits, "context_limit long"))
    want = {(n, sum(x > max(n, 0) for x in lengths), sum(min(x, max(n, 0)) for x in lengths)) for n, in limits[:-1]}
    assert {tuple(r) for r in cut.collect()} == want
    assert token_counts.length_histogram(token_counts.with_token_count(none, RANKS)).count() == 0


# 9 near-duplicates


def plain_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "  \n", "one", "One", "one two three", "one two three", "one two three four", "A b c d e f g h i j k", "a b c d e f g h i j x"]
    for _ in range(6):  # families: copies of copies, many near the limit
        family = [rng.choice(words, int(rng.integers(30, 160))).tolist()]
        for _ in range(45):
            text = list(family[int(rng.integers(len(family)))])
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            family.append(text)
        texts += [" ".join(t) for t in family]
    texts += texts[20:30] * 4
    docs = rows(*texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), shingle=4).collect()}
    want = plain_components([d[:2] for d in docs], 4, 80)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_duplicates_of_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 9 and {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    left = neardup.without_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
    assert neardup.near_duplicates(none).count() == 0 and neardup.without_near_duplicates(none).count() == 0


def test_components_of_long_paths(spark):
    path = spark.range(300).selectExpr("(id * 7919) % 300 AS k").selectExpr("k AS a", "k + 1 AS b")
    assert connected(path).agg(F.max("label"), F.count("*")).first() == (0, 301)
    two = spark.createDataFrame([(5, 3), (3, 5), (9, 9), (8, 5)], "a long, b long")
    assert {tuple(r) for r in connected(two).collect()} == {(5, 3), (3, 3), (9, 9), (8, 3)}


# 10 sharding


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(2)
    for _ in range(40):
        supply = rng.integers(0, 100, int(rng.integers(1, 7))).tolist()
        room = sharding.even_capacities(sum(supply), int(rng.integers(1, 9)))
        flow = sharding.cheapest_flow(supply, room)
        assert [sum(a) for a in flow] == supply and [sum(a[j] for a in flow) for j in range(len(room))] == room
        stays = sum(min(s, r) for s, r in zip(supply, room, strict=False))
        assert sharding.moved_bytes(flow) == sum(supply) - stays


def test_shards(spark, odd, none):
    rng = np.random.default_rng(4)
    texts = [None if i % 50 == 0 else "x" * int(rng.integers(0, 400)) for i in range(700)]
    docs = spark.createDataFrame([(i, t, "hot" if i % 3 else f"s{i % 7}", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, slot int")
    old = F.pmod(F.hash("source"), F.lit(5))
    out = sharding.reshard(docs, old, 5, n_new=8)
    assert out.columns == ["doc_id", "text", "source", "slot", "shard"]
    per = out.groupBy("shard").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 8).alias("b"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("k")).collect()
    assert sorted(r["shard"] for r in per) == list(range(8))
    assert max(r["b"] for r in per) - min(r["b"] for r in per) <= 408
    assert all((r["lo"], r["hi"], r["k"]) == (0, r["n"] - 1, r["n"]) for r in per)
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(i, t or "") for i, t in enumerate(texts)]
    again = sharding.reshard(docs, old, 5, n_new=8)
    assert sorted(map(tuple, again.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, out.select("doc_id", "shard", "slot").collect()))


def test_only_touched_shards_are_written(spark):
    docs = spark.createDataFrame([(i, "x" * 92, i % 3) for i in range(300)], "doc_id long, text string, old int")
    out = sharding.reshard(docs, F.col("old"), 3, n_new=3, capacities=[5000, 15000, 10000], affected_only=True)
    assert {r["shard"]: r["count"] for r in out.groupBy("shard").count().collect()} == {0: 50, 1: 150}


def test_shards_of_odd_rows(odd, none):
    out = sharding.reshard(odd, F.lit(None), 4, n_new=3)
    assert out.count() == 9 and set(odd.columns) <= set(out.columns)
    assert sharding.reshard(none, F.lit(0), 4, n_new=3).count() == 0
