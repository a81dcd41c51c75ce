"""Collocations, URL rules and hard negatives against plain versions, odd rows included."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import collocations, hard_negatives, url_rules


def plain_collocations(rows, top, least):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    counts[lang, tuple(words[i : i + d])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], a)
    by_lang = {}
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, each in by_lang.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(each)[:top], 1)
    )


@pytest.fixture(scope="module")
def phrases():
    rnd = random.Random(3)
    vocabulary = ["the", "The", "a", "naïve", "ÉTÉ", "x y", "b" * 3000, "of", "cat", "mat"]
    passage = "on the mat sat a cat of naïve size"
    rows = []
    for _ in range(300):
        lang = rnd.choice(["en", "en", "fr", None, "und", ""])
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))]
        rows.append((lang, "".join(w + rnd.choice([" ", " ", "\t ", ". ", "\n", "\r", ", "]) for w in words) + (passage if rnd.random() < 0.4 else "")))
    rows += [("en", None), (None, None), ("en", ""), ("fr", "...;"), ("en", passage)] * 4
    rows.append(("en", "the cat " * 100_000))
    return rows


@pytest.mark.parametrize(("budget", "bits"), [(1 << 20, 25), (50, 15)])
def test_collocations_equal_plain_counts(spark, phrases, budget, bits):
    docs = spark.createDataFrame([(x, t, "other") for x, t in phrases], "lang string, text string, k1 string").repartition(5)
    got = collocations.collocations(docs, top=25, least=8, filter_bits=bits, budget=budget)
    want = plain_collocations(phrases, 25, 8)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == want
    assert len(want) > 40


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "two words")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_groups_keep_the_budget_and_split_what_passes_it():
    sizes = {0: 40, 1: 30, 2: 50, 3: 250, 4: 10}
    base, split, n = collocations.group_plan(sizes, 100)
    loads = Counter()
    for c, size in sizes.items():
        for k in range(int(split[c])):
            loads[int(base[c]) + k] += size / split[c]
    assert max(loads.values()) <= 100 and max(loads) < n
    assert split[3] == 3 and all(split[c] == 1 for c in (0, 1, 2, 4))
    assert len({int(base[3]) + k for k in range(3)} & {int(base[c]) for c in (0, 1, 2, 4)}) == 0


def test_subtrees_count_common_prefixes():
    leaves = np.array([[1, 1, 1, 2], [5, 5, 6, 5], [0, 7, 7, 7], [0, 8, 0, 8]], dtype=np.int64)
    nodes = {(d, int(i)): int(a) for d, first, totals in collocations.subtree_counts(leaves, np.array([4, 3, 2, 1])) for i, a in zip(first, totals, strict=True)}
    assert nodes == {(2, 0): 7, (2, 2): 2, (2, 3): 1, (3, 1): 3, (3, 2): 2, (3, 3): 1, (4, 1): 3, (4, 3): 1}


def plain_tokens(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    labels, page = host.split("."), path.rsplit("/", 1)[-1]
    query = re.match(r"[^?#]*\?([^#&=]*)", url)
    first = re.match("/([^/]+)/", path)
    values = {
        "tld": labels[-1], "site": ".".join(labels[-2:]) if len(labels) > 1 and all(labels[-2:]) else "", "name": labels[0] if len(labels) > 1 else "",
        "host": host, "dir": first[1] if first else "", "page": ("number" if re.match(r"[0-9]+(\.|$)", page) else "word") if page else "folder" if path.endswith("/") else "",
        "ext": page.rsplit(".", 1)[1] if "." in page else "", "query": query[1] if query else "", "mark": "yes" if "#" in url else "",
    }
    return host, path, frozenset(f"{k}:{v}" for k, v in values.items() if v)


def plain_verdicts(urls, least, confidence):
    known, judged = [], []
    for url in urls:
        host, path, tokens = plain_tokens(url)
        fits = [r for r in url_rules.BASE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        judged.append((host, path, rule, tokens))
        if rule:
            known.append((tokens, rule.verdict))
    both, alone = Counter(), Counter()
    for tokens, verdict in known:
        ordered = sorted(tokens)
        for m in range(1, 1 << len(ordered)):
            part = frozenset(t for i, t in enumerate(ordered) if m >> i & 1)
            alone[part] += 1
            both[part, verdict] += 1
    rules = {(p, v): n / alone[p] for (p, v), n in both.items() if n >= least and n / alone[p] >= confidence}
    rules = {(p, v): c for (p, v), c in rules.items() if not any(q < p and w == v and d >= c for (q, w), d in rules.items())}
    out = []
    for host, path, rule, tokens in judged:
        fit = min(((-c, -both[p, v], len(p), ",".join(sorted(p)), v) for (p, v), c in rules.items() if p <= tokens), default=None)
        verdict = rule.verdict if rule else fit[4] if fit else "allow"
        out.append((host, path, rule.name if rule else None, verdict))
    return out


def test_url_verdicts_equal_plain_rules(spark):
    rnd = random.Random(5)
    urls = [None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.COM/en/x", "http://com", "http://com/", "http://xcom/", "http://a.net/es", "http://a.net/es/?q#f",
            "http://example.com/en/" + "deep/" * 50_000, "http://a.com/de?u=http://b.net/es/", "http://b.org/\n/x", "http://.com/", "http://İ.example.com/en/1.html"] * 2
    for _ in range(600):
        host = rnd.choice(["a.", "b.", "www.", ""]) + rnd.choice(["example.com", "example.net", "example.org", "shop.net"])
        urls.append(f"https://{host}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.randrange(5)}{rnd.choice(['', '.html', '/', '?page=2', '#top'])}")
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, verdict string, token string")
    got = url_rules.judge_urls(pages, min_support=0.02)
    rows = sorted((r["page"]["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect())
    n = sum(r[3] is not None for r in rows)
    want = plain_verdicts(urls, max(math.ceil(0.02 * n), 10), 0.6)
    assert rows == [(i, *w) for i, w in enumerate(want)]
    assert got.where("rule is null and verdict = 'block'").count() > 20
    assert set(got.schema["page"].dataType.names) == {"page_id", "url", "verdict", "token"}


def test_urls_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_rules.url_report(pages).collect()] == ["allow"] * 3
    assert url_rules.url_report(pages.limit(0)).count() == 0


def plain_negatives(rows):
    v = []
    for i, e, y in rows:
        if i is None or e is None or y is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((i, [math.floor(256 * float(x)) for x in e], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for at, (i, e, y) in enumerate(v):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(e, f, strict=False)), j, z) for k, (j, f, z) in enumerate(v) if k != at]
        for p, j, _ in sorted(s for s in scored if s[2] == y)[:5]:
            close = sorted((s, k) for s, k, z in scored if z != y and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(close, 1)]
    return sorted(out)


@pytest.fixture()
def vectors():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8)) * 0.3
    rows = [(i, (centers[i % 6] + rng.normal(size=8) * 0.1).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    rows += [(2000 + i, [0.5] * 8, i % 3) for i in range(300)]  # equal vectors
    rows += [(100, rows[100][1], rows[100][2])] * 3 + [(3000, None, 1), (3100, [0.1] * 8, None), (3200, [float("nan")] * 8, 1), (3300, [None] * 8, 1)]
    rows += [(3400, [float("inf")] * 8, 1), (3500, [], 1), (3600, [0.3] * 3, 2), (None, [0.1] * 8, 1), (3700, [-0.4] * 8, 9), (-100, [0.2] * 8, 1)]
    return rows


def test_hard_negatives_equal_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "GROUP_BLOCKS", 4)
    monkeypatch.setattr(hard_negatives, "SHARE", 5)
    monkeypatch.setattr(hard_negatives, "REQUEST", 3)
    df = spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, embedding array<double>, label int, grp string").repartition(4)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect())
    want = plain_negatives(vectors)
    assert got == want and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df).count() == 0
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_bounds_enclose_every_score_and_exclude_blocks():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 4)) * 300).astype(np.int64)
    order = sorted(range(len(x)), key=hilbert_order(x).__getitem__)
    blocks = [x[order[at : at + 50]] for at in range(0, len(x), 50)]
    low, high = np.array([b.min(axis=0) for b in blocks]), np.array([b.max(axis=0) for b in blocks])
    least, most = hard_negatives.score_bounds(x[:40], low, high)
    scores = [hard_negatives.product(x[:40], b) for b in blocks]
    assert all((s.min(axis=1) >= least[:, k]).all() and (s.max(axis=1) <= most[:, k]).all() for k, s in enumerate(scores))
    best = np.array([s.max(axis=1) for s in scores]).max(axis=0)
    assert (most >= best[:, None]).mean() < 0.5  # most blocks need not be read


def hilbert_order(x):
    return hard_negatives.hilbert_keys(x)


def test_curve_visits_neighbours():
    grid = np.array([(a, b) for a in (-200, -60, -20, -5, 5, 20, 60, 200) for b in (-200, -60, -20, -5, 5, 20, 60, 200)])
    keys = hard_negatives.hilbert_keys(grid, bits=3)
    cell = ((0.5 + 0.5 * grid / (np.abs(grid) + 32.0)) * 8).astype(int)
    path = sorted(zip(keys, map(tuple, cell.tolist()), strict=True))
    steps = [abs(p[1][0] - q[1][0]) + abs(p[1][1] - q[1][1]) for p, q in zip(path, path[1:], strict=False) if p[1] != q[1]]
    assert len(set(keys)) == len({p[1] for p in path}) and (max(steps) == 1 or len(set(keys)) < 64)


def test_large_numbers_stay_exact_or_stop():
    a = np.array([[1 << 28, 3]], dtype=np.int64)
    assert hard_negatives.product(a, a).tolist() == [[(1 << 56) + 9]]
    with pytest.raises(OverflowError):
        hard_negatives.product(a << 8, a << 8)
