"""Licence scan, ranked search and vector codes against brute force, with nulls, ties, repeats, long and empty texts, and clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from guardspark.llm import license_scan, ranked_search, vector_codes
from guardspark.llm.license_templates import NOTICES, PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# 11


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def brute_matches(scanner, words):
    """All maximal matches by template, from every pair of places."""
    out = {}
    for t, template in enumerate(scanner.templates):
        found, n = [], len(template.words)
        for at in range(1, len(words) + 1):
            for end in range(1, n + 1):
                size = 0
                while size < min(at, end) and words[at - 1 - size] and words[at - 1 - size] == template.words[end - 1 - size]:
                    size += 1
                if size >= template.need and not (at < len(words) and end < n and words[at] == template.words[end]):
                    found.append((at, end, size))
        if found:
            out[t] = sorted(found)
    return out


def brute_cover(matches):
    """Most template words that a chain covers, over all chains by all pairs."""
    best = {}
    for m in matches:
        at, end, size = m
        best[m] = size
        for p in matches:
            if p == m or p not in best:
                continue
            behind, below = at - size - p[0], end - size - p[1]
            if behind <= license_scan.GAP and below <= license_scan.GAP and p[0] < at and p[1] < end and p[0] - p[2] <= at - size and p[1] - p[2] <= end - size:
                best[m] = max(best[m], best[p] + size - max(0, -behind, -below))
    return max(best.values(), default=0)


def test_matching_statistics_and_chains():
    scanner, draw = license_scan.Scanner(), random.Random(1)
    for _ in range(40):
        words = []
        while len(words) < 120:
            t = draw.choice(scanner.templates)
            a = draw.randrange(len(t.words))
            words += t.words[a : a + draw.randint(1, 14)]
            if draw.random() < 0.4:
                words += [0] * draw.randint(1, 12)
        got = scanner.matches(np.array(words, np.int32))
        want = brute_matches(scanner, words)
        assert {t: sorted((m.at, m.end, m.size) for m in ms) for t, ms in got.items()} == want
        for t, ms in got.items():
            assert max(m.covered for m in scanner.chained(ms)) == brute_cover([(m.at, m.end, m.size) for m in ms])


def test_license_scan(spark):
    mit = next(t for k, t in NOTICES if k == "mit")
    bent = mit.split()
    bent[20:22] = ["other", "words"]
    texts = [
        "The MIT License, the mit\nlicense and GNU General  Public License.", mit.upper(), "x " + " ".join(bent) + " y", " ".join(mit.split()[:30]), None, "", " -- ", "Über CC-BY 4.0, CC BY-NC", "mitlicense mit; license Mit LICENSE",
        "apache licenses", "gnu general public", "word " * 200_000 + "Apache License", "permission is hereby granted to nobody",
    ]
    rows = [(k // 2 if k < 4 else None if k == 5 else k, t, "clash", "l") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, licenses string, label string").repartition(3)
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) and got[0].asDict().keys() == {"doc_id", "licenses", "label", "licenses_"}
    found = {(r.doc_id, r.licenses_.n_words): r.licenses_ for r in got}
    phrases = [(k, p.split()) for k, p in PHRASES]
    for (i, text, *_), expected in zip(rows, ["gpl,mit", "mit", "mit", "", "", "", "", "cc-by,cc-by-nc", "mit", "", "", "apache", ""], strict=True):
        words = words_of(text)
        r = found[i, len(words)]
        places = sorted((a, k) for k, p in phrases for a in range(len(words) - len(p) + 1) if words[a : a + len(p)] == p)
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in places})) and r.labels == expected and 0 <= r.score <= 1
        assert all(s.last < len(words) for s in r.spans)
    assert found[1, len(words_of(texts[2]))].score > 0.8 and found[1, len(words_of(texts[3]))].score < 0.8
    assert license_scan.scan(docs.where("false")).count() == 0


def test_many_licences_cost_their_length():
    scanner = license_scan.Scanner()
    notice = next(t for k, t in NOTICES if k == "bsd").encode()
    start = time.process_time()
    out = scanner.scan(notice * 400)
    once = time.process_time() - start
    assert len(out["spans"]) == 400 and out["labels"] == "bsd"
    start = time.process_time()
    scanner.scan(notice * 1600)
    assert time.process_time() - start < 12 * max(once, 0.05)


# 12


def brute_search(items, docs, top=10):
    counts = {k: Counter(TERM.findall((t or "").translate(UPPER))) for k, (_, t) in enumerate(docs)}
    counts = {k: c for k, c in counts.items() if c}
    n, length = len(counts), sum(sum(c.values()) for c in counts.values())
    out = []
    for item, text in items:
        total = {}
        for term in set(TERM.findall((text or "").translate(UPPER))):
            df = sum(term in c for c in counts.values())
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            for k, c in counts.items():
                if term in c:
                    m = 10 + 90 * sum(c.values()) * n // length
                    total[k] = total.get(k, 0) + w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
        order = sorted(((-s, docs[k][0] is None, docs[k][0]) for k, s in total.items() if s > 0))[:top]
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(order, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings,grain", [(30, 1), (500, 2), (2_000_000, 8)])
def test_search_is_exact(spark, monkeypatch, postings, grain):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "GRAIN", grain)
    monkeypatch.setattr(ranked_search, "FIRST_LOOK", 3)
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 25 if grain == 1 else 10_000)
    draw = random.Random(grain)
    words = [f"w{k}" for k in range(30)] + ["Zeit", "É", "日本", "x9", "don't"]
    docs = [(k, " ".join(draw.choice(words[: draw.randint(1, 35)]) for _ in range(draw.choice([1, 5, 40, 300])))) for k in range(150)]
    docs += [(500, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (600, None), (601, ""), (602, "..."), (2**63 - 1, "w1 " * 30_000), (-5, docs[7][1])]
    items = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 25)))) for k in range(8)] + [(3, "W1 w1 É, zeit"), (None, "w2"), (20, None), (21, "-"), (22, "nowhere")]
    d = spark.createDataFrame([(*r, "a", 1) for r in docs], "doc_id bigint, text string, item string, score int").repartition(4)
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, rank int")
    got = sorted(map(tuple, ranked_search.search(i, d).collect()), key=str)
    # Equal ids and texts are interchangeable.
    assert got == brute_search(items, docs)
    assert ranked_search.search(i, d.where("false")).count() == 0 and ranked_search.search(i.where("false"), d).count() == 0


def test_blocks_minimise_their_error(monkeypatch):
    """Borders against all cuts, and bounds that skip."""
    monkeypatch.setattr(ranked_search, "GRAIN", 1)
    draw = np.random.Generator(np.random.PCG64(2))
    for n in range(1, 11):
        impacts = draw.integers(0, 5_000_000, n)
        cost = lambda cuts: sum((impacts[a:b].max() * (b - a) - impacts[a:b].sum()) + ranked_search.BLOCK_COST for a, b in zip(cuts[:-1], cuts[1:], strict=True))  # noqa: B023, E731
        ways = [[0, *(k for k in range(1, n) if mask >> k & 1), n] for mask in range(0, 1 << n, 2)]
        assert cost(ranked_search.block_borders(impacts).tolist()) == min(map(cost, ways))


def test_search_skips_blocks():
    """Short documents win, and most postings of long ones aren't read; where bounds are alike everywhere, all is read and right."""
    import pyarrow as pa

    n, terms = 20_000, 5
    query, weights = np.arange(1, terms + 1), np.full(terms + 1, 1000)
    own = np.random.Generator(np.random.PCG64(3)).integers(1, terms + 1, n)
    shard = ranked_search.Shard.build(pa.array(np.arange(n)), np.arange(10, n + 10), np.full(n, 1), own, np.full(n, 1), terms + 1)
    row, score = shard.search(query, weights, 10)
    assert row.tolist() == list(range(10)) and score.tolist() == [1000 * (10**9 // (1000 + 8 * (k + 10))) for k in range(10)]
    assert shard.read < n / 5
    sizes = np.full(n, 1)
    sizes[::2000] = terms
    parts = [query if s == terms else np.array([t]) for s, t in zip(sizes, own, strict=True)]
    shard = ranked_search.Shard.build(pa.array(np.arange(n)), np.full(n, 100), sizes, np.concatenate(parts), np.full(sizes.sum(), 1), terms + 1)
    assert sorted(shard.search(query, weights, 10)[0].tolist()) == list(range(0, n, 2000))


# 13


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(x)) if abs(x) < 1e300 else int(x) * 1024 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in kept] + [1]) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    deep = width // parts
    cut = lambda v, p: v[p * deep : (p + 1) * deep]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(f for f, _ in found), lab))
    sums = Counter()
    for _, _, e, lab in out:
        sums[lab] += e
    most = 2**63 - 1
    return sorted(((i, c, min(e, most), min(sums[lab], most), sha) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e30])
def test_codes(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_codes, "ENTRIES", 12)
    draw = random.Random(7)
    rows = [(k, [draw.choice([-1, 0, 0.5, draw.gauss(0, 1)]) * scale for _ in range(10)], draw.choice([0, 1, None])) for k in range(90)]
    rows += [(5, rows[5][1], 1), (5, [-x for x in rows[5][1]], 1), (None, [1.0] * 10, None), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 10, 1), (203, [float("inf")] * 10, 1)]
    rows += [(204, [], 0), (205, [scale], 0), (206, [scale] * 11, 0), (2**62 + 1, rows[3][1], 0)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, n int").repartition(5)
    got = vector_codes.compress(df).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows, entries=12)
    assert vector_codes.compress(df.where("false")).count() == 0 and vector_codes.compress(df.where("vec_id = 200")).count() == 0
    few = vector_codes.compress(df.where("vec_id < 3")).collect()
    assert sorted(map(tuple, few), key=str) == brute_codes([r for r in rows if r[0] is not None and r[0] < 3], entries=12)


def test_tree_keeps_lower_indices():
    """Equal entries and equal distances: the lowest index, in 64 bits and beyond."""
    draw = np.random.Generator(np.random.PCG64(5))
    for kind in (np.int64, object):
        book = draw.integers(-2, 3, (200, 3)).astype(kind)
        parts = draw.integers(-3, 4, (300, 3)).astype(kind)
        index, far = vector_codes.KdTree(book).nearest(parts)
        apart = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (far == apart.min(1)).all() and (index == apart.argmin(1)).all()
    assert [sum(x << 32 * k for k, x in enumerate(vector_codes.limbs(v, 4))) for v in (-1, 0, 5, -(2**90), 2**100 + 7)] == [-1, 0, 5, -(2**90), 2**100 + 7]
