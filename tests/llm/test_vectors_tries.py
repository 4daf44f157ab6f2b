"""Prefix tries, vector codes and exact top-k against plain searches."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidebar.llm import codes, topk, trie

TALK = "conv_id long, turn long, role string, text string, base int, depth int, ids string"
VECTORS = "vec_id long, embedding array<double>, label string, code int, score int, rank int"


def plain_trie(rows):
    whole = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            whole[c].append(((turn is not None, turn or 0), role or "", text or ""))
    whole = {c: [t[1:] for t in sorted(v)] for c, v in whole.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        h = zlib.crc32(str(c).encode()) % 6
        told = whole.get(c - int(math.fmod(c, 100)), [])[:h] + whole[c][h:]
        for d in range(len(told) + 1):
            members[tuple(told[:d])].append(c)
        ends[tuple(told)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (own[0], len(n), members[n[:-1]][0] if n else None, len(own), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, own in members.items()
    )


def talks(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([turn, turn, turn, 3, None]) if longest < 20 else turn, rng.choice(["user", None, "a"]), rng.choice(["x", "yé", "", None, "long text"])))
    return rows


@pytest.mark.parametrize("stretch", [1024, 4, 6])
def test_tries_against_a_plain_one(spark, monkeypatch, stretch):
    """Null and repeated turns, null text, missing bases, negative ids, and conversations longer than a stretch."""
    monkeypatch.setattr(trie, "PART", stretch)
    monkeypatch.setattr(trie, "JOINED", 2)
    ids = [*range(-230, 30, 3), *range(100, 130), *range(205, 230), 400, 401]
    rows = talks(1, ids, 9) + talks(2, [500, 501, 502], 40) + [(None, 1, "user", "x"), (7000, 1, "user", "same"), (7000, 1, "user", "same"), (7001, 2, "user", "same")]
    rows += [(c, t, "user", "common") for c in range(8000, 8400) for t in range(3)]
    table = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], TALK).repartition(3)
    found = sorted((tuple(r) for r in trie.prefix_trie(table).collect()), key=str)
    assert found == sorted(plain_trie(rows), key=str)


def test_a_trie_of_nothing_has_no_root(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALK)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, 2, "z")], TALK)).collect() == []


def odd_vectors(n, dim, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (spread * rng.standard_normal(dim)).tolist(), str(i % 3) if i % 5 else None) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same, "0") for i in range(40)]  # copies
    rows += [(n + 100, [0.0] * dim, "z"), (3, rows[4][1], "again"), (50, rows[9][1], "again")]
    bad = [(n + 200, None), (n + 201, [None] * dim), (n + 202, [math.nan] * dim), (n + 203, [math.inf] + [0.0] * (dim - 1)), (n + 204, []), (n + 205, [1.0]), (n + 206, [1e300] * dim)]
    return rows, [(*b, "bad") for b in bad]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in rows], dtype=object)
    cut = np.split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cut]

    def near(part, book):
        away = np.stack([((part - e) ** 2).sum(1) for e in book], 1).astype(np.int64)
        return away.argmin(1), away.min(1)

    for _ in range(rounds):
        for p in range(parts):
            code, _ = near(cut[p], books[p])
            for k in range(len(books[p])):
                own = cut[p][code == k]
                if len(own):
                    books[p][k] = [int(s) // len(own) for s in own.sum(0)]
    found = [near(cut[p], books[p]) for p in range(parts)]
    code = ["".join(f"{found[p][0][i]:02x}" for p in range(parts)) for i in range(len(rows))]
    error = [int(sum(found[p][1][i] for p in range(parts))) for i in range(len(rows))]
    labels = defaultdict(int)
    for r, e in zip(rows, error):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], c, e, labels[r[2]], digest) for r, c, e in zip(rows, code, error)), key=str)


@pytest.mark.parametrize(("n", "dim"), [(700, 12), (60, 8), (300, 4)])
def test_codes_against_plain_means(spark, n, dim):
    """Copies, repeated and null ids, null labels, fewer rows than entries; odd vectors take no part."""
    good, bad = odd_vectors(n, dim)
    good.append((None, good[0][1], None))
    found = codes.compress(frame(spark, good + bad))
    assert sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == plain_codes(good)


def test_codes_of_nothing(spark):
    assert codes.compress(frame(spark, odd_vectors(10, 4)[1][:5])).collect() == []
    assert codes.compress(frame(spark, [])).collect() == []


@pytest.mark.parametrize("width", [1, 3, 16])
def test_bounds_never_lose_an_entry(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-400, 400, (256, width))
    entries[9] = entries[3]
    parts = np.concatenate([rng.integers(-400, 400, (3000, width)), entries, rng.integers(-(2**27), 2**27, (50, width))])
    code, error = codes.assign(parts, entries)
    full = ((parts[:, None] - entries[None]) ** 2).sum(-1)
    assert (code == full.argmin(1)).all() and (error == full.min(1)).all()


def plain_products(rows, k=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None]
    out = []
    for q, a in kept:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("part", "sample"), [(64 << 20, 64), (200, 4)])
def test_products_against_a_plain_search(spark, monkeypatch, part, sample):
    """Copies and ties, repeated ids, null ids, several parts of queries, vectors of another length and zero vectors."""
    monkeypatch.setattr(topk, "PART_BYTES", part)
    monkeypatch.setattr(topk, "SAMPLE", sample)
    monkeypatch.setattr(topk, "SHELF", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    good, bad = odd_vectors(601, 12)
    good += [(None, good[0][1], None), (10_000, [5.0], "short"), (10_001, [2.0], "short")]
    found = topk.search_fiftieths(frame(spark, good + [b for b in bad if b[1] != [1.0]]))
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == plain_products(good)


def test_products_of_nothing(spark):
    assert topk.search_fiftieths(frame(spark, [])).collect() == []
    assert topk.search_fiftieths(frame(spark, [(0, [1.0, 2.0], "x")])).collect() == []


def test_blocks_out_of_reach_are_not_scored():
    """Where blocks differ in length, a query leaves after the blocks that can matter, and large numbers stay exact."""
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (64 * 20, 8))
    x[640:704] *= 40
    ids, starts = np.arange(len(x)), np.arange(0, len(x), 64)
    queries = rng.integers(-20, 20, (30, 8))
    for scale in (1, 2**19):
        best = topk.Best(30, 5, np.full(30, np.iinfo(np.int64).min))
        own = x * scale
        scored = topk.search_shelf(ids, own, np.maximum.reduceat(own, starts), np.minimum.reduceat(own, starts), np.full(30, -1), queries * scale, best)
        full = (queries * scale) @ own.T
        for q in range(30):
            order = np.lexsort((ids, -full[q]))[:5]
            assert best.ids[q].tolist() == order.tolist() and best.scores[q].tolist() == full[q][order].tolist()
        assert scored < 30 * 20 / 2
