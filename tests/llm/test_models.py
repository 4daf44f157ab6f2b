"""Models trained here: base patterns by the book, held-out quality, exact round trips, recall and packing."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import ann, bpe, chat, pii, queries, recurrent, shards, toxicity

from .conftest import corpus

DATA = "/root/testdata/sf0.01"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def book_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or luhn % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_by_the_book():
    rng, pieces = random.Random(1), ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "@", ".", "1", "-", "+", " ", "x", "é", "256.1.1.1.1", "1.2.3.4.5.6", "a@b", "b..c", "12345678901237"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == book_spans(text), text


def test_personal_data_report(spark, docs, empty):
    extra = spark.createDataFrame([(90, "write to jo.doe@mail.example or 10.0.0.1", "x", 1), (91, "x" * 200_000 + " a@b.cd", "x", 1)], docs.schema)
    every = docs.unionByName(extra)
    got = {r.doc_id: r for r in pii.pii_report(every).collect()}
    assert (got[90].n_email, got[90].n_ip) == (1, 1) and got[91].n_email == 1
    for i, text in [*corpus(), (90, "write to jo.doe@mail.example or 10.0.0.1")]:
        if i is not None:
            said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in book_spans(text or ""))
            assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert pii.pii_report(empty).collect() == []
    found = pii.redact(pii.find_pii(every.where("doc_id = 90"), b""))
    assert found.first().redacted == "write to [email] or [ip]" and "score" in found.columns


def test_network_finds_what_the_patterns_miss():
    rows = [t for (t,) in duckdb.sql(f"SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE regexp_matches(text, '[0-9]') ORDER BY md5(text) LIMIT 2100").fetchall()]
    cut = 2 * len(rows) // 3
    net = pii.Tagger(pii.train([w for t in rows[:cut] for w in pii.text_windows(t)]))
    rng = np.random.default_rng(3)
    found = total = 0
    for text in rows[cut:]:
        for start, kind, end in pii.base_spans(text)[:3]:
            other = pii._variant(kind, text[start:end], rng)
            if other:
                changed = text[:start] + other + text[end:]
                if not any(s < start + len(other) and e > start for s, _, e in pii.base_spans(changed)):
                    _, added = pii.find_spans(net, [changed])
                    total += 1
                    found += any(s < start + len(other) and e > start for s, _, e in added[0])
    assert total >= 15 and found / total > 0.5, (found, total)


def full_paths(net, texts):
    """Best paths by the whole search over whole texts, from the same stitched emissions."""
    every = pii.Emissions(net, texts)
    e = np.empty((pii.LABELS, len(every.flat)), np.float32)
    for place, at, found in every.over(0, len(every.flat)):
        e[:, place] = found[:, at]
    out = []
    for low, high in zip(every.offsets[:-1], every.offsets[1:]):
        if high > low:
            out.append(net._viterbi(np.ascontiguousarray(e[:, low:high].T)[:, None], np.ones((high - low, 1), bool), np.array([False]))[0])
    return np.concatenate(out)


@pytest.mark.filterwarnings("error")
def test_states_of_scoring_are_those_of_training():
    """One exponential for all gates, gate by gate in memory, also where it overflows; states go where they are asked for."""
    rng = np.random.default_rng(2)
    table, u = rng.normal(0, 2, (130, 32)).astype(np.float32), rng.normal(0, 1, (8, 32)).astype(np.float32)
    table[3], table[4] = 400, -400
    codes = rng.integers(0, 130, (50, 7))
    codes[10:13], codes[20:22] = 3, 4
    states = np.full((16, 50, 7), np.nan, np.float32)
    recurrent.lstm_run(table, codes, u, states[:8])
    recurrent.lstm_run(table, codes[::-1], u, states[8:, ::-1])
    assert np.abs(states[:8].transpose(1, 2, 0) - recurrent.lstm(table, codes, u)[0]).max() < 1e-5
    assert np.abs(states[8:].transpose(1, 2, 0) - recurrent.lstm(table, codes[::-1], u)[0][::-1]).max() < 1e-5


def test_pruned_search_is_the_whole_one(monkeypatch):
    """Over weights that make many runs, over texts shorter and longer than windows and blocks, and where windows meet."""
    rng = np.random.default_rng(5)
    say = lambda n: "".join(rng.choice(list("ab1.2@ +-x"), n))
    texts = [say(n) for n in (3, 700, 0, 768, 769, 2000, 5000)]
    some = 0
    for trial in range(12):
        net = pii.Tagger()
        for k, v in net.p.items():
            net.p[k] = (v + rng.standard_normal(v.shape) * (0.3 + 0.3 * (trial % 3))).astype(np.float32)
        net.p["bias"][0] += trial / 4 - 2
        labels, _ = pii.label_texts(net, texts)
        truth = full_paths(net, texts)
        assert (labels == truth).all()
        some += int(labels.any())
        with monkeypatch.context() as m:
            m.setattr(pii, "BLOCK", 1000)
            assert (pii.label_texts(net, texts)[0] == truth).all()
    assert some >= 6
    # a text of one window: the path of that window alone
    e = net.scores(pii.symbols(texts[1].ljust(768))[None])[:, :700]
    alone = net._viterbi(e.transpose(1, 2, 0), np.ones((700, 1), bool), np.array([False]))[0]
    assert (pii.label_texts(net, [texts[1]])[0] == alone).all()


def test_tagger_gradients():
    rng = np.random.default_rng(1)
    net = pii.Tagger()
    x, y = rng.integers(0, pii.SYMBOLS, (3, 7)), rng.integers(0, pii.LABELS, (3, 7))
    _, grads = net.loss_gradients(x, y)
    for name, at in (("out", (2, 3)), ("trans", (1, 2)), ("u0", (1, 5)), ("t1", (int(x[0, 0]), 4)), ("begin", (2,))):
        kept, sides = net.p[name].copy(), []
        for step in (1e-2, -1e-2):
            net.p[name] = kept.copy()
            net.p[name][at] += np.float32(step)
            sides.append(net.loss_gradients(x, y)[0])
        net.p[name] = kept
        assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-2, abs=2e-3)


def test_learning_draws_from_whole_texts_and_copies_count_once(spark):
    far = "x" * 60_000 + " write to jo.doe@mail.example now"
    assert any(group == 0 for group, _, _ in pii.text_windows(far))
    docs = spark.createDataFrame([(i, far) for i in range(50)] + [(100, "call +1 555 123 4567 or 10.0.0.1")], "doc_id long, text string")
    assert pii.fit(docs) is not None


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(F.broadcast(labels.where("toxic is not null").select("doc_id", "toxic")), "doc_id").where(~toxicity.learnable(F.col("doc_id")))
    weights = toxicity.fit(docs, labels)
    rows = toxicity.score(known, weights).select("toxic", "score").collect()
    truth, said = np.array([r.toxic for r in rows]), np.array([r.score for r in rows]) >= toxicity.THRESHOLD
    assert said[truth == 1].mean() > 0.9 and said[truth == 0].mean() < 0.05


def test_toxicity_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 60)] + [(5, None, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.toxicity_report(empty, labels).collect() == []
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in toxicity.toxicity_report(docs, none).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {1}
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_nearest_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[50] = x[51] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(901, None, 0), (902, [0.0] * 24, 0), (903, [float("nan")] * 24, 0), (904, [None] * 24, 0), (1000, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    got = ann.search_hundredths(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    recall, wide = [], x.astype(float)
    for q in range(0, 900, 100):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r.score, r.vec_id))
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in own)
        recall.append(len({r.vec_id for r in own} & set(best.tolist())) / 10)
    assert np.mean(recall) >= 0.9
    again = [(100, x[5].tolist(), 0), (100, x[5].tolist(), 0), (100, x[6].tolist(), 0)]
    twice = ann.search_hundredths(spark.createDataFrame(rows + again, "vec_id long, embedding array<float>, label int")).where("query_id = 100").collect()
    by_rank = sorted(r.rank for r in twice)
    assert by_rank == sorted([*range(1, 11)] * 3)  # three different vectors of one id, the repeated row asked once
    monkeypatch.setattr(ann, "PART_BYTES", 300)  # many parts of queries
    parted = ann.search_hundredths(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    assert sorted(parted) == sorted(got)
    assert ann.search_hundredths(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_tokens_are_those_of_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    odd = ["".join(rng.choice(["a", "B", "1", " ", "  ", "\n", "'s", "é", "漢", "😀", " ", "\x1c", " ", "<|endoftext|>", "!", "'", "\r\n", "the ", "tion"]) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    done = bpe.decode(bpe.encode(rows, path), path).collect()
    for r in done:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    report = {r.doc_id: r for r in bpe.round_trip_report(rows, path).collect()}
    r = done[0]
    assert report[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() or r.doc_id in (41, None)
    assert bpe.round_trip_report(empty, path).collect() == [] and "score" in bpe.encode(docs, path).columns


def test_snapshots_collapse(spark):
    turns = [("a", "hi"), ("b", "hello"), ("a", "how"), ("b", "fine")]
    rows = [(c, k, *turns[k]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for k in range(n)]
    rows += [(5, 0, "a", "hi"), (5, 1, "b", "else"), (6, None, None, None), (7, 0, "a", "hi"), (7, 0, "a", "hi"), (None, 0, "z", "alone")]
    rows += [(8, k, "u", str(k)) for k in range(600)] + [(9, k, "u", str(k)) for k in range(599)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(2, 4), (5, 2), (6, 1), (8, 600), (None, 1)}
    assert [r.text for r in got if r.conv_id == 5] == ["<|im_start|>a\nhi<|im_end|>\n<|im_start|>b\nelse<|im_end|>\n"]
    assert sum(r.conv_id == 8 for r in got) == 3
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_shards_are_whole_groups_of_near_equal_size(spark, docs, empty):
    rng = random.Random(2)
    rows = [(100 + i, "x" * rng.randrange(1, 400), "k", 1) for i in range(400)] + [(900 + i, "copy", "k", 1) for i in range(50)]
    every = docs.where("doc_id <> 41").unionByName(spark.createDataFrame(rows, docs.schema))
    got = shards.shard_report(every).collect()
    assert len(got) == every.count()
    loads = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(loads) < 1.01 * sum(loads) / 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id is not None and 900 <= r.doc_id < 950}) == 1
    assert len({r.shard for r in got if r.doc_id in (1, None) and r["size"] == 1}) == 1
    assert shards.shard_report(empty).collect() == []


def test_best_fit_prefers_the_tightest_bin():
    bins = shards.Bins([10, 6, 8])
    assert bins.place(6, 1) == (1, 1) and bins.place(7, 1) == (2, 1) and bins.place(11, 1) is None
    assert shards.pack([(9, 1), (5, 1), (4, 1), (3, 1)], 3) is not None
