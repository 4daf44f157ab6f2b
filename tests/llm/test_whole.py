"""Whole jobs: nothing of a long text, a large group or a common anchor is cut off."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidebar.llm import substring, toxicity


def test_windows_are_told_apart_by_all_bits():
    """Windows that differ in one bit of either check are not one; the least document of a window is not repeated."""
    check = np.array([5, 5 + (1 << 50), 5, 5], np.uint64)
    second = np.array([1, 1, 1, 2], np.uint32)
    doc, place = np.array([1, 2, 3, 4], np.int64), np.zeros(4, np.int32)
    order = np.argsort(check, kind="stable")
    packed = substring._pack(*(c[order] for c in (check, second, doc, place)))
    found = substring._unpack_all([{"packed": packed, "n": 4}], np.uint64, np.uint32, np.int64, np.int32)
    by, later = substring._least_first(*found)
    assert found[2][by][later].tolist() == [3]


def test_a_phrase_of_a_third_of_all_documents_is_no_repeat(spark):
    """One hot six-word run in front of words that differ: nothing is removed; the same with one word more in common is."""
    phrase = [f"hot{i}" for i in range(12)]
    rows = [(i, " ".join([*phrase[:6], *(f"own{i}x{j}" for j in range(30))])) for i in range(300)]
    rows += [(1000 + i, " ".join([*phrase, "more", *(f"own{i}y{j}" for j in range(30))])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.n_removed for r in substring.substring_report(docs, 4).collect()}
    assert {i: n for i, n in found.items() if n} == {1001 + i: 13 for i in range(39)}


def test_training_sees_the_ends_of_long_texts(monkeypatch):
    """Toxic rows train with a passage after 1500 clean words; late words of clean rows are learnt from as well."""
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    toxic = [" ".join([*say(1500), *["vile", "filth"] * 8, *say(20)]) for _ in range(12)]
    clean = [" ".join([*say(1500), *["lateword"] * 300]) for _ in range(12)]
    seen, known = set(), toxicity.Net.gradients

    def spy(self, words, *rest):
        seen.update(words.bucket.tolist())
        return known(self, words, *rest)

    monkeypatch.setattr(toxicity.Net, "gradients", spy)
    weights = toxicity.train(toxic + clean, [1] * 12 + [0] * 12)
    assert set(toxicity.word_buckets(pa.array(["vile", "filth", "lateword"])).tolist()) <= seen
    found = toxicity.score_texts(toxicity.Net(weights), pa.array(toxic + clean))
    assert found[:12].min() > found[12:].max()


def test_pipeline_drops_long_lines_of_two_documents(spark):
    """A passage of two documents goes from the later one; short lines and lines of other numbers stay."""
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    numbers = " ".join(["row", "of", *(str(i) for i in range(12))])
    others = numbers.replace("11", "12")
    texts = [f"one\n{passage}\nshort line here", f"{passage}\nshort line here\n{numbers}", f"three\n{others}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = dict(sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_lines(spark, docs, "").collect()))
    assert found == {0: texts[0], 1: f"short line here\n{numbers}", 2: texts[2]}
