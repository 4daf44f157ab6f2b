"""The whole pipeline against brute force of every stage, and what the operators do with odd rows and columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebar.llm import bpe, chat, common, pii, queries, shards, toxicity

from .conftest import corpus
from .test_passages import brute_components, brute_contamination, brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n_words string, runs int, items int, ids string, n_lines int, toxicity string, gone int"


def written(spark, path, rows, items, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9.0, "k", "w", 1, 2, "i", 3, "t", 4) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_against_brute_force(spark, tmp_path):
    """Without labels nothing is toxic; all other stages are those of the brute force, one on what the other kept."""
    from tokenizers import Tokenizer

    texts = dict(corpus())
    odd = "abcdefghijklm"
    rows = [(i, t) for i, t in corpus()]
    rows += [(200 + i, f"{texts[41][60 * i : 60 * i + 50]}\nWritten by {c}anna {c}berg for the paper\n{texts[12]}") for i, c in enumerate(odd)]
    rows += [(300, f"own words of this one {texts[41][900:1300]}"), (301, "\n"), (302, texts[41])]
    items = [("a", texts[41][920:1200]), ("b", None), ("c", "one two three"), (None, "né à né à né à")]
    sf_dir = written(spark, f"file://{tmp_path}", rows, items, [])
    done = sorted(((r.doc_id, r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=str)

    kept = [(i, t) for i, _, _, t in brute_lines(rows)]
    gone = {i for i, _, _, stays in brute_components(kept, 5, 80) if not stays}
    kept = [(i, t) for i, t in kept if i not in gone]
    named = [("" if k is None else k, t) for k, t in items]
    kept = [(i, t) for i, t in kept if not brute_contamination([(i, t)], named)[0][-1]]
    library = Tokenizer.from_file(queries.tokenizer_path())
    truth = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in kept]
    assert done == sorted(((i, len(ids), ids) for i, ids in truth), key=str)
    assert len(gone) >= 2 and len(kept) < len(rows) - len(gone)


def test_stages_leave_columns_alone(spark, tmp_path):
    rows = [(i, f"a line of words {i} " * (i + 1)) for i in range(40)]
    sf_dir = written(spark, f"file://{tmp_path}", rows, [("a", "nothing of this kind")], [(i, 1, i % 2) for i in range(40)])
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns
        own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
        assert {tuple(r) for r in found.select(*own).collect()} <= {("en", "s", 9.0, "k", "w", 1, 2, "i", 3, "t", 4)}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf_dir = written(spark, f"file://{tmp_path}", [], [], [])
    assert corpus_pipeline.run(spark, sf_dir).collect() == []


def test_scores_are_those_of_single_windows():
    """Batches, slices and shared words change nothing: each text's score is the largest of its windows, scored one by one."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["Vile,", "good", "né", "x1", "it's", "!!", "word"]) for _ in range(n))
    texts = ["", None, " \n", *(say(n) for n in (1, 63, 64, 65, 112, 113, 700))]
    net = toxicity.Net()
    got = toxicity.score_texts(net, pa.array(texts, pa.string()))
    for text, score in zip(texts, got):
        words = (text or "").split()
        starts = range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)
        best = -np.inf
        for s in starts:
            own = words[s : s + toxicity.WINDOW]
            vocab = toxicity.Words(pa.array(own, pa.string()))
            codes = np.array([[*range(len(own)), *[len(own)] * (toxicity.WINDOW - len(own))]])
            logit, _ = net.logits(net.tables(vocab.inputs(net.p)), codes, len(own))
            best = max(best, float(logit[0]))
        assert score == pytest.approx(1 / (1 + np.exp(-best)), abs=1e-5)


def naive_fit(runs, capacities):
    room, placed = list(capacities), []
    for size, n in runs:
        parts = []
        while n:
            able = sorted((r, b) for b, r in enumerate(room) if r >= size)
            if not able:
                return None
            b = able[0][1]
            k = min(n, int(room[b] // size))
            room[b] -= k * size
            parts.append((b, k))
            n -= k
        placed.append(parts)
    return placed


def test_best_fit_against_a_plain_search():
    rng = random.Random(9)
    for _ in range(300):
        runs = sorted(((rng.randrange(1, 60), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 25))), reverse=True)
        capacities = [rng.randrange(20, 400) for _ in range(rng.randrange(1, 9))]
        assert shards.fit(runs, capacities) == naive_fit(runs, capacities)


def test_chats_with_other_columns_and_long_texts(spark):
    rows = [(1, 0, "a", "x" * 500_000, "mine", 5), (1, 1, "b", None, "mine", 5), (2, 0, "a", "x" * 500_000, "mine", 5), (3, None, "a", "y", "mine", 5), (3, None, "a", "z", "mine", 5)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, n_turns int")
    got = {r.conv_id: (r.n_turns, len(r.text)) for r in chat.format_chats(given).collect()}
    assert set(got) == {1, 3} and got[1][0] == 2 and got[1][1] > 500_000 and got[3][0] == 2


def test_other_columns_of_tags_tokens_and_redactions(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd", "mine", 7, "r")], "doc_id long, text string, base string, ids int, redacted string")
    found = pii.redact(pii.find_pii(docs, b"")).first()
    assert found.ids == 7 and found.redacted == "to [email]" and found.base[0].kind == "email"
    path = queries.tokenizer_path()
    tokens = bpe.encode(docs, path, ids="tokens").first()
    assert tokens.ids == 7 and tokens.base == "mine" and len(tokens.tokens) > 2


def test_hot_keys_are_split_without_loss(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("key"), "id")
    few = many.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).withColumn("said", F.col("key") * 2)
    got = common.spread_join(many, few, ["key"], "rows", 5000, F.col("id"))
    assert got.count() == 5000 and got.where("said <> key * 2").count() == 0
    assert got.columns == ["key", "id", "rows", "said"]


def test_rows_without_an_id_are_packed_like_others(spark, monkeypatch):
    """A third of all rows without an id, another with one id: slots have no gaps, equal texts share a shard, sizes are near equal."""
    import collections

    from tidebar.llm import shards

    monkeypatch.setattr(shards, "RANK_ROWS", 10)
    rows = [(None, f"text {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)] + [(i, "same" if i % 3 else f"own {i}") for i in range(1000, 1300)]
    found = shards.shard_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == 900
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 8
    assert len({r.shard for r in found if r["size"] == 5}) == 1 and max(sizes.values()) - min(sizes.values()) < 1100
