"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word's input is the vector of the word (hashed) plus the mean vector of its character n-grams (bytes of the word
between markers, hashed). Overlapping windows of words run through the network in both directions, attention pools the
states of a window, and a document's score is the largest score of its windows. All is trained in numpy, in one task,
on a bounded sample of labelled rows; a toxic document trains with the window of its whole text that looks most toxic so
far, and clean windows are drawn from whole texts too.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. Labels, language, source and id are never
inputs of a score. Defined results: null and empty texts are scored as a window without words; null labels are not
learnt from; if one class has no learnable row every score is 0; repeated rows score alike, and a row with a null id is not
held out and not learnt from; other columns are left alone, but for one of the name that the score is to have, which is replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, release, slices, word_codes
from .recurrent import Adam, gru, gru_back, gru_run, sigmoid

#: Words of a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 64, 48
#: Labelled rows of each class that are learnt from, at most, each with all its windows; an id has one row for each text of its.
SAMPLE_ROWS = 1000
#: Hash buckets of words and of n-grams, sizes of their vectors and of the states, n-gram lengths in bytes.
BUCKETS, GRAM_BUCKETS, EMBED, STATE, GRAMS = 1 << 13, 1 << 14, 12, 8, (3, 4, 5)
EPOCHS, BATCH, RATE, SEED = 6, 96, 0.01, 7
#: Rows that a bucket's odds are drawn to the mean by, and how often a word is only known by its n-grams in training.
SHRINK, UNKNOWN = 8.0, 0.5
THRESHOLD = 0.7
#: Windows scored at once, and words whose n-grams are at hand at once.
SCORED, WORDS = 2048, 1 << 14


def learnable(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def plain_words(words: pa.Array) -> pa.Array:
    """Lower case, without punctuation at the ends."""
    return pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def gram_codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of all words between markers, and the number of n-grams of each word."""
    marked = pc.binary_join_element_wise("<", words, "> ", "")
    sizes = np.asarray(pc.binary_length(marked), dtype=np.int32)
    raw = np.frombuffer(b"".join(marked.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes, dtype=np.int32)
    word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = ends[word_of] - np.int32(1) - np.arange(len(raw), dtype=np.int32)  # bytes of the word from here on, without the closing blank
    hashed, owner = [], []
    value = np.zeros(len(raw), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        whole = max(len(raw) - n + 1, 0)
        value[:whole] = value[:whole] * np.uint64(0x100000001B3) + raw[len(raw) - whole :] + np.uint64(1)
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            mixed = value[at] * np.uint64(0x9E3779B97F4A7C15)
            hashed.append((mixed >> np.uint64(64 - 14)).astype(np.int32))
            owner.append(word_of[at])
    hashed, owner = np.concatenate(hashed), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return hashed[order], np.bincount(owner, minlength=len(sizes))


def word_buckets(words: pa.Array) -> np.ndarray:
    raw = words.cast(pa.binary()).to_pylist()
    import zlib

    return np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % BUCKETS


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the rows of each run; runs may be empty."""
    out = np.zeros((len(counts), values.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


_NONE = np.zeros(0, np.int64)


class Words:
    """The distinct words of a slice with their hashed word and n-grams; the last one is the blank of short windows."""

    def __init__(self, words: pa.Array):
        words = pa.concat_arrays([plain_words(words), pa.array([""], words.type)])
        self.bucket = word_buckets(words)
        self.grams, self.counts = gram_codes(words)

    def inputs(self, p: dict, known: np.ndarray | None = None) -> np.ndarray:
        """Vectors of the words; where ``known`` says so without that of the whole word."""
        x = p["word"][self.bucket] * (1 if known is None else known[:, None])
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        for i in range(0, len(x), WORDS):  # an n-gram's vector is needed for a block of words at a time
            own = self.counts[i : i + WORDS]
            x[i : i + WORDS] += _sums(p["gram"][self.grams[ends[i] : ends[i + len(own)]]], own) / np.maximum(own, 1)[:, None]
        x[-1] = 0
        return x


def window_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and text of each window; each text has one window at least."""
    count = np.maximum(1, -(-(np.diff(offsets) - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return offsets[:-1][text] + k * STRIDE, text


def window_codes(start: np.ndarray, text: np.ndarray, offsets: np.ndarray, codes: np.ndarray, blank: int) -> np.ndarray:
    """Word codes (window, place) of these windows."""
    place = start[:, None] + np.arange(WINDOW)
    inside = place < offsets[1:][text][:, None]
    out = codes[np.where(inside, place, 0)] if len(codes) else np.full(place.shape, blank)
    return np.where(inside, out, blank)


def windows_of(offsets: np.ndarray, codes: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Word codes (window, place) and the text of each window."""
    start, text = window_starts(offsets)
    return window_codes(start, text, offsets, codes, blank), text


class Net:
    def __init__(self, params: dict | None = None):
        rng = np.random.default_rng(SEED)
        small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = params or {
            "word": (rng.standard_normal((BUCKETS, EMBED)) * 0.05).astype(np.float32),
            "gram": (rng.standard_normal((GRAM_BUCKETS, EMBED)) * 0.05).astype(np.float32),
            "w0": small(EMBED, 3 * STATE), "b0": np.zeros(3 * STATE, np.float32), "u0": small(STATE, 3 * STATE),
            "w1": small(EMBED, 3 * STATE), "b1": np.zeros(3 * STATE, np.float32), "u1": small(STATE, 3 * STATE),
            "attend": small(2 * STATE), "out": small(2 * STATE), "bias": np.zeros(1, np.float32),
        }

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p["w0"] + self.p["b0"], x @ self.p["w1"] + self.p["b1"]]

    def logits(self, tables, codes: np.ndarray, blank: int, keep: bool = False):
        """``codes``: (batch, time)."""
        fwd = np.ascontiguousarray(codes.T)
        there = fwd != blank
        every = None if there.all() else there
        flip = None if every is None else every[::-1]
        if keep:
            a, kept0 = gru(tables[0], fwd, every, self.p["u0"], keep)
            b, kept1 = gru(tables[1], fwd[::-1], flip, self.p["u1"], keep)
        else:
            a, b = gru_run(tables[0], fwd, every, self.p["u0"]), gru_run(tables[1], fwd[::-1], flip, self.p["u1"])
        h = np.concatenate([a, b[::-1]], axis=2)
        e = h @ self.p["attend"]
        e = np.where(there, e, -1e9)
        weight = np.exp(e - e.max(0))
        weight *= there
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, h)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (fwd, every, kept0, kept1, h, weight, pooled)) if keep else (logit, None)

    def gradients(self, words: Words, codes: np.ndarray, blank: int, labels: np.ndarray, weights: np.ndarray, known: np.ndarray) -> dict:
        p = self.p
        x = words.inputs(p, known)
        tables = self.tables(x)
        logit, (fwd, every, kept0, kept1, h, weight, pooled) = self.logits(tables, codes, blank, True)
        d_logit = ((sigmoid(logit.astype(np.float32)) - labels) * weights / len(labels)).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, h)
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        d_h = weight[:, :, None] * d_pooled + d_e[:, :, None] * p["attend"]
        g["attend"] = np.einsum("tb,tbh->h", d_e, h)
        flip = None if every is None else every[::-1]
        dx0, g["u0"] = gru_back(np.ascontiguousarray(d_h[:, :, :STATE]), kept0, every, p["u0"])
        dx1, g["u1"] = gru_back(np.ascontiguousarray(d_h[::-1, :, STATE:]), kept1, flip, p["u1"])
        d_input = np.zeros_like(x)
        for k, dx, at in (("0", dx0, fwd), ("1", dx1, fwd[::-1])):
            d_table = np.zeros((len(x), 3 * STATE), np.float32)
            np.add.at(d_table, at.ravel(), dx.reshape(-1, 3 * STATE))
            g["w" + k], g["b" + k] = x.T @ d_table, d_table.sum(0)
            d_input += d_table @ p["w" + k].T
        d_input[-1] = 0
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], words.bucket, d_input * known[:, None])
        share = d_input / np.maximum(words.counts, 1)[:, None]
        np.add.at(g["gram"], words.grams, np.repeat(share, words.counts, axis=0))
        return g


def score_texts(net: Net, texts: pa.Array) -> np.ndarray:
    """Largest window score of each text."""
    offsets, codes, vocab = word_codes(texts)
    words = Words(vocab)
    blank = len(vocab)
    tables = net.tables(words.inputs(net.p))
    out = np.full(len(texts), -np.inf)
    grid, text = windows_of(offsets, codes, blank)
    for i in range(0, len(grid), SCORED):
        logit, _ = net.logits(tables, grid[i : i + SCORED], blank)
        np.maximum.at(out, text[i : i + SCORED], logit)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _log_odds(found, labels: np.ndarray, size: int) -> np.ndarray:
    """How much likelier a bucket is in toxic rows, by rows that have it; rare buckets count less.

    ``found`` gives the buckets of one row after the other, so that no more than one row's are at hand.
    """
    pos, every = np.zeros(size), np.zeros(size)
    for buckets, label in zip(found, labels):
        own = np.unique(buckets)
        every[own] += 1
        pos[own] += label
    p, n = labels.sum(), (1 - labels).sum()
    base = SHRINK * np.array([p, n]) / (p + n)
    return (np.log((pos + base[0]) / (every - pos + base[1])) - np.log(p / n)).astype(np.float32)


def train(texts: list[str], labels: list[int]) -> dict | None:
    labels = np.array(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    offsets, codes, vocab = word_codes(pa.array(texts, pa.string()))
    words, blank = Words(vocab), len(vocab)
    net = Net()
    # first guess of the vectors' first component: how toxic the word and its n-grams look by themselves
    ends = np.concatenate([[0], np.cumsum(words.counts)])

    def of_rows(grams: bool):
        for low, high in zip(offsets[:-1], offsets[1:]):
            own = np.unique(codes[low:high])
            yield np.concatenate([_NONE, *(words.grams[ends[w] : ends[w + 1]] for w in own)]) if grams else words.bucket[own]

    net.p["word"][:, 0] = _log_odds(of_rows(False), labels, BUCKETS) / 3
    net.p["gram"][:, 0] = _log_odds(of_rows(True), labels, GRAM_BUCKETS) / 3
    # all windows of all rows, of which only a block's codes are at hand
    begin, text = window_starts(offsets)
    windows = lambda at: window_codes(begin[at], text[at], offsets, codes, blank)
    scored = lambda f: np.concatenate([f(windows(slice(i, i + SCORED))) for i in range(0, len(begin), SCORED)])
    rng, adam = np.random.default_rng(SEED), Adam(net.p, RATE)
    looks = words.inputs(net.p)[:, 0]
    score = scored(lambda grid: np.sort(looks[grid], axis=1)[:, -3:].sum(1))
    for epoch in range(EPOCHS):
        if epoch:
            tables = net.tables(words.inputs(net.p))
            score = scored(lambda grid: net.logits(tables, grid, blank)[0])
        order = np.lexsort((-score, text))
        best = order[np.concatenate([[True], np.diff(text[order]) > 0])]
        toxic = best[labels[text[best]] == 1]
        clean = np.flatnonzero(labels[text] == 0)
        hard = best[labels[text[best]] == 0]
        chosen = np.concatenate([toxic, hard, rng.choice(clean, min(len(clean), len(toxic)), replace=False)])
        weight = np.where(labels[text[chosen]] == 1, 1.0, len(toxic) / max(1, len(chosen) - len(toxic)))
        shuffled = rng.permutation(len(chosen))
        for i in range(0, len(chosen), BATCH):
            own = shuffled[i : i + BATCH]
            at = chosen[own]
            grid = windows(at)
            used, small = np.unique(grid, return_inverse=True)
            local = _subset(words, used, blank)
            adam.rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            gone = len(local.bucket) - 1
            codes_here = np.where(grid == blank, gone, small.reshape(grid.shape))
            adam.update(net.gradients(local, codes_here, gone, labels[text[at]], weight[own].astype(np.float32), (rng.random(len(local.bucket)) >= UNKNOWN).astype(np.float32)))
    return net.p


def _subset(words: Words, used: np.ndarray, blank: int) -> Words:
    """The words of one batch, the blank last."""
    used = np.append(used[used != blank], blank)
    out = object.__new__(Words)
    out.bucket, out.counts = words.bucket[used], words.counts[used]
    starts = (np.cumsum(words.counts) - words.counts)[used]
    within = np.arange(out.counts.sum()) - np.repeat(np.cumsum(out.counts) - out.counts, out.counts)
    out.grams = words.grams[np.repeat(starts, out.counts) + within]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """Weights learnt in one task from at most ``SAMPLE_ROWS`` learnable rows of each class, chosen by a hash of the id.

    The bound holds for rows: ids that repeat with many texts are cut to it as well, by a hash of the text.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).select("doc_id", "toxic")
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [known.where(F.col("toxic") == y).distinct().orderBy(rank, "doc_id").limit(SAMPLE_ROWS) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").distinct()
    rows = [found.where(F.col("toxic") == y).orderBy(rank, "doc_id", F.xxhash64("text"), "text").limit(SAMPLE_ROWS) for y in (0, 1)]
    rows = rows[0].unionByName(rows[1]).select("toxic", "text", "doc_id")

    def run(batches):
        got = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for b in batches for r in b.to_pylist())
        params = train([g[1] for g in got], [g[2] for g in got])
        del got
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(params)], pa.binary())], names=["weights"])

    trained = rows.repartition(1).mapInArrow(run, "weights binary").collect()
    return bytes(trained[0][0]) if trained else None


def score(docs: DataFrame, weights: bytes | None, name: str = "score") -> DataFrame:
    """``docs`` with the score in column ``name``, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in docs.columns if c != name]

    def run(batches):
        params = pickle.loads(held.value) if held.value else None
        for batch in batches:
            batch = batch.select(names)
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                got = score_texts(Net(params), part.column("text")) if params else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got)], names=[*names, name])
                release()

    source = docs.select(*names)
    return source.mapInArrow(run, StructType([*source.schema.fields, *StructType.fromDDL(f"{name} double").fields]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, whose text scores under ``threshold``."""
    name = free_name(docs.columns, "toxicity")
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
