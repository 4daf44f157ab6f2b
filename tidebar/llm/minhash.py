"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles. Of each of 128 hash functions the least value over the set is taken;
bands of four minima generate candidates, and the two low bits of every minimum, packed, give an estimate of the
similarity by bit counts, corrected for the bits that agree by chance. Candidates that the estimate leaves possible are
confirmed on the full sets; equal sets are one class throughout, so copies are never expanded into pairs.

In each bucket every class is compared with the least one, which is linear in the bucket; most buckets are one component
then. Those with more are searched for links between components, with the full sets at hand: members of the largest one
are only compared with the others, pairs that have been joined meanwhile are passed over, and only links are given. A large
bucket is dealt in blocks; a member of its largest component is sent once for each block of other members, which are few.
So no link that could join two components is lost, however large the group, and no bucket is expanded into all its pairs.

Two sets of similarity 0.8 share none of the 32 bands with probability (1 - 0.8**4)**32 = 5e-8, and the estimate is
six standard deviations wide.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; texts of
fewer words than a shingle have one shingle, all their words; rows with a null id are linked with nothing and kept;
rows that repeat an id are one document, also with different texts: what is near to one of them is linked with the id, but
for rows without words, which are linked with nothing and stay (ids are below 2**62, from where on further texts of an id have numbers of their own meanwhile); an empty table gives no rows;
the result has no other columns; dropping near duplicates leaves all columns as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, discard, free_name, materialize, release, slices, spread_join
from .components import components
from .hashing import mix, rolling, word_hashes

FUNCTIONS, ROWS, BITS = 128, 4, 2
#: Members of a bucket that are compared in one group.
BLOCK = 1024
#: Ids that are sent to every executor, at most (three numbers each, so 24 MB); more are joined by a shuffle of the texts.
SENT_IDS = 1_000_000
#: From here on classes are numbered whose id has another class already.
SPARE = 1 << 62
WIDTH, SIMILARITY = 5, 0.8
#: Bytes of text hashed together.
SLICE = 3 << 20
_RNG = np.random.default_rng(0xB1B1)
_XOR = _RNG.integers(0, 1 << 64, FUNCTIONS, np.uint64)
_FACTOR = _RNG.integers(0, 1 << 64, FUNCTIONS, np.uint64) | np.uint64(1)
_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, signature binary"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's set, and the sorted distinct shingle hashes of all texts, one after the other."""
    offsets, words = word_hashes(texts, lower=True)
    sizes = np.diff(offsets)
    whole = np.maximum(sizes - width + 1, 0)
    at = np.arange(whole.sum()) + np.repeat(offsets[:-1] - (np.cumsum(whole) - whole), whole)
    hashed = [rolling(words, width, 0x8EBC6AF09C88C6E3)[at] if len(at) else np.zeros(0, np.uint64)]
    text = [np.repeat(np.arange(len(sizes)), whole)]
    for n in range(1, width):  # texts of n words: all of them are the one shingle
        short = np.flatnonzero(sizes == n)
        if len(short):
            hashed.append(rolling(words, n, 0x589965CC75374CC3)[offsets[:-1][short]] + np.uint64(n))
            text.append(short)
    hashed, text = np.concatenate(hashed), np.concatenate(text)
    order = np.lexsort((hashed, text))
    hashed, text = hashed[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    hashed, text = hashed[new], text[new]
    return np.searchsorted(text, np.arange(len(sizes) + 1)), hashed


def minima(bounds: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """(set, function): the least value of each hash function; sets must not be empty."""
    out = np.empty((len(bounds) - 1, FUNCTIONS), np.uint64)
    starts = bounds[:-1]
    for k in range(FUNCTIONS):
        out[:, k] = np.minimum.reduceat((hashed ^ _XOR[k]) * _FACTOR[k], starts)
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, packed."""
    low = mix(least).astype(np.uint8) & np.uint8((1 << BITS) - 1)
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & np.uint8(1)
    return np.packbits(bits.reshape(len(least), FUNCTIONS * BITS), axis=1)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(least), FUNCTIONS // ROWS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + least[:, r::ROWS] + np.uint64(r))
    return mix(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of minima whose bits agree, less what agrees by chance."""
    apart = np.bitwise_xor(a, b)
    apart = (apart | (apart >> 1)) & np.uint8(0x55)  # one bit for each minimum that differs
    agree = 1 - np.bitwise_count(apart).sum(-1, dtype=np.int64) / FUNCTIONS
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def least_estimate(similarity: float) -> float:
    """Six standard deviations of the estimate under ``similarity``."""
    chance = 1 / (1 << BITS)
    p = similarity + (1 - similarity) * chance
    return similarity - 6 * np.sqrt(p * (1 - p) / FUNCTIONS) / (1 - chance)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Set size, set hash, band keys and signature of each document; the last three are null for empty sets."""

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                part = batch.slice(start, stop - start)
                bounds, hashed = shingle_sets(part.column("text"), width)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                least = minima(np.append(bounds[:-1][some], bounds[-1]), hashed) if len(some) else np.zeros((0, FUNCTIONS), np.uint64)
                sums = [_set_hash(bounds[:-1][some], hashed, s) if len(some) else np.zeros(0, np.int64) for s in (1, 2)]
                keys, packed = band_keys(least), signature(least)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                place = np.full(len(size), -1)
                place[some] = np.arange(len(some))
                index = pa.array(place, mask=place < 0)
                columns = [
                    part.column("doc_id"),
                    pa.array(size, pa.int64()),
                    *(pa.array(s).take(index) for s in sums),
                    lists.take(index),
                    pa.array([x.tobytes() for x in packed], pa.binary()).take(index),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SKETCH.split(", ")])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SKETCH)


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked to be broadcast where it is known to be small."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _set_hash(bounds: np.ndarray, hashed: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set, none of them empty."""
    return np.add.reduceat(mix(hashed + np.uint64(seed)), bounds).view(np.int64)


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and sorted shingle hashes of the classes in ``ids`` (id, doc, h1)."""

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                part = batch.slice(start, stop - start)
                bounds, hashed = shingle_sets(part.column("text"), width)
                own = np.zeros(len(part), np.int64)
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    own[some] = _set_hash(bounds[:-1][some], hashed, 1)
                at = np.flatnonzero(own == np.asarray(part.column("h1")))  # another text of the id is another class
                sets = [hashed[bounds[i] : bounds[i + 1]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(sets, pa.binary())], names=["id", "shingles"])
            release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(_few(ids), "doc")
    return texts.select("id", "h1", "text").mapInArrow(run, "id long, shingles binary")


def _side(pairs: DataFrame, facts: DataFrame, name: str, total: int) -> DataFrame:
    """``pairs`` with the columns of ``facts`` (id and others) of their member ``name``; some members are in most of the pairs."""
    named = facts.select(F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in facts.columns if c != "id"))
    if name == "b":
        return pairs.join(named, "b")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
    return spread_join(pairs, named.join(counts, "a"), ["a"], "rows", total, F.col("b")).drop("rows")


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float, total: int) -> DataFrame:
    """Pairs (a, b) whose sizes and estimate allow the similarity."""
    both = _side(_side(pairs, classes, "a", total), classes, "b", total)
    both = both.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)
    bound = least_estimate(similarity)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("signature_a", "signature_b"))
                yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y) >= bound))

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _side(_side(pairs, sets, "a", total), sets, "b", total).mapInArrow(run, "a long, b long")


def _similar(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sorted sets have 100 * intersection >= percent * union with ``own``."""
    sizes = np.array([len(y) for y in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    common = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(own) + sizes - common)


def _links_between(rows: pd.DataFrame, similarity: float, percent: int) -> pd.DataFrame:
    """Confirmed links that join components which meet in a bucket; pairs that are joined already are passed over.

    ``side`` is the block of a member; a group of two blocks compares members of one with those of the other.
    """
    rows = rows.drop_duplicates("id").reset_index(drop=True)
    ids, comp, n, side = (rows[c].to_numpy() for c in ("id", "component", "n", "side"))
    signatures = np.frombuffer(b"".join(rows.signature), np.uint8).reshape(len(rows), -1)
    sets = [np.frombuffer(x, np.uint64) for x in rows.shingles]
    names, local = np.unique(comp, return_inverse=True)
    two, out = side.min() != side.max(), []
    # pairs within the largest component need no look: one side is always outside it
    rest = np.flatnonzero(local != np.bincount(local).argmax())
    for x in rest.tolist():
        low, high = np.minimum(n[x], n), np.maximum(n[x], n)
        open_ = (local != local[x]) & (low >= similarity * high - 1e-6)
        if two:
            open_ &= side != side[x]
        near = np.flatnonzero(open_)
        near = near[estimate(signatures[x][None, :], signatures[near]) >= least_estimate(similarity)]
        for i in range(0, len(near), 256):
            own = near[i : i + 256]
            own = own[local[own] != local[x]]
            if not len(own):
                continue
            for y in own[_similar(sets[x], [sets[k] for k in own], percent)]:
                if local[y] != local[x]:
                    out.append((ids[x], ids[y]))
                    local[local == local[y]] = local[x]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """key, low, high, side, id and component: the groups in which members of open buckets meet.

    ``rows`` have their bucket's size, its largest component (main) and the size of that. Members of main meet the others by
    block (low) and chunk of the others (high, below zero), the others meet each other by pairs of chunks.
    """
    blocks, chunks = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil((F.col("size") - F.col("n_main")) / BLOCK).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = ["key", "id", "component"]
    inside, others = rows.where("component = main"), rows.where("component <> main").withColumn("chunk", dealt(chunks))
    main = inside.select(*own, dealt(blocks).alias("low"), upto(chunks).alias("c")).select(*own, "low", (-1 - F.col("c")).alias("high"), F.lit(0).alias("side"))
    met = others.select(*own, upto(blocks).alias("low"), (-1 - F.col("chunk")).alias("high"), F.lit(1).alias("side"))
    pairs = others.select(*own, "chunk", upto(chunks).alias("c"))
    pairs = pairs.select(*own, F.least("chunk", "c").alias("low"), F.greatest("chunk", "c").alias("high"), F.col("chunk").alias("side"))
    return main.unionByName(met).unionByName(pairs)


def link_components(docs: DataFrame, classes: DataFrame, width: int, similarity: float, same: DataFrame) -> DataFrame:
    """id and component of the classes that are not their own component; ``classes``, written: id, doc, h1, n, bands, signature.

    ``same`` has links (a, b) between the classes of one id.
    """
    percent = round(100 * similarity)
    keys = classes.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(
        F.min("id").alias("a"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")
    )
    # near copies meet in many bands: of buckets with the same members one is enough
    buckets = buckets.where("size > 1").groupBy("a", "size", "x", "y").agg(F.min("key").alias("key")).select("key", "a", "size")
    buckets = materialize(buckets, "near-buckets")
    n_keys = classes.count() * (FUNCTIONS // ROWS)
    members = materialize(spread_join(keys, buckets, ["key"], "size", n_keys, F.col("id")), "near-members")
    first = materialize(members.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "near-first")
    ids = materialize(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc", "h1"), "near-ids")
    sets = materialize(_full_sets(docs, ids, width).dropDuplicates(["id"]), "near-sets")
    sketch = classes.select("id", "n", "signature")
    n_first = first.count()
    likely = materialize(_likely(first, sketch, similarity, n_first), "near-likely")
    links = materialize(_confirmed(likely, sets, percent, n_first).unionByName(same), "near-links")
    # what is left to meet is no least member, in a bucket with two others at least
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = members.where("a <> id and size > 2").join(labels, "id", "left")
    named = materialize(named.select("key", "id", "size", F.coalesce("component", "id").alias("component")), "near-named")
    counts = named.groupBy("key", "size", "component").agg(F.count(F.lit(1)).alias("n"))
    open_keys = counts.groupBy("key", "size").agg(
        F.count(F.lit(1)).alias("n_components"), F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main")
    )
    open_keys = materialize(open_keys.where("n_components > 1").drop("n_components"), "near-open")
    rows = spread_join(named.drop("size"), open_keys, ["key"], "size", named.count(), F.col("id"))
    rows = _in_blocks(rows).join(sketch, "id").join(sets, "id")
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "low", "high")
    found = rows.groupBy("key", "low", "high").applyInPandas(lambda r: _links_between(r, similarity, percent), "a long, b long")
    every = materialize(links.unionByName(found.distinct()), "near-links")
    found = components(every.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(buckets, members, first, ids, sets, likely, links, named, open_keys, every)
    return found


def _same_ids(real: DataFrame, heads: DataFrame, total: int) -> DataFrame:
    """Links (a, b) between the classes of each id that has several: rows of one id are one document, whatever their texts are."""
    equal = ["n_shingles", "h1", "h2"]
    either = F.struct(*equal)
    several = real.groupBy("doc_id").agg(F.min(either).alias("low"), F.max(either).alias("high")).where("low <> high")
    several = materialize(several.select("doc_id"), "near-several")
    rows = real.select("doc_id", *equal).join(_few(several), "doc_id", "left_semi")
    named = spread_join(rows, heads.select(*equal, "id", "rows"), equal, "rows", total, F.col("doc_id")).select("doc_id", "id")
    least = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("rows"))
    linked = spread_join(named, least, ["doc_id"], "rows", total, F.col("id"))
    return materialize(linked.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "near-same")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept, one row for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    every = materialize(sketches(docs, width), "near-sketches")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    real = every.where(known)
    equal = ["n_shingles", "h1", "h2"]
    heads = real.groupBy(*equal).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(*equal))
    spare = F.lit(SPARE) + F.pmod(F.xxhash64("doc", "h1", "h2"), F.lit(SPARE))
    heads = materialize(heads.select(*equal, "doc", "rows", F.when(place == 1, F.col("doc")).otherwise(spare).alias("id")), "near-heads")
    own = real.join(heads.withColumnRenamed("doc", "doc_id"), ["doc_id", *equal])
    classes = own.select("id", F.col("doc_id").alias("doc"), "h1", F.col("n_shingles").alias("n"), "bands", "signature").dropDuplicates(["id"])
    classes = materialize(classes, "near-classes")
    labels = link_components(docs, classes, width, similarity, _same_ids(real, heads, every.count()))
    discard(classes)
    named = heads.join(labels, "id", "left").select(*equal, "rows", F.coalesce("component", "doc").alias("component_id"))
    named = materialize(named, "near-components")
    found = spread_join(real, named, equal, "rows", every.count(), F.col("doc_id")).select("doc_id", "n_shingles", "component_id")
    found = found.unionByName(every.where(~known).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all its columns."""
    found = near_duplicates(docs, width, similarity).where(~F.col("kept"))
    name = free_name(docs.columns, "gone")
    gone = materialize(found.select(F.col("doc_id").alias(name)).distinct(), "near-gone")
    # a row without words is nobody's near duplicate, whatever other rows of its id are
    return docs.join(_few(gone), (F.col("doc_id") == F.col(name)) & F.col("text").rlike(f"[^{WHITE}]"), "left_anti")
