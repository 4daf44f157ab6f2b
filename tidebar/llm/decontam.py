"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

A text is lower-cased in A-Z and cut into words of letters, digits and non-ASCII characters. Wanted are all occurrences of
windows of 13 consecutive item words (a shorter item is one window). Every such window holds one of the item's blocks of
seven words that begin at a multiple of seven, so the automaton's patterns are those blocks, and short items as a whole:
it has one path of two nodes for each item word. It runs over the numbers of a document's words once. Where a block
occurs, it is grown to both sides as long as words are equal; a run of 13 words or more is a run of windows. The words'
offsets in the normalised text are those in the original.

Defined results: a null or empty text has no words and no hits; null items, and items without words, are no patterns;
an item with a null id counts under the empty id; repeated items count once per id; other columns are left alone, but for
columns of the names that the results are to have, which are replaced.
"""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_name, release, slices

WINDOW = 13
#: Bytes of item text that are sent to the executors at once; a worker holds some fifty bytes for each of them.
ITEMS_LIMIT = 8 << 20
#: Parts that a larger benchmark is dealt into before they are put together up to the limit.
DEALT = 4096
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
REPORT = ("n_words", "runs", "items")
_KINDS = ("long", "array<struct<start:int,stop:int>>", "array<string>")
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def norm_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Items:
    """The automaton of some items (id, text) and what it takes to grow its matches."""

    def __init__(self, items: tuple[tuple[str, str], ...], size: int):
        self.size, self.block = size, (size + 1) // 2
        owners: dict[tuple, set] = {}
        for item_id, text in items:
            owners.setdefault(tuple(norm_words(text)), set()).add(item_id)
        owners.pop((), None)
        self.owners = list(owners.values())
        number: dict[bytes, int] = {}
        self.words = [[number.setdefault(w, len(number)) for w in words] for words in owners]
        # a word is two letters, so that no node has more branches than the root of the number of words
        base = int(len(number) ** 0.5) + 1
        self.letters = {w: (1 + i // base, 1 + base + i % base) for w, i in number.items()}
        self.number = number
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        spelled = list(self.letters.values())
        places: dict[tuple, list] = {}
        for k, words in enumerate(self.words):
            n = len(words)
            starts = range(0, n - self.block + 1, self.block) if n >= size else (0,)
            for at in starts:
                places.setdefault(tuple(words[at : at + self.block] if n >= size else words), []).append((k, at))
        for pattern, where in places.items():
            self.tree.add_word(tuple(c for w in pattern for c in spelled[w]), (len(pattern), where))
        if owners:
            self.tree.make_automaton()

    def occurrences(self, words: list[bytes]):
        """(start, stop, item) of the runs of item windows in a document."""
        none = (0, 0)
        spelled = tuple([c for w in words for c in self.letters.get(w, none)])
        numbers, seen = None, {}
        for end, (n, where) in self.tree.iter(spelled):
            stop = (end + 1) // 2
            if numbers is None:
                numbers = [self.number.get(w, -1) for w in words]
            for k, at in where:
                item = self.words[k]
                if len(item) < self.size:
                    yield stop - n, stop, k
                    continue
                shift = stop - n - at  # the item's first word would be here
                if seen.get((k, shift), -1) >= stop:
                    continue  # in a run that has been grown already
                low, high = stop - n, stop
                while low > 0 and low > shift and numbers[low - 1] == item[low - 1 - shift]:
                    low -= 1
                while high < len(numbers) and high - shift < len(item) and numbers[high] == item[high - shift]:
                    high += 1
                seen[k, shift] = high
                if high - low >= self.size:
                    yield low, high, k


@functools.lru_cache(maxsize=2)
def automaton(items: tuple[tuple[str, str], ...], size: int) -> Items:
    return Items(items, size)


def _char_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of word numbers as offsets in the original text, in code points."""
    raw = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    a = np.frombuffer(raw, np.uint8)
    inside = a != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    chars = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
    return [{"start": int(chars[starts[i]]), "stop": int(chars[stops[j]])} for i, j in runs]


def scan(text: str | None, known: Items, runs=(), ids=()) -> tuple[int, list, set]:
    """Number of words, runs of hit words (first, stop) and ids; ``runs`` and ``ids`` are those of earlier passes."""
    words, ids, marks = norm_words(text), set(ids), None
    for start, stop, k in known.occurrences(words) if known.owners else ():
        if marks is None:
            marks = np.zeros(len(words) + 1, np.int64)
        marks[start] += 1
        marks[stop] -= 1
        ids |= known.owners[k]
    if marks is None:
        return len(words), list(runs), ids
    for run in runs:
        marks[run["start"]] += 1
        marks[run["stop"]] -= 1
    hit = np.cumsum(marks[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    found = [{"start": int(i), "stop": int(j)} for i, j in zip(edges[::2], edges[1::2], strict=True)]
    return len(words), found, ids


def _pass(docs: DataFrame, benchmark: DataFrame, size: int, names: tuple[str, str, str], first: bool) -> DataFrame:
    """One scan of ``docs`` for the items of ``benchmark``, which are few enough to be sent to every executor."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").distinct().collect()
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted((r[0], r[1]) for r in rows)))
    carried = [c for c in docs.columns if c not in names]

    def run(batches):
        known = automaton(held.value, size)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                had = [((), ())] * len(part)
                if not first:
                    had = zip(part.column(names[1]).to_pylist(), part.column(names[2]).to_pylist(), strict=True)
                got = [scan(t, known, *h) for t, h in zip(part.column("text").to_pylist(), had, strict=True)]
                cols = [
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([g[1] for g in got], _RUNS),
                    pa.array([sorted(g[2]) for g in got], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *cols], names=[*carried, *names])
            release()

    source = docs if not first else docs.select(*carried)
    added = StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in zip(names, _KINDS))).fields
    return source.mapInArrow(run, StructType([*docs.select(*carried).schema.fields, *added]))


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of at most ``ITEMS_LIMIT`` bytes; only a single item can be larger."""
    size = F.sum(F.octet_length("text"))
    if (benchmark.agg(size).first()[0] or 0) <= ITEMS_LIMIT:
        return [benchmark]
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(DEALT))
    out, held = [[]], 0
    for r in benchmark.groupBy(number.alias("part")).agg(size.alias("bytes")).orderBy("part").collect():
        if out[-1] and held + r["bytes"] > ITEMS_LIMIT:
            out.append([])
            held = 0
        out[-1].append(r["part"])
        held += r["bytes"]
    return [benchmark.where(number.isin(p)) for p in out]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, names: tuple[str, str, str] = REPORT) -> DataFrame:
    """``docs`` with the number of words, runs (of hit words: first, stop) and items (sorted ids), by these names; no shuffle.

    Items are broadcast, at most ``ITEMS_LIMIT`` bytes of them at a time, which is checked: a larger benchmark is dealt by
    a hash into parts under that size, and each part is one more pass over the documents that adds to the runs already found.
    """
    out = docs
    for k, part in enumerate(_parts(benchmark.where(F.col("text").isNotNull()).select("item_id", "text"))):
        out = _pass(out, part, size, names, first=k == 0)
    return out


def with_spans(found: DataFrame) -> DataFrame:
    """Adds spans: the runs as offsets (code points) in the original text."""

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                texts, runs = part.column("text").to_pylist(), part.column("runs").to_pylist()
                spans = [_char_spans(t, [(r["start"], r["stop"] - 1) for r in x]) if x else [] for t, x in zip(texts, runs)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, _RUNS)], names=[*part.schema.names, "spans"])
            release()

    kind = StructType.fromDDL("spans array<struct<start:int,stop:int>>")
    return found.mapInArrow(run, StructType([*found.schema.fields, *kind.fields]))


def hit_words(runs: str = REPORT[1]) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])


def contaminated(n_words: str = REPORT[0], runs: str = REPORT[1]) -> Column:
    """At least a twentieth of the words hit."""
    return (hit_words(runs) > 0) & (20 * hit_words(runs) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns as they are."""
    names = tuple(free_name(docs.columns, c) for c in REPORT)
    return find_contamination(docs, benchmark, size, names).where(~contaminated(*names[:2])).select(*docs.columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of :func:`find_contamination`."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
