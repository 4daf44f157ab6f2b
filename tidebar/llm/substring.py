"""Substring deduplication over a log-structured fingerprint index.

A window is 13 consecutive words. Its fingerprint is its anchor, the least hash of the 6-word runs in it, cut to 48 bits:
equal windows have equal anchors, and neighbouring windows share one, so the index holds an entry for every four or five
words. An entry names an anchor, the document that has it and whether several documents do.

Documents come in batches. Each slice of a batch gives, for each bucket of anchors, one sorted segment; an anchor that
several documents of the slice have travels once. The segments of a bucket are merged with the sorted immutable runs of
earlier batches. Documents, old and new, whose anchor has been met in another document become candidates for it, and
the batch becomes a run; with ``FAN_IN`` runs of one level the same merge writes them and the batch as one run of the next
level.

Candidates are verified by their windows themselves: 88 bits of hash of all 13 words of each window that belongs to a
candidate anchor. Windows meet by that hash, not by anchor, so a phrase that a third of all documents have is many keys;
in each slice only the least document of a window travels, as the others are known to come after it. A window is repeated if
the least document that has it is smaller than its own. With n windows verified there are n * n / 2**89 false matches.

Defined results: null and empty texts have no words; documents of fewer than 13 words lose nothing; rows with a null id
are neither compared nor changed; repeated rows are no repeats of each other, as their id is not smaller; if rows of one
id have different texts, each loses what is found in itself; other columns are left alone, but for
columns named n_words, n_removed or kept, which are replaced.
"""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import free_name, materialize, release, remove_folder, shared_dir, slices
from .hashing import mix, rolling, sliding_min, word_hashes

WINDOW, GRAM = 13, 6
SPAN = WINDOW - GRAM + 1  # windows of an anchor, at most
#: Bits of an anchor, and bytes of it where it is named one by one.
ANCHOR_BITS, ANCHOR_BYTES = 48, 6
#: Bytes of text in one segment.
SEGMENT_BYTES = 6 << 20
#: Runs of one level that become one run, the new batch's among them.
FAN_IN = 2
#: Bytes of text whose entries share a bucket, which is merged in one task.
BUCKET_BYTES = 64 << 20
#: Batches that :func:`dedupe` puts a whole table through.
BATCHES = 3
#: Kinds of segment rows: entries to be judged, candidates known already, entries of runs that stay, and of runs that end here.
_NEW, _KNOWN, _OLD, _JOINED = 0, 1, 2, 3
_SEGMENT = "bucket int, kind int, n int, packed binary"
_MERGED = "part string, bucket int, target int, n int, packed binary"
_VERIFY = "bucket int, target int, n int, packed binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first one is sorted and kept by its steps."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    return zstandard.ZstdCompressor().compress(b"".join(map(_planes, (first, *columns[1:]))))


def _unpack(packed: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(packed)), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _unpack_all(rows: list[dict], *kinds: type) -> list[np.ndarray]:
    parts = [_unpack(r["packed"], r["n"], *kinds) for r in rows]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def _edges(*sorted_columns: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _lists(doc: np.ndarray, values: np.ndarray, width: int) -> tuple[pa.Array, pa.Array]:
    """For each document its values in the given number of bytes, one after the other."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    edge = _edges(doc)
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width])
    offsets = (np.append(edge, len(doc)) * width).astype(np.int64)
    wide = pa.Array.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
    return pa.array(doc[edge], pa.int64()), wide.cast(pa.binary())


def _dealt(doc: np.ndarray, values: np.ndarray, targets: int) -> dict:
    """What was found for documents, packed for the part of the documents (target) that it goes to."""
    order = np.lexsort((values, doc))
    doc, values = doc[order].astype(np.int64), values[order]
    target = (mix(doc.view(np.uint64)) % np.uint64(targets)).astype(np.int64)
    rows = [(int(target[at[0]]), len(at), _pack(doc[at], values[at])) for at in _split(target)]
    return dict(zip(("target", "n", "packed"), zip(*rows)))


def _gathered(rows: DataFrame, name: str, kind: type, width: int) -> DataFrame:
    """doc and its values, ``width`` bytes each, from rows of :func:`_dealt`; a document has one row."""

    def gather(table: pa.Table) -> pa.Table:
        names, lists = _lists(*_unpack_all(table.select(["n", "packed"]).to_pylist(), np.int64, kind), width)
        return pa.table({"doc": names, name: lists})

    return rows.groupBy("target").applyInArrow(gather, f"doc long, {name} binary")


def _table(schema: str, **columns) -> pa.RecordBatch:
    """A batch of these columns; what is not named is null."""
    n = len(next(iter(columns.values())))
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n, kinds[k]) for c, k in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in fields])


def _windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of a slice of texts: its text, its place in it, its anchor, and the place of its first word; and the words."""
    offsets, words = word_hashes(texts)
    counts = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    start = np.arange(counts.sum()) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    anchor = sliding_min(rolling(words, GRAM, 0xA0761D6478BD642F), SPAN)[start] if len(start) else np.zeros(0, np.uint64)
    return text, start, mix(anchor) >> np.uint64(64 - ANCHOR_BITS), words


def _split(bucket: np.ndarray) -> list[np.ndarray]:
    """Places of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, _edges(bucket[order])[1:]) if len(order) else []


# --- index ------------------------------------------------------------------------------------------------------


def segments(docs: DataFrame, buckets: int) -> DataFrame:
    """Sorted segments of each slice of ``docs``, one for each bucket that has entries."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
            for start, stop in slices(batch.column("text"), SEGMENT_BYTES):
                text, _, anchor, _ = _windows(batch.column("text").slice(start, stop - start))
                doc = ids[start:stop][text]
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                own = _edges(anchor, doc)
                anchor, doc = anchor[own], doc[own]
                edge = _edges(anchor)
                times = np.diff(np.append(edge, len(anchor)))
                several = np.repeat(times > 1, times)
                rows = []
                for at in _split((anchor[edge] % np.uint64(buckets)).astype(np.int64)):
                    a = anchor[edge[at]]
                    rows.append((int(a[0] % np.uint64(buckets)), _NEW, len(a), _pack(a, doc[edge[at]], (times[at] > 1).astype(np.uint8))))
                if several.any():  # to any bucket, as nothing has to meet them
                    rows.append((int(doc[0] % buckets), _KNOWN, int(several.sum()), _pack(anchor[several], doc[several])))
                if rows:
                    yield _table(_SEGMENT, **dict(zip(("bucket", "kind", "n", "packed"), zip(*rows))))
            release()

    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SEGMENT)


def _summary(anchor: np.ndarray, doc: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor once, in order, with its least document and whether it has several."""
    order = np.lexsort((doc, anchor))
    anchor, doc, several = anchor[order], doc[order], several[order]
    edge = _edges(anchor)
    if not len(edge):
        return anchor, doc, several
    more = np.maximum.reduceat(several, edge) | (np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge))
    return anchor[edge], doc[edge], more.astype(np.uint8)


def merge_bucket(rows: list[dict], targets: int) -> list[pa.RecordBatch]:
    """Candidates of a bucket, and its entries of the new run: the batch's and those of runs that are to become one with it."""
    kinds = np.uint64, np.int64, np.uint8
    anchor, doc, several = _unpack_all([r for r in rows if r["kind"] == _NEW], *kinds)
    old, old_doc, old_several = _summary(*_unpack_all([r for r in rows if r["kind"] in (_OLD, _JOINED)], *kinds))
    known, known_doc = _unpack_all([r for r in rows if r["kind"] == _KNOWN], *kinds[:2])
    own, own_doc, own_several = _summary(anchor, doc, several)
    at = np.searchsorted(old, own)
    met = np.append(old, np.uint64(1 << 63))[at] == own
    met_doc, met_several = np.append(old_doc, -1)[at], np.append(old_several, 0)[at]
    # in another document as well: of the batch, or of a run
    again = (own_several == 1) | (met & ((met_several == 1) | (met_doc != own_doc)))
    said = again[np.searchsorted(own, anchor)] & (several == 0)
    first = again & met & (met_several == 0)  # the one document of the runs that has it has not been named yet
    found = [np.concatenate(c) for c in zip((known, known_doc), (anchor[said], doc[said]), (own[first], met_doc[first]))]
    out = []
    if len(found[0]):
        dealt = _dealt(found[1], found[0], targets)
        out.append(_table(_MERGED, part=["found"] * len(dealt["n"]), **dealt))
    joined = _unpack_all([r for r in rows if r["kind"] == _JOINED], *kinds)
    run = _summary(*(np.concatenate(c) for c in zip((own, own_doc, again.astype(np.uint8)), joined)))
    if len(run[0]):
        out.append(_table(_MERGED, part=["run"], bucket=[rows[0]["bucket"]], n=[len(run[0])], packed=[_pack(*run)]))
    return out


class FingerprintIndex:
    """Immutable runs of fingerprints in a folder that all executors share; ``buckets`` is fixed with the index.

    A bucket of the runs and of the batch is merged in one task, in some 60 bytes an entry.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # level and folder
        self.found: list[str] = []  # folders with candidates

    def _read(self, folders: list[str], part: str) -> DataFrame:
        tables = [self.spark.read.schema(_MERGED).parquet(f).where(F.col("part") == part) for f in folders]
        return functools.reduce(DataFrame.unionByName, tables)

    def candidates(self) -> DataFrame:
        """doc and anchors: what each document of any batch so far shares with others."""
        return _gathered(self._read(self.found, "found").select("target", "n", "packed"), "anchors", np.uint64, ANCHOR_BYTES)

    def ingest(self, docs: DataFrame) -> None:
        """Put a batch into the index: its candidates, and those it makes of earlier documents, join the others."""
        level, merged, buckets = 0, [], self.buckets
        while len(same := [r for r in self.runs if r[0] == level]) >= FAN_IN - 1:
            merged += same
            level += 1
        folder = f"{self.path}/run-{uuid.uuid4().hex}"
        rows = segments(docs, self.buckets)
        for kind, runs in ((_OLD, [r for r in self.runs if r not in merged]), (_JOINED, merged)):
            if runs:
                earlier = self._read([p for _, p in runs], "run")
                rows = rows.unionByName(earlier.select("bucket", F.lit(kind).alias("kind"), "n", "packed"))

        def merge(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_table(_MERGED, part=[]), *merge_bucket(table.to_pylist(), buckets)])

        rows.groupBy("bucket").applyInArrow(merge, _MERGED).write.partitionBy("part").option("compression", "none").parquet(folder)
        for _, old in merged:
            remove_folder(self.spark, f"{old}/part=run")
        self.runs = [r for r in self.runs if r not in merged] + [(level, folder)]
        self.found.append(folder)

    def save(self) -> str:
        """Names of the runs and the number of buckets, to open the index again."""
        return json.dumps({"path": self.path, "buckets": self.buckets, "runs": self.runs, "found": self.found})

    @classmethod
    def load(cls, spark: SparkSession, saved: str) -> FingerprintIndex:
        spec = json.loads(saved)
        index = cls(spark, spec["buckets"], spec["path"])
        index.runs, index.found = [tuple(r) for r in spec["runs"]], spec["found"]
        return index


# --- verification -----------------------------------------------------------------------------------------------


def _squeezed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` compressed, for the way through a shuffle."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor().compress
        for batch in batches:
            at = batch.schema.get_field_index(text)
            own = [None if t is None else squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text, pa.array(own, pa.binary()))

    return docs.mapInArrow(run, StructType([StructField(f.name, BinaryType()) if f.name == text else f for f in docs.schema.fields]))


def _opened(column: pa.Array):
    """Slices of compressed texts: (start, stop, texts as bytes), of about SEGMENT_BYTES when open."""
    expand = zstandard.ZstdDecompressor().decompress
    held, size, start = [], 0, 0
    for i, raw in enumerate(column):
        held.append(expand(raw.as_py()) if raw.is_valid else None)
        size += len(held[-1] or b"")
        if size >= SEGMENT_BYTES:
            yield start, i + 1, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, len(column), held


def _candidate_windows(texts: pa.Array, ids: np.ndarray, anchors: list[bytes], shifts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Check, second check, document and place (behind the text's shift) of the windows whose anchor is among those of their text."""
    text, start, anchor, words = _windows(texts)
    sizes = np.array([len(a) // ANCHOR_BYTES for a in anchors], np.int64)
    raw = np.zeros((sizes.sum(), 8), np.uint8)
    raw[:, :ANCHOR_BYTES] = np.frombuffer(b"".join(anchors), np.uint8).reshape(-1, ANCHOR_BYTES)
    asked = raw.view(np.uint64).ravel() ^ mix(np.repeat(np.arange(len(sizes), dtype=np.uint64) + np.uint64(1), sizes))
    at = np.flatnonzero(np.isin(anchor ^ mix(text.astype(np.uint64) + np.uint64(1)), asked))
    first = start[at]
    check = rolling(mix(words + np.uint64(1)), WINDOW, 0xE7037ED1A0B428DB)[first] if len(at) else np.zeros(0, np.uint64)
    second = rolling(mix(words ^ np.uint64(0x5851F42D4C957F2D)), WINDOW, 0x9E6C63D0876A9A47)[first] if len(at) else np.zeros(0, np.uint64)
    begin = np.searchsorted(text, np.arange(len(sizes)))  # the first window of each text
    place = at - begin[text[at]] + shifts[text[at]]
    return check, (second >> np.uint64(40)).astype(np.uint32), ids[text[at]], place.astype(np.int32)


def _least_first(check, second, doc, place) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by hash and document, and which of them come after the least document of their hash."""
    order = np.lexsort((place, doc, second, check))
    edge = _edges(check[order], second[order])
    least = np.repeat(doc[order][edge], np.diff(np.append(edge, len(order))))
    return order, doc[order] > least


def repeated_windows(docs: DataFrame, candidates: DataFrame, buckets: int, shift: str | None = None) -> DataFrame:
    """doc and places (where windows start, four bytes each) of the windows that a smaller document has as well."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", (F.col(shift) if shift else F.lit(0)).alias("shift"))
    known = known.where(F.col("doc").isNotNull() & F.col("text").isNotNull())

    def emit(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc"), dtype=np.int64)
            shifts = np.asarray(batch.column("shift"), dtype=np.int32)
            for low, high, texts in _opened(batch.column("text")):
                anchors = batch.column("anchors").slice(low, high - low).to_pylist()
                found = _candidate_windows(pa.array(texts, pa.binary()).cast(pa.string()), ids[low:high], anchors, shifts[low:high])
                order, later = _least_first(*found)
                check, second, doc, place = (c[order] for c in found)
                if later.any():  # by way of any bucket, as nothing has to meet them
                    dealt = _dealt(doc[later], place[later], buckets)
                    yield _table(_VERIFY, bucket=dealt["target"], **dealt)
                check, second, doc, place = (c[~later] for c in (check, second, doc, place))
                rows = []
                for at in _split((check % np.uint64(buckets)).astype(np.int64)):
                    rows.append((int(check[at[0]] % np.uint64(buckets)), len(at), _pack(check[at], second[at], doc[at], place[at])))
                if rows:
                    yield _table(_VERIFY, **dict(zip(("bucket", "n", "packed"), zip(*rows))))
            release()

    def meet(table: pa.Table) -> pa.Table:
        judged = table.column("target").is_null()
        found = _unpack_all(table.filter(judged).select(["n", "packed"]).to_pylist(), np.uint64, np.uint32, np.int64, np.int32)
        order, later = _least_first(*found)
        out = [_table(_VERIFY, **_dealt(found[2][order][later], found[3][order][later], buckets))] if later.any() else []
        through = table.select(["bucket", "target", "n", "packed"]).filter(pc.invert(judged))
        return pa.concat_tables([through, *(pa.Table.from_batches([b]) for b in out)]).select(["target", "n", "packed"])

    met = _squeezed(known, "text").join(candidates, "doc").mapInArrow(emit, _VERIFY)
    hits = met.groupBy("bucket").applyInArrow(meet, "target int, n int, packed binary")
    return _gathered(hits, "places", np.int32, 4)


def _without(words: list[bytes], starts: np.ndarray) -> list[bytes]:
    """The words outside the windows that start at these places."""
    starts = starts[(starts >= 0) & (starts < len(words))]  # others belong to another text of the id
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + WINDOW, len(words)), -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]


def _shifted(docs: DataFrame) -> tuple[DataFrame, str | None, int]:
    """``docs``, the name of a column with the first place of each text among those of its id, and the bytes of all texts.

    There is no such column where no id has several texts. The texts of one id must have less than 2**31 characters together; texts of other ids keep their places.
    """
    own = F.xxhash64("text")
    ids = docs.where("doc_id is not null and text is not null").groupBy("doc_id")
    ids = ids.agg(F.min(own).alias("low"), F.max(own).alias("high"), F.sum(F.octet_length("text").cast("long")).alias("size"))
    facts = ids.agg(F.sum("size").alias("size"), F.sum((F.col("low") != F.col("high")).cast("long")).alias("several")).first()
    if not facts["several"]:
        return docs, None, facts["size"] or 0
    rows = docs.select("doc_id", "text").join(ids.where("low <> high").select("doc_id"), "doc_id", "left_semi")
    texts = rows.where(F.col("text").isNotNull()).select("doc_id", own.alias("h"), F.char_length("text").cast("long").alias("n")).distinct()
    before = Window.partitionBy("doc_id").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    key, h, shift = (free_name(docs.columns, c) for c in ("key", "hash", "shift"))
    at = texts.select(F.col("doc_id").alias(key), F.col("h").alias(h), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias(shift))
    at = materialize(at, "substring-shifts")
    joined = docs.join(at, (F.col("doc_id") == F.col(key)) & (own == F.col(h)), "left").drop(key, h)
    return joined.withColumn(shift, F.coalesce(shift, F.lit(0))), shift, facts["size"]


def _remove(docs: DataFrame, hits: DataFrame, shift: str | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words outside all repeated windows, joined by a blank."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", shift)]
    key, places, packed, begins = (free_name(names, c) for c in ("key", "places", "packed", "begins"))
    per_doc = hits.select(F.col("doc").alias(key), F.col("places").alias(places))
    carried = [c for c in names if c != "text"]
    moved = _squeezed(docs.select(*carried, (F.col(shift) if shift else F.lit(0)).alias(begins), F.col("text").alias(packed)), packed)
    joined = moved.join(per_doc, F.col("doc_id") == F.col(key), "left").drop(key)
    source = docs.select(*names)

    def run(batches):
        for batch in batches:
            for start, stop, texts in _opened(batch.column(packed)):
                part = batch.slice(start, stop - start)
                n_words, n_removed, kept = [], [], []
                for text, found, begin in zip(texts, part.column(places).to_pylist(), part.column(begins).to_pylist()):
                    words = (text or b"").split()
                    left = _without(words, np.frombuffer(found, np.int32).astype(np.int64) - begin) if found and words else words
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                own = {c: part.column(c) for c in carried} | {"text": pa.array(texts, pa.binary()).cast(pa.string())}
                added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(own[c] for c in names), *added], names=[*names, "n_words", "n_removed", "kept"])
            release()

    added = StructType.fromDDL("n_words long, n_removed long, kept string").fields
    return joined.mapInArrow(run, StructType([*source.schema.fields, *added]))


def dedupe_batch(docs: DataFrame, index: FingerprintIndex, earlier: DataFrame | None = None) -> DataFrame:
    """The batch without passages that ``earlier`` documents or a smaller document of the batch have; the batch joins the index.

    ``earlier`` are the documents of the batches before, whose ids must be smaller for a window to go from the later one.
    """
    index.ingest(docs)
    docs, shift, _ = _shifted(docs)
    every = docs.select("doc_id", "text", (F.col(shift) if shift else F.lit(0)).alias("shift"))
    if earlier is not None:
        every = every.unionByName(earlier.select("doc_id", "text", F.lit(0).alias("shift")))
    return _remove(docs, repeated_windows(every, index.candidates(), index.buckets, "shift"), shift)


def dedupe(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """A whole table through an empty index, in batches of rising ids; all of them are verified together.

    Without an index of the caller's one is made, of buckets of BUCKET_BYTES of text, and deleted again.
    """
    shifted, shift, size = _shifted(docs)
    own = index is None
    if own:
        at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index = FingerprintIndex(docs.sparkSession, max(at_least, -(-size // BUCKET_BYTES)))
    cuts = [k / batches for k in range(1, batches)]
    bounds = docs.select(F.col("doc_id").cast("double").alias("i")).approxQuantile("i", cuts, 0.01)
    edges = sorted({int(b) for b in bounds})
    for low, high in zip([None, *edges], [*edges, None]):
        over = F.lit(True) if low is None else F.col("doc_id") > low
        index.ingest(docs.where(over if high is None else over & (F.col("doc_id") <= high)))
    hits = materialize(repeated_windows(shifted, index.candidates(), index.buckets, shift), "substring-places")
    if own:
        remove_folder(docs.sparkSession, index.path)
    return _remove(shifted, hits, shift)


def substring_report(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The contract's digest of :func:`dedupe`."""
    docs = docs.select("doc_id", "text")
    found = dedupe(docs, FingerprintIndex(docs.sparkSession, buckets) if buckets else None)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
