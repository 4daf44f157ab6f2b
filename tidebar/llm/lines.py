"""Line deduplication by a log-template tree.

Lines end at U+000A; tokens are runs of other than U+0020 and U+0009 to U+000D. Tokens that hold a digit are variable from
the start and read ``<*>``; the others are words. A line so read is a shape.

A shape goes down a tree of fixed depth: the number of tokens, then two leading tokens. As fields may stand where a
line begins, a line leads in three ways, by its first, its middle and its last two tokens: three trees. In a leaf, shapes
are merged into a template where they agree in all but some words: of each word it is known how many different shapes of
the leaf have it at that place, and words that fewer than 2, 4, 8, ... shapes have become variable together, as long as no
more than a third of a line's words do and ``LEAST_FIXED`` are left. A field of which no value is in more than half of the shapes of
a template is told from the words around it at one of these steps, whatever its values do elsewhere in the corpus, and
also where several fields stand side by side. Each line thus has a few templates in each leaf.

A template recurs if it is in ``MIN_DOCS`` documents at least, as does a shape itself; a line of ``EXACT_TOKENS`` tokens and more, too
long to be equal by chance, also if the line itself, digits included, is in ``EXACT_DOCS``. Recurring lines are dropped from every
document but the one with the smallest id that has the template, so what is said once stays somewhere. Documents stay,
also those without lines left. Keys are hashes: n of them make n * n / 2**64 false matches.

A leaf of fewer than ``MIN_DOCS`` rows of documents cannot hold a recurring template: its lines stay where they are, told by a bit
map of the other leaves (of ``LEAF_BITS`` at most, so some lines of theirs come along, whose templates recur nowhere). One tree after
the other, lines go to their leaves once, as text; leaves are dealt into buckets of about ``BUCKET`` lines, in which words are counted
as arrays. A larger leaf is dealt into several buckets by shape: each counts its words, a row for each different one, and gets back what
all of them counted. So a tree moves a line at most twice, however many leaves are crowded, and no bucket grows with its leaf.

Defined results: a null text stays null, null and empty texts have no lines; blank lines and lines of digits alone are no templates
and count as lines; rows with a null id are compared, and lose recurring lines, but are nobody's first document; repeated
rows of one id are one document; other columns are left alone, but for columns named n_lines, n_dropped or kept, which are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, free_name, materialize, release, slices, spread_join, word_codes
from .hashing import mix, span_hashes

#: Documents in which a template recurs, and in which a long line itself does, at least.
MIN_DOCS, EXACT_DOCS = 10, 2
#: Fixed words that a template needs; one word in so many of a line may be variable.
LEAST_FIXED, VARIABLE = 3, 3
#: Tokens of a line that is no coincidence.
EXACT_TOKENS = 13
#: Lines of a bucket, about, and of a leaf that is not dealt out; at most so many leaves are, or larger ones only.
BUCKET, DEALT = 8192, 1 << 16
#: Bits of the map of crowded leaves.
LEAF_BITS = 26

_MARKS = "doc_id long, shape long, exact long, leaves array<long>, told boolean, line string"
_LINES = "bucket long, dealt boolean, leaf long, shape long, line string"


def _token_hashes(vocab: pa.Array) -> np.ndarray:
    wide = vocab.cast(pa.large_string())
    if not len(wide):
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(wide.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return span_hashes(raw, bounds[:-1] - bounds[0], bounds[1:] - bounds[0])


class Lines:
    """The tokens of some lines, and hashes of their shapes and leaves."""

    def __init__(self, lines: pa.Array):
        self.lines = lines
        self.offsets, codes, vocab = word_codes(lines)
        self.sizes = np.diff(self.offsets)
        self.line = np.repeat(np.arange(len(self.sizes)), self.sizes)
        place = np.arange(len(codes)) - self.offsets[self.line]
        at = mix(place.astype(np.uint64) + np.uint64(1))
        self.word = ~np.asarray(pc.match_substring_regex(vocab, "[0-9]"), dtype=bool)[codes]
        #: What each token says at its place, digits included; and what it says in a shape.
        self.full = mix(_token_hashes(vocab)[codes] + at)
        self.said = np.where(self.word, self.full, mix(at))
        self.words = np.bincount(self.line, weights=self.word, minlength=len(self.sizes)).astype(np.int64)

    def _sums(self, said: np.ndarray, kind: int) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(said)])
        total = total[self.offsets[1:]] - total[self.offsets[:-1]]
        return mix(mix(total + self.sizes.astype(np.uint64)) + np.uint64(kind))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each line its shape, even, and the line itself, odd; and whether it has the one (a word) and the other (a long line)."""
        shape = self._sums(self.said, 0) >> np.uint64(1) << np.uint64(1)
        exact = self._sums(self.full, 1) | np.uint64(1)
        return shape.view(np.int64), exact.view(np.int64), self.words > 0, self.sizes >= EXACT_TOKENS

    def leaves(self, lines: np.ndarray) -> np.ndarray:
        """(line, tree): the leaves of the chosen lines, which have four tokens at least."""
        n, first = self.sizes[lines], self.offsets[lines]
        out = np.empty((len(lines), 3), np.uint64)
        for tree, lead in enumerate((np.zeros_like(n), n // 2 - 1, n - 2)):
            at = self.said[first + lead] + self.said[first + lead + 1]
            out[:, tree] = mix(mix(at + n.astype(np.uint64)) + np.uint64(tree + 1))
        return out.view(np.int64)


def _lines_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    ends = np.asarray(split.offsets, dtype=np.int64)
    return ends - ends[0], split.flatten()


def _marks(docs: DataFrame) -> DataFrame:
    """The different lines of each row of ``docs`` that have a shape or are long; a line is written out once a slice for its shape."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for start, stop in slices(batch.column("text")):
                of_text, split = _lines_of(batch.column("text").slice(start, stop - start))
                own = Lines(split)
                shape, exact, has_shape, long = own.keys()
                shape, exact = np.where(has_shape, shape, 0), np.where(long, exact, 0)
                text = np.searchsorted(of_text, np.arange(len(shape)), side="right") - 1
                at = np.flatnonzero(has_shape | long)
                order = at[np.lexsort((exact[at], shape[at], text[at]))]
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(text[order]) != 0) | (np.diff(shape[order]) != 0) | (np.diff(exact[order]) != 0)
                at = order[new]
                # templates mask a word and leave LEAST_FIXED
                deep = own.words[at] > LEAST_FIXED
                counts = np.where(deep, 3, 0)
                leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(own.leaves(at[deep]).ravel()))
                first = np.zeros(len(at), bool)
                first[np.unique(shape[at], return_index=True)[1]] = True
                said = pc.if_else(pa.array(first & deep), split.take(pa.array(at)), pa.scalar(None, pa.string()))
                columns = [
                    ids.slice(start, stop - start).take(pa.array(text[at])),
                    pa.array(shape[at], mask=~has_shape[at]),
                    pa.array(exact[at], mask=~long[at]),
                    leaves,
                    pc.is_valid(said),
                    said,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MARKS.split(", ")])
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MARKS)


class Crowded:
    """The leaves that may hold recurring templates, as a bit map of the first bits of each, and the buckets of their lines."""

    def __init__(self, leaves: DataFrame):
        n, told = leaves.agg(F.count("*"), F.coalesce(F.sum("told"), F.lit(0))).first()
        self.bits = min(LEAF_BITS, max(12, n.bit_length() + 6))
        self.buckets = max(1, told // (3 * BUCKET))
        at = F.shiftrightunsigned("leaf", 64 - self.bits)
        words = leaves.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(leaf, {64 - self.bits}) & 63 as int))")).alias("bits"))
        found = words.toArrow()
        self.map = np.zeros(1 << self.bits - 6, np.uint64)
        self.map[np.asarray(found["word"])] = np.asarray(found["bits"]).view(np.uint64)
        # large leaves are few, whatever the input
        large = leaves.where(F.col("told") > max(BUCKET, told // DEALT)).select("leaf", "told").toArrow().sort_by("leaf")
        self.large, self.parts = np.asarray(large["leaf"], dtype=np.int64), np.asarray(large["told"], dtype=np.int64) // BUCKET + 1

    def has(self, leaf: np.ndarray) -> np.ndarray:
        at = leaf.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.map[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def deal(self, leaf: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each line, and whether its leaf has several."""
        parts = np.ones(len(leaf), np.int64)
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, leaf), len(self.large) - 1)
            parts = np.where(self.large[at] == leaf, self.parts[at], 1)
        part = mix(shape.view(np.uint64)) % parts.astype(np.uint64)
        bucket = mix(leaf.view(np.uint64) + mix(part)) % np.uint64(self.buckets)
        return bucket.view(np.int64), parts > 1


def _tree_lines(marks: DataFrame, tree: int, crowded) -> DataFrame:
    """The lines of crowded leaves of one tree, with their buckets."""

    def run(batches):
        own = crowded.value
        for batch in batches:
            leaf = np.asarray(batch.column("leaf"))
            has = own.has(leaf)
            if has.any():
                shape = np.asarray(batch.column("shape"))[has]
                bucket, dealt = own.deal(leaf[has], shape)
                columns = [pa.array(bucket), pa.array(dealt), pa.array(leaf[has]), pa.array(shape), batch.column("line").filter(pa.array(has))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _LINES.split(", ")])
        release()

    return marks.where("told").select("shape", F.col("leaves")[tree].alias("leaf"), "line").mapInArrow(run, _LINES)


class Bucket:
    """The words of the different shapes of each leaf in a bucket."""

    def __init__(self, rows: pa.Table):
        leaf, shape = np.asarray(rows["leaf"]), np.asarray(rows["shape"])
        order = np.lexsort((shape, leaf))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(leaf[order]) != 0) | (np.diff(shape[order]) != 0)
        at = order[new]
        self.leaf, self.shape = leaf[at].view(np.uint64), shape[at]
        lines = pa.array([], pa.string()) if not len(at) else pa.concat_arrays(rows["line"].take(pa.array(at)).chunks)
        self.words = np.zeros(len(at), np.int64)
        shapes, said = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for start, stop in slices(lines):
            own = Lines(lines.slice(start, stop - start))
            self.words[start:stop] = own.words
            shapes.append(own.line[own.word] + start)
            said.append(own.said[own.word])
        #: Of each word its shape's row and what it says; and its leaf, place and self as one hash.
        self.row, self.said = np.concatenate(shapes), np.concatenate(said)
        self.triple = mix(self.said ^ mix(self.leaf)[self.row])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.triple, return_counts=True)

    def templates(self, triples: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shape, key) of each template, given in how many shapes each of the (sorted) triples is."""
        n = shapes[np.searchsorted(triples, self.triple)]
        row, said = self.row, self.said
        before, out_shape, out_key = self.words, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        least = 2
        while len(n):
            stays = n >= least
            row, said, n = row[stays], said[stays], n[stays]
            fixed = np.bincount(row, minlength=len(self.words))
            variable = self.words - fixed
            good = (variable > 0) & (variable * VARIABLE <= self.words) & (fixed >= LEAST_FIXED) & (fixed < before)
            if good.any():
                first = np.cumsum(fixed) - fixed
                # a good row has words, so each span that is summed is one row's
                held = np.flatnonzero(fixed)
                sums = np.zeros(len(self.words), np.uint64)
                sums[held] = np.bitwise_xor.reduceat(said, first[held])
                out_shape.append(self.shape[good])
                out_key.append(mix(mix(sums[good]) + self.leaf[good]))
            before, least = fixed, 2 * least
        return np.concatenate(out_shape), np.concatenate(out_key).view(np.int64)


def _keys(bucket: Bucket, triples: np.ndarray, shapes: np.ndarray) -> pa.Table:
    shape, key = bucket.templates(triples, shapes)
    return pa.table([pa.array(shape), pa.array(key)], names=["shape", "key"])


def _whole_leaves(rows: pa.Table) -> pa.Table:
    own = Bucket(rows)
    return _keys(own, *own.counts())


def _dealt_counts(rows: pa.Table) -> pa.Table:
    triples, n = Bucket(rows).counts()
    bucket = np.full(len(triples), rows["bucket"][0].as_py(), np.int64)
    return pa.table([pa.array(bucket), pa.array(triples.view(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "triple", "n"])


def _dealt_leaves(rows: pa.Table, counts: pa.Table) -> pa.Table:
    triples = np.asarray(counts["triple"], dtype=np.int64).view(np.uint64)
    order = np.argsort(triples)
    return _keys(Bucket(rows), triples[order], np.asarray(counts["shapes"], dtype=np.int64)[order])


def shape_templates(marks: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """shape and keys: the templates of each shape that has any, apart from itself."""
    each = marks.where("shape is not null").select("doc_id", "shape", "told", F.explode("leaves").alias("leaf"))
    # rows stand for documents, which are no more; the templates' own documents are counted later
    some = each.groupBy("leaf").agg(F.count("doc_id").alias("docs"), F.count_if("told").alias("told"), F.min("shape").alias("low"), F.max("shape").alias("high"))
    leaves = materialize(some.where((F.col("docs") >= min_docs) & (F.col("low") < F.col("high"))).select("leaf", "told"), "line-leaves")
    known = Crowded(leaves)
    crowded = marks.sparkSession.sparkContext.broadcast(known)
    made = []
    for tree in range(3):
        lines = _tree_lines(marks, tree, crowded)
        made.append(materialize(lines.where("not dealt").groupBy("bucket").applyInArrow(_whole_leaves, "shape long, key long"), "line-keys"))
        if len(known.large):
            dealt = materialize(lines.where("dealt"), "line-dealt")
            parts = materialize(dealt.groupBy("bucket").applyInArrow(_dealt_counts, "bucket long, triple long, n long"), "line-words")
            # a triple is in no more rows than its leaf has buckets
            sums = parts.groupBy("triple").agg(F.sum("n").alias("shapes"))
            back = parts.select("bucket", "triple").join(sums, "triple")
            both = dealt.groupBy("bucket").cogroup(back.groupBy("bucket"))
            made.append(materialize(both.applyInArrow(_dealt_leaves, "shape long, key long"), "line-keys"))
            discard(dealt, parts)
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    out = materialize(every.groupBy("shape").agg(F.collect_set("key").alias("keys")), "line-keys")
    crowded.destroy()
    discard(leaves, *made)
    return out


def _firsts(rows: DataFrame, key: str, least: int) -> DataFrame:
    """key, rows, and the smallest id as first_doc of the keys in ``least`` documents at least."""
    rest = [F.count("*").alias("rows"), F.min("doc_id").alias("first_doc")]
    if least <= 2:  # two documents have two ids
        several = F.max("doc_id") > F.min("doc_id") if least == 2 else F.count("doc_id") >= least
        return rows.groupBy(key).agg(several.alias("several"), *rest).where(F.col("several") & F.col("first_doc").isNotNull()).drop("several")
    found = rows.groupBy(key).agg(F.count_distinct("doc_id").alias("docs"), *rest)
    return found.where((F.col("docs") >= least) & F.col("first_doc").isNotNull()).drop("docs")


def recurring_lines(marks: DataFrame, min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS) -> DataFrame:
    """key, rows, low and high: the shapes (even) and long lines (odd) that recur, and the least and the greatest first document
    of their recurring templates. A document that is both keeps the line."""
    lines = marks.where("shape is not null").select("doc_id", "shape")
    held = lines.groupBy("shape").agg(F.count("*").alias("rows"))
    found = shape_templates(marks, min_docs)
    keys = materialize(found.join(held, "shape"), "line-sizes")
    of_docs = spread_join(lines, keys, ["shape"], "rows", marks.count(), F.col("doc_id")).select("doc_id", F.explode("keys").alias("key"))
    templates = materialize(_firsts(of_docs, "key", min_docs).drop("rows"), "line-templates")
    back = keys.select("shape", "rows", F.explode("keys").alias("key"))
    # a template of very many shapes makes a skewed join, which adaptive execution splits
    merged = back.join(templates, "key").select("shape", "rows", "first_doc")
    whole = _firsts(lines, "shape", min_docs).select("shape", "rows", "first_doc")
    long = marks.where("exact is not null").select("doc_id", "exact")
    exact = _firsts(long, "exact", exact_docs).select(F.col("exact").alias("key"), "rows", "first_doc")
    every = merged.unionByName(whole).withColumnRenamed("shape", "key").unionByName(exact)
    ends = every.groupBy("key").agg(F.max("rows").alias("rows"), F.min("first_doc").alias("low"), F.max("first_doc").alias("high"))
    out = materialize(ends, "line-firsts")
    discard(found, keys, templates)
    return out


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """``docs`` with the number of lines, of those dropped, and the text without lines of templates that recur, by these names."""
    carried = [c for c in docs.columns if c not in names]
    doc, gone = (free_name([*carried, *names], c) for c in ("doc", "gone"))
    marks = materialize(_marks(docs), "line-marks")
    found = recurring_lines(marks, min_docs, exact_docs)
    # each document's own recurring lines, but for those it is the first document of
    said = marks.select("doc_id", F.explode(F.array_compact(F.array("shape", "exact"))).alias("key"))
    own = spread_join(said, found.hint("shuffle_hash"), ["key"], "rows", marks.count(), F.col("doc_id")).where("doc_id is null or doc_id <> low or doc_id <> high")
    hits = materialize(own.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("key").alias(gone)), "line-hits")
    discard(marks, found)
    joined = docs.select(*carried).join(hits.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(doc)), "left").drop(doc)

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                texts, lists = part.column("text"), part.column(gone)
                # null and empty texts have no lines
                full = np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
                n_lines = np.where(full, np.asarray(pc.fill_null(pc.count_substring(texts, "\n"), 0)) + 1, 0)
                n_dropped, kept = np.zeros(len(part), np.int64), texts
                sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                hit = full & (sizes > 0)
                if hit.any():  # only these texts are taken apart
                    of_text, split = _lines_of(texts.filter(pa.array(hit)))
                    sizes = sizes[hit]
                    said = np.asarray(lists.filter(pa.array(hit)).flatten(), dtype=np.int64).view(np.uint64)
                    asked = said ^ mix(np.repeat(np.arange(len(sizes), dtype=np.uint64) + np.uint64(1), sizes))
                    shape, exact, has_shape, long = Lines(split).keys()
                    text = mix(np.repeat(np.arange(len(sizes), dtype=np.uint64) + np.uint64(1), np.diff(of_text)))
                    drop = has_shape & np.isin(shape.view(np.uint64) ^ text, asked) | long & np.isin(exact.view(np.uint64) ^ text, asked)
                    n_dropped[hit] = np.diff(np.concatenate([[0], np.cumsum(drop)])[of_text])
                    left = np.concatenate([[0], np.cumsum(~drop)])[of_text]
                    rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), split.filter(pa.array(~drop))), "\n")
                    kept = pc.replace_with_mask(texts, pa.array(hit), rest)
                added = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), kept]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *added], names=[*carried, *names])
                release()

    fields = StructType.fromDDL("`{}` long, `{}` long, `{}` string".format(*names)).fields
    return joined.mapInArrow(run, StructType([*docs.select(*carried).schema.fields, *fields]))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    found = drop_recurring_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
