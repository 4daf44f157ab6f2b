"""Byte-level BPE encoding and decoding over a pair occurrence index.

The distinct pieces of a slice of texts form one symbol sequence. An index maps each adjacent pair to all its positions;
the active ranks (merges whose pair occurs) are applied in ascending order, each to its whole list of positions at once,
and the lists of the pairs that a merge makes are updated. Texts are then put together from their pieces.

Defined results: a null text is an empty one; empty texts have no tokens; special tokens in a text become their own id,
as the tokenizer file says; repeated rows give repeated rows; other columns are left alone, but for one of the name that the
result is to have, which is replaced.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import release, sha256_hex, slices

#: The published pre-tokenizer pattern of byte-level BPE, with white space by its Unicode property.
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A blank beside other white space or at an end of the text; such texts are cut into pieces as a whole.
_NOT_PLAIN = r" [\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}] |\A | \z"
_NONE = np.array([], np.int32)
_PIECE = regex.compile(PIECE)
#: Bytes of text whose pieces are merged together: some forty times as many bytes of memory are in use meanwhile.
SLICE = 3 << 20


def byte_letters() -> list[str]:
    """The letter of each byte: printable ones are themselves, others take the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(256)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Token bytes and ids, and merges by rank as arrays sorted by pair."""

    def __init__(self, source: str):
        spec = json.loads(source)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([ids[c] for c in byte_letters()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


@functools.lru_cache(maxsize=2)
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def merge_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after the other, and the offsets of each piece in them."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n = int(bounds[-1])
    symbol = vocab.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.arange(1, n + 1)  # the next symbol of the same piece, n at its end
    after[bounds[1:][lengths > 0] - 1] = n
    before = np.arange(-1, n - 1)
    before[bounds[:-1][lengths > 0]] = -1
    symbol = np.append(symbol, -1)
    fresh = np.zeros(n + 1, bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(at: np.ndarray) -> None:
        """Put the pairs that begin at these positions into the index."""
        at = at[after[at] < n]
        rank = vocab.ranks(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, where in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else (), np.split(at, cuts)):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(where)

    add(np.arange(n))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = vocab.left[rank], vocab.right[rank]
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
        if not len(at):
            continue
        if a == b:  # in a run of equal symbols every second pair merges, from the left
            at = np.sort(at)
            follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
            head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = after[at]
        symbol[at] = vocab.made[rank]
        symbol[gone] = -1
        after[at] = after[gone]
        has = after[at] < n
        before[after[at][has]] = at[has]
        left = before[at]
        left = left[left >= 0]
        fresh[at] = True
        left = left[~fresh[left]]
        fresh[at] = False
        add(np.concatenate([at, left]))
    kept = symbol[:n] >= 0
    return symbol[:n][kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


class Encoded:
    """A slice of texts as numbers of parts (offsets, numbers) and the ids of each part (bounds, ids)."""

    def __init__(self, vocab: Vocabulary, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        rough = pc.match_substring_regex(texts, _NOT_PLAIN)
        for token in vocab.special:
            rough = pc.or_(rough, pc.match_substring(texts, token))
        rough = np.asarray(rough)
        self.parts: list = []
        of_text: list[np.ndarray] = [_NONE] * len(texts)
        self._plain(texts.filter(pa.array(~rough)), np.flatnonzero(~rough), of_text)
        self._rough(vocab, texts.filter(pa.array(rough)), np.flatnonzero(rough), of_text)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in of_text])]).astype(np.int64)
        self.numbers = np.concatenate([_NONE, *of_text])
        self._merge(vocab)

    def _plain(self, texts: pa.Array, at: np.ndarray, of_text: list) -> None:
        """A blank between two characters that are no white space always begins a piece: split there."""
        split = pc.split_pattern(texts, " ")
        words, offsets = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
        if not len(at):
            return
        offsets = offsets - offsets[0]
        coded = words.dictionary_encode()
        numbers = np.array(coded.indices, dtype=np.int32)
        self.parts = [" " + w for w in coded.dictionary.to_pylist()]
        firsts: dict[str, int] = {}
        base = len(self.parts)
        own = words.take(pa.array(offsets[:-1])).to_pylist()
        numbers[offsets[:-1]] = [base + firsts.setdefault(w, len(firsts)) for w in own]
        self.parts += firsts
        for i, x in zip(at.tolist(), np.split(numbers, offsets[1:-1]), strict=True):
            of_text[i] = x

    def _rough(self, vocab: Vocabulary, texts: pa.Array, at: np.ndarray, of_text: list) -> None:
        seen: dict = {}
        base = len(self.parts)
        for i, text in zip(at.tolist(), texts.to_pylist(), strict=True):
            parts = vocab.split.split(text) if vocab.split is not None else [text]
            found = [c for x in parts if x for c in ([(x,)] if x in vocab.special else _PIECE.findall(x))]
            of_text[i] = np.array([base + seen.setdefault(c, len(seen)) for c in found], np.int32)
        self.parts += seen

    def _merge(self, vocab: Vocabulary) -> None:
        """Pieces of the distinct parts, encoded together; a special token is a part of one id."""
        pieces: dict[str, int] = {}
        use, count, special = [], [], []
        for k, part in enumerate(self.parts):
            if isinstance(part, tuple):
                special.append((k, vocab.special[part[0]]))
                count.append(0)
                continue
            found = _PIECE.findall(part)
            use += [pieces.setdefault(x, len(pieces)) for x in found]
            count.append(len(found))
        ids, bounds = merge_pieces([x.encode("utf-8", "surrogatepass") for x in pieces], vocab)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        taken = lists.take(pa.array(use, pa.int32()))
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.bounds = np.asarray(taken.offsets, dtype=np.int64)[ends] if len(use) else ends
        self.ids = np.asarray(taken.flatten()) if len(use) else np.array([], np.int32)
        if special:
            at = np.array([k for k, _ in special])
            self.ids = np.insert(self.ids, self.bounds[at], [i for _, i in special])
            self.bounds = self.bounds + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(count)), at))])

    def lists(self) -> pa.ListArray:
        """Ids of each part."""
        return pa.ListArray.from_arrays(pa.array(self.bounds, pa.int32()), pa.array(self.ids, pa.int32()))

    def per_text(self, values: pa.Array) -> pa.ListArray:
        """A value of each part, gathered for each text."""
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), values.take(pa.array(self.numbers)))

    def token_lists(self) -> pa.ListArray:
        nested = self.lists().take(pa.array(self.numbers))
        ends = np.asarray(nested.offsets, dtype=np.int64)[self.offsets]
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), nested.flatten())


def _vocabulary_of(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return vocabulary(f.read())


def _ship(docs: DataFrame, tokenizer: str) -> str:
    """Send the tokenizer file to all executors, once; gives its name there."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    return tokenizer.rsplit("/", 1)[-1]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in the array column ``ids``; ``tokenizer`` is the file's path."""
    name = _ship(docs, tokenizer)
    names = [c for c in docs.columns if c != ids]

    def run(batches):
        vocab = _vocabulary_of(name)
        for batch in batches:
            batch = batch.select(names)
            for start, stop in slices(batch.column(text), SLICE):
                part = batch.slice(start, stop - start)
                got = Encoded(vocab, part.column(text)).token_lists()
                yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*names, ids])
                release()

    source = docs.select(*names)
    return source.mapInArrow(run, StructType([*source.schema.fields, *StructType.fromDDL(f"{ids} array<int>").fields]))


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the ids in column ``text``; bytes that are no UTF-8 become U+FFFD; null ids are none."""
    name = _ship(tokens, tokenizer)
    names = [c for c in tokens.columns if c != text]

    def run(batches):
        table = pa.array(_vocabulary_of(name).token_bytes, pa.binary())
        for batch in batches:
            batch = batch.select(names)
            lists = batch.column(ids)
            raw = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, table.take(lists.values)), b"")
            got = [(x or b"").decode("utf-8", "replace") for x in raw.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*names, text])

    source = tokens.select(*names)
    return source.mapInArrow(run, StructType([*source.schema.fields, *StructType.fromDDL(f"{text} string").fields]))


def round_trip_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's digest: ids and decoded text of every whole text, hashed as they are made."""
    name = _ship(docs, tokenizer)

    def run(batches):
        vocab = _vocabulary_of(name)
        names = pa.array([str(i) for i in range(vocab.size)])
        raw = pa.array(vocab.token_bytes, pa.binary())
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                part = batch.slice(start, stop - start)
                got = Encoded(vocab, part.column("text"))
                bounds, ids = pa.array(got.bounds, pa.int32()), pa.array(got.ids)
                said = pc.binary_join(pa.ListArray.from_arrays(bounds, names.take(ids)), ",")
                back = pc.binary_join(pa.ListArray.from_arrays(bounds, raw.take(ids)), b"")
                sums = np.concatenate([[0], np.cumsum(np.diff(got.bounds)[got.numbers])])
                coded = pc.binary_join(got.per_text(said), ",").to_pylist()
                decoded = pc.binary_join(got.per_text(back), b"").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(sums[got.offsets]), pa.int64()),
                        pa.array([sha256_hex(x.encode()) for x in coded]),
                        pa.array([sha256_hex(x.decode("utf-8", "replace").encode()) for x in decoded]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            release()

    source = docs.select("doc_id", "text")
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, StructType([source.schema["doc_id"], *StructType.fromDDL(kind).fields]))
