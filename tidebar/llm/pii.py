"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy, in one task, from labelled spans of a bounded sample of documents: windows round base
matches, round other digits and at random, and the same windows with a match written in a way the patterns miss (a
telephone number without ``+``, an address with ``at`` and ``dot``, a card number with points), drawn by hash from whole texts.

Whole texts are cut into overlapping windows for the network. Each character takes its emissions from the window in which
it is farthest from an edge, and one search for the best label path goes over the whole text, so no span is cut where
windows meet. Most characters cannot leave label 0 in any best path, whatever else happens; only the stretches between
them are searched. The network's spans are added to those of the patterns, which stay; one that touches a base span, or
lacks what its kind must have, is left out.

Defined results: null texts are empty ones; empty texts have no spans; repeated rows give repeated rows and are learnt
from once; with no document to learn from only base spans are found; other columns are left alone, but for columns named
base or added (redacted in :func:`redact`), which are replaced.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import release, slices
from .recurrent import Adam, lstm, lstm_back, lstm_run

KINDS = ("email", "ip", "card", "phone")
#: Different texts that are learnt from, at most, and windows of one kind that are drawn from each whole text, at most.
SAMPLE_DOCS, PER_TEXT = 1500, 8
#: Characters of a training window; of a decoded window, and from its start to the next one's.
TRAIN_WINDOW, WINDOW, STRIDE = 80, 768, 720
SYMBOLS, STATE, LABELS = 130, 8, 2 * len(KINDS) + 1
EPOCHS, BATCH, RATE, SEED, PER_KIND = 12, 64, 0.02, 11, 250
#: Windows scored at once, all padded to one length, a multiple of PAD; characters whose emissions are at hand at once.
DECODED, PAD, BLOCK = 1024, 128, 1 << 21

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, each found from its ``@``: a local part reaches back at most to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


#: The symbol of each code point up to the end of the Latin letters.
_SYMBOL = np.where(np.arange(0x251) < 128, np.arange(0x251), 128)
_SYMBOL[-1] = 129


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four patterns, leftmost and non-overlapping per kind, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def symbols(text: str) -> np.ndarray:
    """ASCII characters are themselves, other letters 128, all else 129."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(a, 0x250)]


# --- training windows -------------------------------------------------------------------------------------------


def _variant(kind: int, span: str, rng: np.random.Generator) -> str | None:
    """The same datum in a form that the base patterns miss."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == 0:
        local, _, domain = span.partition("@")
        at, dot = pick((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", "."))
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", pick("[.]", " . ", "(.)"))
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        return pick(".", "/", "_").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if len(digits) < 10:
        return None
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits[:-10]} {a} {b} {c}", f"1 ({a}) {b}-{c}", f"{a}.{b}.{c}")


def _labels(size: int, spans: list) -> np.ndarray:
    """0 outside; 1 + 2 kind at a span's first character, 2 + 2 kind inside; earlier kinds go first where spans overlap."""
    y = np.zeros(size, np.int64)
    for start, kind, end in sorted(spans, key=lambda s: -s[1]):
        y[start:end] = 2 + 2 * kind
        y[start] = 1 + 2 * kind
    return y


def text_windows(text: str) -> list[tuple[int, bytes, bytes]]:
    """(group, symbols, labels) of windows of a text, at most ``PER_TEXT`` of each group, drawn from all of it.

    Groups are base matches by kind, rewritten ones by kind, windows round other digits, and windows anywhere.
    """
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) ^ SEED)
    draw = lambda n: rng.permutation(n)[:PER_TEXT]
    spans, out = base_spans(text), []
    starts, ends = np.array([s for s, _, _ in spans], np.int64), np.array([e for _, _, e in spans], np.int64)
    free = lambda low, high: not ((starts < high) & (ends > low)).any()

    def put(group: int, window: str, own: list) -> None:
        out.append((group, symbols(window.ljust(TRAIN_WINDOW)).astype(np.uint8).tobytes(), _labels(TRAIN_WINDOW, own).astype(np.uint8).tobytes()))

    for kind in range(len(KINDS)):
        every = [s for s in spans if s[1] == kind and s[2] - s[0] <= TRAIN_WINDOW // 2]
        for start, _, end in (every[i] for i in draw(len(every))):
            left = max(0, start - int(rng.integers(5, TRAIN_WINDOW - (end - start) - 4)))
            put(kind, text[left : left + TRAIN_WINDOW], [(s - left, k, e - left) for s, k, e in spans if s >= left and e <= left + TRAIN_WINDOW])
            other = _variant(kind, text[start:end], rng)
            if other and ((starts < end) & (ends > start)).sum() == 1 and free(left, start):
                near = text[left:start] + other + text[end : end + TRAIN_WINDOW]
                put(len(KINDS) + kind, near[:TRAIN_WINDOW], [(start - left, kind, min(TRAIN_WINDOW, start - left + len(other)))])
    digits = [m.start() for m in _DIGIT.finditer(text)]
    for i in draw(len(digits))[: PER_TEXT // 4]:
        left = max(0, digits[i] - int(rng.integers(5, TRAIN_WINDOW - 5)))
        if free(left, left + TRAIN_WINDOW):
            put(2 * len(KINDS), text[left : left + TRAIN_WINDOW], [])
    if len(text) > TRAIN_WINDOW:
        left = int(rng.integers(len(text) - TRAIN_WINDOW))
        if free(left, left + TRAIN_WINDOW):
            put(2 * len(KINDS) + 1, text[left : left + TRAIN_WINDOW], [])
    return out


def training_windows(windows: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels (window, place) of at most ``PER_KIND`` windows of each group."""
    rng, chosen = np.random.default_rng(SEED), []
    for group in range(2 * len(KINDS) + 2):
        own = sorted(w for w in windows if w[0] == group)
        chosen += [own[i] for i in rng.permutation(len(own))[:PER_KIND]]
    both = [np.frombuffer(b"".join(w[k] for w in chosen), np.uint8).reshape(-1, TRAIN_WINDOW).astype(np.int64) for k in (1, 2)]
    return both[0], both[1]


# --- network ----------------------------------------------------------------------------------------------------


class Tagger:
    def __init__(self, params: dict | None = None):
        rng = np.random.default_rng(SEED)
        small = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.p = params or {
            "t0": small(SYMBOLS, 4 * STATE), "u0": small(STATE, 4 * STATE),
            "t1": small(SYMBOLS, 4 * STATE), "u1": small(STATE, 4 * STATE),
            "out": small(2 * STATE, LABELS), "bias": np.zeros(LABELS, np.float32),
            "trans": small(LABELS, LABELS), "begin": small(LABELS),
        }

    def emissions(self, x: np.ndarray, keep: bool = False):
        """(time, batch, label) for symbols (batch, time)."""
        fwd = np.ascontiguousarray(x.T)
        a, kept0 = lstm(self.p["t0"], fwd, self.p["u0"], keep)
        b, kept1 = lstm(self.p["t1"], fwd[::-1], self.p["u1"], keep)
        h = np.concatenate([a, b[::-1]], axis=2)
        return h @ self.p["out"] + self.p["bias"], (fwd, h, kept0, kept1)

    def loss_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of the label paths under the CRF, and its gradients."""
        p, (batch, steps) = self.p, x.shape
        e, (fwd, h, kept0, kept1) = self.emissions(x, True)
        trans = np.exp(p["trans"] - p["trans"].max()).astype(np.float64)
        top = e.max(2, keepdims=True)
        b = np.exp((e - top).astype(np.float64))
        alpha, beta, scale = np.empty_like(b), np.ones_like(b), np.empty((steps, batch))
        for t in range(steps):
            a = b[t] * (np.exp(p["begin"].astype(np.float64)) if t == 0 else alpha[t - 1] @ trans)
            scale[t] = a.sum(1)
            alpha[t] = a / scale[t][:, None]
        for t in range(steps - 2, -1, -1):
            beta[t] = (b[t + 1] * beta[t + 1]) @ trans.T / scale[t + 1][:, None]
        mass = alpha * beta
        mass /= mass.sum(2, keepdims=True)
        path = y.T
        log_z = np.log(scale).sum(0) + top[:, :, 0].sum(0) + (steps - 1) * p["trans"].max()
        gold = np.take_along_axis(e, path[:, :, None], 2)[:, :, 0].sum(0) + p["begin"][path[0]]
        gold = gold + p["trans"][path[:-1], path[1:]].sum(0)
        d_e = mass.copy()
        np.put_along_axis(d_e, path[:, :, None], np.take_along_axis(d_e, path[:, :, None], 2) - 1, 2)
        right = b[1:] * beta[1:] / scale[1:, :, None]
        d_trans = np.einsum("tbi,tbj->ij", alpha[:-1], right) * trans
        np.add.at(d_trans, (path[:-1].ravel(), path[1:].ravel()), -1)
        d_begin = mass[0].sum(0) - np.bincount(path[0], minlength=LABELS)
        d_e = (d_e / batch).astype(np.float32)
        g = {"trans": (d_trans / batch).astype(np.float32), "begin": (d_begin / batch).astype(np.float32)}
        g["out"], g["bias"] = np.einsum("tbh,tbl->hl", h, d_e), d_e.sum((0, 1))
        d_h = d_e @ p["out"].T
        dx0, g["u0"] = lstm_back(np.ascontiguousarray(d_h[:, :, :STATE]), kept0, p["u0"])
        dx1, g["u1"] = lstm_back(np.ascontiguousarray(d_h[::-1, :, STATE:]), kept1, p["u1"])
        for name, dx, at in (("t0", dx0, fwd), ("t1", dx1, fwd[::-1])):
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], at.ravel(), dx.reshape(-1, 4 * STATE))
        return float((log_z - gold).mean()), g

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Emissions (label, time, batch) for symbols (batch, time)."""
        p = self.p
        fwd = np.ascontiguousarray(x.T)
        states = np.empty((2 * STATE, *fwd.shape), np.float32)
        lstm_run(p["t0"], fwd, p["u0"], states[:STATE])
        lstm_run(p["t1"], fwd[::-1], p["u1"], states[STATE:, ::-1])
        e = np.ascontiguousarray(p["out"].T) @ states.reshape(2 * STATE, -1)
        e += p["bias"][:, None]
        return e.reshape(LABELS, *fwd.shape)

    def open_places(self, lead: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which characters may leave label 0. ``lead``: by how much label 0 leads each character's other labels.

        A run of m characters without label 0 loses that label's lead in each of them, and its m + 1 transitions win at
        most ``enter``, m - 1 times ``stay`` and ``leave`` over those of label 0. Characters that no run of their text can
        pay for are label 0 whatever else happens.
        """
        trans, p = self.p["trans"] - self.p["trans"][0, 0], self.p
        stay = float(trans[1:, 1:].max())
        enter = max(float(trans[0, 1:].max()), float(p["begin"][1:].max() - p["begin"][0]))
        leave = max(float(trans[1:, 0].max()), 0.0)
        sizes = np.diff(offsets)
        total = np.cumsum(stay - lead.astype(np.float64))  # over the run from its text's start up to a character
        total -= np.repeat(np.append(0, total)[offsets[:-1]], sizes)
        fall = np.repeat(np.arange(len(sizes)), sizes) * (2 * np.abs(total).max(initial=0) + 1.0)  # so that texts stay apart
        begin = total - (stay - lead)
        before = np.minimum.accumulate(begin - fall)
        after = np.maximum.accumulate((total - fall)[::-1])[::-1]
        return after - before + (enter + leave - stay) > -1e-3  # the best run through each character

    def _viterbi(self, e: np.ndarray, real: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """(stretch, place) for emissions (place, stretch, label); a ``closed`` stretch begins with label 0."""
        steps, n, _ = e.shape
        score = self.p["begin"] + e[0]
        score[closed, 1:] = -1e9
        back = np.empty((steps, n, LABELS), np.int8)
        same = np.arange(LABELS, dtype=np.int8)
        for t in range(1, steps):
            options = score[:, :, None] + self.p["trans"]
            there = real[t][:, None]
            back[t] = np.where(there, options.argmax(1), same)
            score = np.where(there, options.max(1) + e[t], score)
        path = np.empty((n, steps), np.int64)
        path[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        return path


def train(windows: list[tuple[int, bytes, bytes]]) -> dict | None:
    x, y = training_windows(windows)
    if not len(x) or not y.any():
        return None
    net, rng = Tagger(), np.random.default_rng(SEED)
    adam = Adam(net.p, RATE)
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - 0.9 * epoch / EPOCHS)
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            own = order[i : i + BATCH]
            adam.update(net.loss_gradients(x[own], y[own])[1])
    return net.p


# --- whole texts ------------------------------------------------------------------------------------------------


class Emissions:
    """Emissions of the characters of some texts, one after the other, stitched from overlapping windows."""

    def __init__(self, net: Tagger, texts: list[str]):
        self.net = net
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = symbols("".join(texts))
        count = np.where(sizes > 0, np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)), 0)
        text = np.repeat(np.arange(len(sizes)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        edge = (WINDOW - STRIDE) // 2  # the half of an overlap that is nearer to a window's middle is its own
        self.first = self.offsets[text] + k * STRIDE
        self.end = np.minimum(self.first + WINDOW, self.offsets[text + 1])
        self.own_from = np.where(k == 0, self.first, self.first + edge)
        self.own_to = np.append(self.own_from[1:], len(self.flat))

    def over(self, low: int, high: int):
        """(characters, their columns, emissions) of the windows that own the characters from ``low`` to ``high``."""
        windows = np.arange(np.searchsorted(self.own_to, low, side="right"), np.searchsorted(self.own_from, high))
        width = -(-(self.end - self.first)[windows] // PAD) * PAD
        for w in np.unique(width):
            same = windows[width == w]
            for i in range(0, len(same), DECODED):
                batch = same[i : i + DECODED]
                place = self.first[batch][:, None] + np.arange(w)
                x = self.flat[np.minimum(place, len(self.flat) - 1)]
                x[place >= self.end[batch][:, None]] = 32
                count = self.own_to[batch] - self.own_from[batch]
                row = np.repeat(np.arange(len(batch)), count)
                own = np.arange(len(row)) + np.repeat(self.own_from[batch] - (np.cumsum(count) - count), count)
                yield own, (own - self.first[batch][row]) * len(batch) + row, self.net.scores(x).reshape(LABELS, -1)


def _lead(e: np.ndarray) -> np.ndarray:
    best = e[1].copy()
    for other in e[2:]:
        np.maximum(best, other, out=best)
    return e[0] - best


def label_texts(net: Tagger, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labels of all characters of all texts, one after the other, and the offset of each text.

    The best path is that of the whole text. Its emissions are held for ``BLOCK`` characters and the stretch at their end;
    of longer texts they are made again where there are stretches to be searched.
    """
    every = Emissions(net, texts)
    n, offsets = len(every.flat), every.offsets
    labels, lead = np.zeros(n, np.int64), np.zeros(n, np.float32)
    whole = n <= BLOCK
    column, parts, held = np.zeros(n if whole else 0, np.int64), [], 0
    for low in range(0, n, BLOCK):
        for place, at, e in every.over(low, min(n, low + BLOCK)):
            lead[place] = _lead(e)[at]
            if whole:
                column[place] = at + held
                held += e.shape[1]
                parts.append(e)
    open_ = net.open_places(lead, offsets)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    starts = np.flatnonzero(open_ & (begins[:-1] | ~np.append(False, open_[:-1])))
    stops = np.flatnonzero(open_ & (begins[1:] | ~np.append(open_[1:], False))) + 1
    # with the closed character on either side, which is label 0
    text = np.searchsorted(offsets, starts, side="right") - 1
    closed, low = starts > offsets[text], np.maximum(starts - 1, offsets[text])
    high = np.minimum(stops + 1, offsets[text + 1])
    if whole:
        if len(starts):
            search_stretches(net, np.concatenate(parts, axis=1), column, low, high, closed, labels)
        return labels, offsets
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(low, low[at] + BLOCK)))
        base, end = low[at], high[stop - 1]
        own = np.empty((LABELS, end - base), np.float32)
        for place, columns, e in every.over(base, end):
            inside = (place >= base) & (place < end)
            own[:, place[inside] - base] = e[:, columns[inside]]
        search_stretches(net, own, np.arange(end - base), low[at:stop] - base, high[at:stop] - base, closed[at:stop], labels[base:end])
        at = stop
    return labels, offsets


def search_stretches(net: Tagger, e: np.ndarray, column: np.ndarray, low: np.ndarray, high: np.ndarray, closed: np.ndarray, labels: np.ndarray) -> None:
    """Best labels of these stretches; ``e`` (label, column) has the emissions of each place in its ``column``; a ``closed`` stretch begins with label 0."""
    size = high - low
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):  # stretches of like length together, about a million places at most or one stretch
        own = order[at : at + 1024]
        own = own[: max(1, int(np.searchsorted(size[own] * np.arange(1, len(own) + 1), 1 << 20, side="right")))]
        at += len(own)
        place = low[own][:, None] + np.arange(size[own].max())
        real = place < high[own][:, None]
        path = net._viterbi(e[:, column[np.where(real, place, 0)]].transpose(2, 1, 0), real.T, closed[own])
        labels[place[real]] = path[real]


def _plausible(kind: int, span: str) -> bool:
    digits = re.findall("[0-9]+", span)
    n = sum(map(len, digits))
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9].*(@|\bat\b).*(\.|\bdot\b).*[A-Za-z]", span))
    if kind == 1:
        return len(digits) == 4 and all(len(d) <= 3 and int(d) <= 255 for d in digits) and not re.search("[A-Za-z]", span)
    if re.search("[A-Za-z]", span):
        return False
    if kind == 2:
        return 14 <= n <= 19 and _luhn("".join(digits))
    return 10 <= n <= 15 and bool(re.search("[^0-9]", span))


def label_spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled runs: a run begins at a first-character label or where the kind changes."""
    kind = np.where(labels > 0, (labels - 1) // 2, -1)
    begins = (labels % 2 == 1) | (np.diff(kind, prepend=-1) != 0)
    starts = np.flatnonzero(begins & (kind >= 0))
    cuts = np.append(np.flatnonzero(begins | (kind < 0)), len(labels))
    ends = cuts[np.searchsorted(cuts, starts, side="right")]
    return list(zip(starts.tolist(), kind[starts].tolist(), ends.tolist()))


def find_spans(net: Tagger | None, texts: list[str]) -> tuple[list, list]:
    """For each text its base spans and the spans added by the network."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if net is None:
        return base, added
    labels, offsets = label_texts(net, texts)
    marked = np.flatnonzero(labels)
    touched = np.unique(np.searchsorted(offsets, marked, side="right") - 1) if len(marked) else []
    for i in touched:
        text = texts[i]
        for start, kind, end in label_spans(labels[offsets[i] : offsets[i + 1]]):
            span = text[start:end]
            start, end = start + len(span) - len(span.lstrip()), end - (len(span) - len(span.rstrip()))
            if not any(s < end and e > start for s, _, e in base[i]) and _plausible(kind, text[start:end]):
                added[i].append((start, kind, end))
    return base, added


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def fit(docs: DataFrame) -> bytes | None:
    """Weights learnt in one task from windows of at most ``SAMPLE_DOCS`` different texts with digits, chosen by a hash of the text."""
    digits = docs.where(F.col("text").rlike("[0-9]")).select(F.xxhash64("text").alias("h"), "text")
    hashes = digits.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)
    chosen = digits.join(F.broadcast(hashes), "h").groupBy("h").agg(F.min("text").alias("text"))

    def cut(batches):
        for batch in batches:
            rows = [w for t in batch.column("text").to_pylist() for w in text_windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "x", "y"])

    def learn(batches):
        windows = [w for b in batches for w in zip(*(b.column(c).to_pylist() for c in ("part", "x", "y")))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(windows))], pa.binary())], names=["weights"])
        release()

    found = chosen.mapInArrow(cut, "part int, x binary, y binary").repartition(1).mapInArrow(learn, "weights binary").collect()
    return bytes(found[0][0]) if found else None


_SPANS = "base array<struct<start:int,kind:string,end:int>>, added array<struct<start:int,kind:string,end:int>>"


def find_pii(docs: DataFrame, weights: bytes | None = None) -> DataFrame:
    """``docs`` with the spans of the patterns (base) and of the network (added); no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else fit(docs))
    names = [c for c in docs.columns if c not in ("base", "added")]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches):
        params = pickle.loads(held.value) if held.value else None
        net = Tagger(params) if params else None
        for batch in batches:
            batch = batch.select(names)
            for start, stop in slices(batch.column("text"), BLOCK):
                part = batch.slice(start, stop - start)
                both = find_spans(net, [t or "" for t in part.column("text").to_pylist()])
                columns = [
                    pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in spans], kind)
                    for spans in both
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, "base", "added"])
            release()

    source = docs.select(*names)
    return source.mapInArrow(run, StructType([*source.schema.fields, *StructType.fromDDL(_SPANS).fields]))


def redact(found: DataFrame) -> DataFrame:
    """Adds ``redacted``: the text with each span, overlapping ones together, replaced by its kind in brackets."""

    names = [c for c in found.columns if c != "redacted"]

    def run(batches):
        for batch in batches:
            batch = batch.select(names)
            for start, stop in slices(batch.column("text")):
                own, out = batch.slice(start, stop - start), []
                for text, base, added in zip(*(own.column(c).to_pylist() for c in ("text", "base", "added"))):
                    parts, done = [], 0
                    for s in sorted(base + added, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= done:
                            parts += [text[done : s["start"]], f"[{s['kind']}]"]
                        done = max(done, s["end"])
                    out.append(None if text is None else "".join([*parts, text[done:]]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.string())], names=[*own.schema.names, "redacted"])

    return found.mapInArrow(run, StructType([*found.select(*names).schema.fields, *StructType.fromDDL("redacted string").fields]))


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`find_pii`."""
    found = find_pii(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    say = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        F.concat("base", "added"),
        lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"]),
    )
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(say(F.col("base")), 256).alias("base_sha256"),
        say(F.sort_array(keyed)).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
