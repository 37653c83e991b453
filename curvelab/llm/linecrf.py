"""Document quality by a linear-chain conditional random field over lines.

A text is a chain of its lines, each good or bad. A line's evidence comes from
its own measures and those of the lines before and after it; transitions
between good and bad are learned. Forward-backward gives each line's marginal
probability of being good; their mean by line length, calibrated on the
training documents, is the document's score.

The field is fitted on a bounded hash sample of labelled documents that are not
held out (``SAMPLE`` of them), every line taking its document's label. Of a
document with more than ``SAMPLE_LINES`` lines, so many successive ones are learned
from, at a place that a hash of doc_id names; with both bounds the driver gets
600,000 lines at the most. Every text is scored whole.

Defined results: an empty table gives no rows; further columns are not read; texts are measured
in chunks of ``CHUNK`` bytes, of a longer one whole lines at a time, of which some forty bytes a line are kept, so a text must fit a
task and its longest line eightfold; its chain is passed through in pieces of ``PIECE`` lines at once; null and empty texts are one empty line and get a score;
without labels to learn from, of both kinds, every score is 0.5; rows with a null
doc_id count as held out; a document with several labels is learned from with
each; repeated rows are scored alike; labels, lang, source and doc_id do not
enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.llm.langid import held_out

#: Documents that the field is fitted on at most, and successive lines of one of them.
SAMPLE, SAMPLE_LINES = 3000, 200
#: A document is predicted good from this score.
THRESHOLD = 0.3
#: Bytes of text that are measured at once (a longer line is measured alone), and lines of a chain that are passed through in turn.
CHUNK, PIECE = 1 << 20, 4096
STEPS, RATE, DECAY = 120, 0.08, 1e-3

_UPPER, _LOWER, _DIGIT, _BLANK, _SYMBOL, _PIPE, _BANG, _PUNCT, _TAIL, _HIGH = range(10)
_FIELD = 21  # bits of a counter; three to a word, and a line of over 2 MB is counted in pieces
_PER = 3


def _tables() -> list[np.ndarray]:
    kind = np.full(256, -1, np.int64)
    kind[ord("A") : ord("Z") + 1], kind[ord("a") : ord("z") + 1], kind[ord("0") : ord("9") + 1] = _UPPER, _LOWER, _DIGIT
    for chars, k in ((b" \t\n\r\x0b\x0c", _BLANK), (b"#*$%&<>{}[]=\\^~_@/+", _SYMBOL), (b"|", _PIPE), (b"!?", _BANG), (b".,;:'\"()-", _PUNCT)):
        kind[list(chars)] = k
    kind[0x80:0xC0], kind[0xC0:] = _TAIL, _HIGH
    out = []
    for w in range(0, 10, _PER):
        out.append(np.array([1 << _FIELD * (k - w) if w <= k < w + _PER else 0 for k in kind.tolist()], np.uint64))
    return out


_COUNTERS = _tables()
_SALT = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(12).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(b" \t\n\r\x0b\x0c")] = True
OWN, AGAIN = 24, 19  # a line's own measures; which of them tells whether it is equal to an earlier one
FEATURES = 3 * OWN + 1


def _own(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """(measures of every line but AGAIN, bytes of every line, lines of each text, hash of every line, 0 for a blank one)."""
    flat = np.frombuffer(b"".join([(t or b"") + b"\n" for t in texts]), np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts
    doc_ends = np.cumsum([len(t or b"") + 1 for t in texts])
    lines = np.diff(np.concatenate(([0], np.searchsorted(ends, doc_ends - 1) + 1)))

    counts = np.zeros((10, len(ends)), np.float64)
    pieces = np.unique(np.concatenate((starts, np.arange(0, len(flat), 1 << 20))))
    line_of = np.searchsorted(starts, pieces, side="right") - 1
    for w, table in enumerate(_COUNTERS):
        sums = np.add.reduceat(table[flat], pieces)
        for k in range(min(_PER, 10 - w * _PER)):
            part = (sums >> np.uint64(_FIELD * k)) & np.uint64((1 << _FIELD) - 1)
            np.add.at(counts[w * _PER + k], line_of, part.astype(np.float64))
    counts[_BLANK] -= 1  # the line feed itself

    solid = ~_IS_BLANK[flat]
    first = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    last = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False])))
    words = np.bincount(np.searchsorted(ends, first), minlength=len(ends)).astype(np.float64)
    same1, same2 = np.zeros(len(ends)), np.zeros(len(ends))
    line_hash = np.zeros(len(ends), np.uint64)
    if len(first):
        letters = np.flatnonzero(solid)
        place = letters - np.repeat(first, last - first + 1)
        h = np.add.reduceat(_SALT[flat[letters]] * _PLACE[place & 63] * (place // 64 + 1).astype(np.uint64), np.concatenate(([0], np.cumsum(last - first + 1)[:-1])))
        h ^= h >> np.uint64(29)
        at = np.searchsorted(ends, first)
        one = np.flatnonzero((h[1:] == h[:-1]) & (at[1:] == at[:-1])) + 1
        two = np.flatnonzero((h[2:] == h[:-2]) & (at[2:] == at[:-2])) + 2
        same1 += np.bincount(at[one], minlength=len(ends))
        same2 += np.bincount(at[two], minlength=len(ends))
        np.add.at(line_hash, at, h * (np.arange(len(h), dtype=np.uint64) - np.searchsorted(at, at).astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15))
        line_hash[(line_hash == 0) & (words > 0)] = 1

    n = np.maximum(sizes, 1)
    c, w = counts / n, np.maximum(words, 1)
    letters_share = c[_UPPER] + c[_LOWER] + c[_HIGH]
    upper = counts[_UPPER] / np.maximum(counts[_UPPER] + counts[_LOWER], 1)
    closing = flat[np.maximum(ends - 1, 0)]
    own = np.stack([
        np.log1p(sizes) / 8, np.log1p(words) / 6, sizes / w / 10, letters_share, upper, upper > 0.3, c[_DIGIT] * 5, c[_DIGIT] > 0.1,
        c[_SYMBOL] * 10, c[_SYMBOL] > 0.02, c[_SYMBOL] > 0.08, c[_PIPE] * 20, counts[_PIPE] / w > 0.3, c[_BANG] * 20, counts[_BANG] / w > 0.3, c[_PUNCT] * 10,
        same1 / w, same1 / w > 0.2, same2 / w, np.zeros(len(ends)), words == 0, (sizes > 0) & ((closing == 46) | (closing == 33) | (closing == 63)), c[_BLANK] * 3, words < 4,
    ], axis=1).astype(np.float32)
    return own, sizes, lines, line_hash


def _again(doc: np.ndarray, line_hash: np.ndarray) -> np.ndarray:
    """Whether a line that is not blank is equal to an earlier one of its text."""
    order = np.lexsort((line_hash, doc))
    out = np.zeros(len(order), bool)
    out[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (line_hash[order[1:]] == line_hash[order[:-1]]) & (line_hash[order[1:]] != 0)
    return out


def measure(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, bytes of every line, lines of each text)."""
    own, sizes, lines, line_hash = _own(texts)
    doc = np.repeat(np.arange(len(texts)), lines)
    own[:, AGAIN] = _again(doc, line_hash)
    before, after = np.zeros_like(own), np.zeros_like(own)
    inside = doc[1:] == doc[:-1]
    before[1:][inside], after[:-1][inside] = own[:-1][inside], own[1:][inside]
    return np.concatenate((own, before, after, np.ones((len(own), 1), np.float32)), axis=1), sizes, lines


def windows(text: bytes) -> Iterator[bytes]:
    """A text in whole lines of CHUNK bytes or the line that is longer; joined by line feeds they are the text."""
    at = 0
    while at <= len(text):
        end = text.find(b"\n", min(at + CHUNK, len(text)))
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def evidence_of(text: bytes, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, bytes) of every line of a long text: what measure and w give, without its lines' features at once."""
    sums, sizes, hashes = [], [], []
    parts = np.stack((w[:OWN], w[OWN : 2 * OWN], w[2 * OWN : 3 * OWN]), axis=1)
    for window in windows(text):
        own, n, _, h = _own([window])
        sums.append(own @ parts)
        sizes.append(n)
        hashes.append(h)
    e, h = np.concatenate(sums), np.concatenate(hashes)
    e += _again(np.zeros(len(h), np.int8), h)[:, None] * parts[AGAIN]
    out = e[:, 0] + w[-1]
    out[1:] += e[:-1, 1]
    out[:-1] += e[1:, 2]
    return out, np.concatenate(sizes)


def stretch(text: bytes | None, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, bytes) of SAMPLE_LINES successive lines of a text, as measure gives them, at a place that h names."""
    text = text or b""
    hashes = np.concatenate([_own([window])[3] for window in windows(text)])
    at = h % max(1, len(hashes) - SAMPLE_LINES + 1)
    first, last = max(0, at - 1), min(len(hashes), at + SAMPLE_LINES + 1)  # with the lines beside them
    again = _again(np.zeros(len(hashes), np.int8), hashes)[first:last]
    kept, seen = [], 0
    for window in windows(text):
        n = window.count(b"\n") + 1
        if seen < last and seen + n > first:
            kept += window.split(b"\n")[max(0, first - seen) : last - seen]
        seen += n
    x, sizes, _ = measure([b"\n".join(kept)])
    x[:, AGAIN], x[1:, OWN + AGAIN], x[:-1, 2 * OWN + AGAIN] = again, again[:-1], again[1:]
    return x[at - first :][:SAMPLE_LINES], sizes[at - first :][:SAMPLE_LINES]


@dataclass
class Field:
    """w: a line's evidence for good over bad; trans[a, b]: log weight of label b after a (0 bad, 1 good); first: log odds of the first line; slope, shift: calibration."""

    w: np.ndarray
    trans: np.ndarray
    first: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, mean: np.ndarray) -> np.ndarray:
        m = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(m / (1 - m)) + self.shift, -60, 60)))


def pieces_of(evidence: np.ndarray, lines: np.ndarray, field: Field, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, enter, leave) of the pieces of ``piece`` lines that chains are cut into: the probability of good before a piece's first
    line (none for a chain's first piece) and the message of good over bad that comes back to its last one. Every piece is a matrix,
    the product of its lines' steps, through which the messages pass."""
    n = -(-lines // piece)
    sizes = np.full(n.sum(), piece)
    ends = np.cumsum(n) - 1
    sizes[ends] = lines - (n - 1) * piece
    begins = np.zeros(len(sizes), bool)
    begins[ends - n + 1] = True
    starts = np.cumsum(sizes) - sizes
    a, good = np.exp(field.trans), np.exp(np.clip(evidence, -30, 30))
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(piece), side="left")
    m = np.tile(np.eye(2), (len(sizes), 1, 1))  # rows and columns: good, bad
    for t in range(piece):
        at = order[: active[t]]
        old = m[at]
        new = np.stack((a[1, 1] * old[:, 0] + a[0, 1] * old[:, 1], a[1, 0] * old[:, 0] + a[0, 0] * old[:, 1]), axis=1)
        if t == 0:
            new[begins[at]] = np.eye(2)
        new[:, 0] *= good[starts[at] + t, None]
        m[at] = new / new.max(axis=(1, 2), keepdims=True)
    enter, leave = np.full(len(sizes), np.nan), np.ones(len(sizes))
    for e, k in zip(ends[n > 1].tolist(), n[n > 1].tolist(), strict=True):
        v, b = np.array([np.exp(field.first), 1.0]), np.ones(2)
        for i in range(e - k + 1, e):
            v = m[i] @ v
            v /= v.sum()
            enter[i + 1] = v[0]
        for i in range(e, e - k + 1, -1):
            b = m[i].T @ b
            b /= b.sum()
            leave[i - 1] = b[0] / b[1]
    return sizes, enter, leave


def marginals(evidence: np.ndarray, lines: np.ndarray, field: Field, pairs: bool = False, piece: int = PIECE) -> tuple:
    """The probability of good for every line, by forward-backward over all chains at once, longer ones in pieces; with ``pairs``, also
    the expected transitions, of chains that are not cut."""
    enter = leave = None
    if not pairs and lines.max(initial=0) > piece:
        lines, enter, leave = pieces_of(evidence, lines, field, piece)
    order = np.argsort(-lines, kind="stable")
    offset = np.concatenate(([0], np.cumsum(lines)[:-1]))[order]
    longest = int(lines.max(initial=0))
    active = np.searchsorted(-lines[order], -np.arange(longest), side="left")  # chains longer than t
    a = np.exp(field.trans)
    good = np.exp(np.clip(evidence, -30, 30))
    fwd, bwd = np.zeros(len(evidence)), np.ones(len(evidence))
    p = None
    for t in range(longest):
        at = offset[: active[t]] + t
        if t == 0:
            up, down = np.full(len(at), np.exp(field.first)), np.ones(len(at))
            if enter is not None:
                q = enter[order[: active[0]]]
                up, down = np.where(np.isnan(q), up, q * a[1, 1] + (1 - q) * a[0, 1]), np.where(np.isnan(q), down, q * a[1, 0] + (1 - q) * a[0, 0])
        else:
            q = p[: active[t]]
            up, down = q * a[1, 1] + (1 - q) * a[0, 1], q * a[1, 0] + (1 - q) * a[0, 0]
        up = up * good[at]
        p = up / (up + down)
        fwd[at] = p
    ratio = np.ones(len(lines))  # backward message of good over bad
    if leave is not None:
        ratio = leave[order]
        bwd[offset + lines[order] - 1] = ratio
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]
        at = offset[:k] + t
        nxt = ratio[:k] * good[at + 1]
        ratio[:k] = (a[1, 1] * nxt + a[1, 0]) / (a[0, 1] * nxt + a[0, 0])
        bwd[at] = ratio[:k]
    marg = fwd * bwd / (fwd * bwd + (1 - fwd))
    if not pairs:
        return (marg,)
    expected, firsts = np.zeros((2, 2)), offset[: active[0]] if longest else np.empty(0, np.int64)
    inner = np.ones(len(evidence), bool)
    inner[offset[lines[order] > 0] + lines[order][lines[order] > 0] - 1] = False
    at = np.flatnonzero(inner)
    nxt = bwd[at + 1] * good[at + 1]
    z = fwd[at] * (a[1, 1] * nxt + a[1, 0]) + (1 - fwd[at]) * (a[0, 1] * nxt + a[0, 0])
    expected[1, 1], expected[1, 0] = (fwd[at] * a[1, 1] * nxt / z).sum(), (fwd[at] * a[1, 0] / z).sum()
    expected[0, 1], expected[0, 0] = ((1 - fwd[at]) * a[0, 1] * nxt / z).sum(), ((1 - fwd[at]) * a[0, 0] / z).sum()
    return marg, expected, marg[firsts].sum(), len(firsts)


def by_length(marg: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
    weight = sizes + 1.0
    starts = np.concatenate(([0], np.cumsum(lines)[:-1]))
    return np.add.reduceat(marg * weight, starts) / np.add.reduceat(weight, starts)


def fit(x: np.ndarray, sizes: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum conditional likelihood by Adam over whole chains; then Platt calibration of the documents' means."""
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)), 0.0)
    y = np.repeat(labels, lines).astype(np.float64)
    same = (lines - 1).clip(0)
    observed = np.array([[same[labels == 0].sum(), 0.0], [0.0, same[labels == 1].sum()]])
    m, v = np.zeros(x.shape[1] + 5), np.zeros(x.shape[1] + 5)
    total = max(1, len(x))
    for step in range(1, STEPS + 1):
        marg, expected, first, n_first = marginals(x @ field.w, lines, field, pairs=True)
        g = np.concatenate((x.T @ (y - marg) / total - DECAY * field.w, ((observed - expected) / total - DECAY * field.trans).ravel(), [(labels.sum() - first) / max(1, n_first)]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.w += d[: x.shape[1]]
        field.trans += d[x.shape[1] : -1].reshape(2, 2)
        field.first += d[-1]
    mean = np.clip(by_length(marginals(x @ field.w, lines, field)[0], sizes, lines), 1e-6, 1 - 1e-6)
    z, t = np.log(mean / (1 - mean)), labels
    for _ in range(50):  # Newton on two numbers, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(field.slope * z + field.shift, -60, 60)))
        r, q = t - p, p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1, (q * z).sum()], [(q * z).sum(), q.sum() + 1]])
        d = np.linalg.solve(h, np.array([(r * z).sum() - (field.slope - 1), r.sum() - field.shift]))
        field.slope, field.shift = field.slope + d[0], field.shift + d[1]
        if np.abs(d).max() < 1e-9:
            break
    return field


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field from a bounded sample of the labelled rows that are not held out; None if it lacks good or bad ones."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample)  # so many rows at most: it may be broadcast
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("binary").alias("text"), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, t, q in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                x, sizes = stretch(t.as_py(), h)
                out.append((x.tobytes(), sizes.astype(np.int64).tobytes()))
            yield pa.record_batch([b.column(0), pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary()), b.column(2)], names=["h", "x", "sizes", "quality"])

    # stretches, not texts, are put in order
    got = rows.mapInArrow(run, "h long, x binary, sizes binary, quality int").orderBy("h", "quality", "sizes", "x").limit(sample).collect()
    y = np.array([r["quality"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got])
    sizes = [np.frombuffer(r["sizes"], np.int64) for r in got]
    return fit(x, np.concatenate(sizes), np.array([len(s) for s in sizes]), y)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, lines) for every row of ``docs``."""
    field = learn(docs, labels, sample)

    def scores(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        x, sizes, lines = measure(texts)
        if field is None:
            return np.full(len(texts), 0.5), lines
        marg = marginals(x @ field.w.astype(np.float32), lines, field)[0]
        return field.score(by_length(marg, sizes, lines)), lines

    def long_score(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if field is None:
            return np.array([0.5]), np.array([text.count(b"\n") + 1])
        e, sizes = evidence_of(text, field.w.astype(np.float32))
        lines = np.array([len(e)])
        return field.score(by_length(marginals(e, lines, field)[0], sizes, lines)), lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, held, parts = [], 0, []
            for t in b.column(2):
                text = t.as_py()
                if len(text or b"") <= CHUNK:
                    texts.append(text)
                    held += len(text or b"")
                if texts and (held >= CHUNK or len(text or b"") > CHUNK):
                    parts.append(scores(texts))
                    texts, held = [], 0
                if len(text or b"") > CHUNK:
                    parts.append(long_score(text))
            if texts:
                parts.append(scores(texts))
            s = np.concatenate([p[0] for p in parts] or [np.empty(0)])
            n = np.concatenate([p[1] for p in parts] or [np.empty(0, np.int64)]).astype(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(n)], names=["doc_id", "held_out", "score", "predicted", "lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, lines long")
