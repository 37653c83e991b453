"""Substring deduplication by paragraph MinHash banding.

A paragraph is a line of ``SHINGLE`` words or more, or any ``PARAGRAPH`` = 31
successive words, whatever lines they lie in.

Lines have ``BANDS`` bands of ``ROWS`` minima over five-word shingles, tuned so that a
pair with Jaccard similarity 0.8 collides with probability 0.9992. Colliding lines
are joined, their exact Jaccard similarity is verified, and links are clustered by
components.

Of 31 successive words the key is the least hash of their twenty runs of
``RUN_WORDS`` words: a MinHash of one row, which neighbouring paragraphs share, so
that a text has about one key, its seed, in ten words, and equal paragraphs have
equal seeds wherever they stand. Colliding paragraphs are joined with the first
of them by doc_id and verified word by word: seeds of one pair of documents are
joined where the words between them are equal too, and both ends are extended to
where the texts part. What so is found equal is joined over edits of ``SLACK``
words at most where the Jaccard similarity of the whole stays at 0.8 or more, and
a passage counts from 31 equal words, or 31 words at that similarity, on.

Of each cluster that lies in two rows or more, the smallest doc_id keeps its
occurrence; the others are to be removed. A passage is one row for each document
that keeps it; its cluster is what shares words in the keeper. Where part of a
passage also stands in a smaller document, that part's seeds belong to the smaller
one, and of the words next to it those within ``WINDOW`` of a seed of their own are found.

Copies are never compared or expanded. Equal texts are one before anything
else: the one with the smallest doc_id goes on, and of the others the whole
text is a row of kind ``text``. Equal lines are one row before they are banded; only
buckets with two different lines go on, and a bucket gives a spanning forest.
Large buckets are compared in pairs of blocks by separate tasks.

Defined results: null and empty texts have no paragraphs, an empty table no rows;
rows with a repeated doc_id keep or lose an occurrence together; of equal doc_ids
the row that was read first keeps; a null doc_id keeps only where no other row has
an id; words are lower-cased (A-Z) and separated by the six ASCII blanks; repeats
within one row do not count; repeats of less than ``RUN_WORDS`` words have seeds at
their first round only; texts are hashed in chunks of ``CHUNK`` bytes, a longer one
alone and whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelab.llm.common import Stored, maybe_in, stored
from curvelab.llm.components import components, forest

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
REACH, RUN_WORDS = 5, 12
#: Successive seeds of a text begin so many words apart at most.
WINDOW = 20
PARAGRAPH = RUN_WORDS + WINDOW - 1
#: Words that an edit inside a passage may replace, put in or leave out.
SLACK = 5
#: Bytes of text that are hashed at once; different lines of a bucket that one task compares.
CHUNK, BLOCK = 1 << 20, 256

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(21)
_SALT = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sequence_hash(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes, by their places in it."""
    place = np.arange(len(h)) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(_mixed(h + _STEP * place.astype(np.uint64)) * _PLACE[place & 1023], starts) + sizes.astype(np.uint64))


class Words:
    """The words of a batch of texts: hashes, places, and five-word shingles."""

    def __init__(self, texts: list[bytes | None]):
        raw = np.frombuffer(b"".join([(t or b"") + b"\n" for t in texts]), np.uint8)
        doc_ends = np.cumsum([len(t or b"") + 1 for t in texts])
        solid = ~_IS_BLANK[raw]
        self.first = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
        self.last = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False])))
        self.n = len(self.first)
        self.doc = np.searchsorted(doc_ends, self.first, side="right")
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        base = chars[np.concatenate(([0], doc_ends[:-1]))]
        self.start, self.end = chars[self.first] - base[self.doc], chars[self.last + 1] - base[self.doc]
        feeds = np.concatenate(([0], np.cumsum(raw == 10)))
        self.line = feeds[self.first]  # numbers lines through the batch
        if self.n:
            sizes = self.last - self.first + 1
            letters = np.flatnonzero(solid)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.hash = _sequence_hash(_SALT[_LOWER[raw[letters]]], starts, sizes)
            self.shingle = self.grams(SHINGLE)

    def grams(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each one on; _NONE where its document has fewer."""
        m = max(0, self.n - size + 1)
        s = self.hash[:m].copy()
        for k in range(1, size):
            s = s * _STEP + self.hash[k : m + k]
        out = np.full(self.n, _NONE)
        whole = np.flatnonzero(self.doc[:m] == self.doc[size - 1 :][:m])
        out[whole] = _mixed(s[whole])
        return out

    def runs(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, words) of the runs that begin where ``cut`` is set."""
        starts = np.flatnonzero(cut)
        return starts, np.diff(np.append(starts, self.n))

    def line_hash(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of lines, apart from those of blocks."""
        return _mixed(_sequence_hash(self.hash, starts, sizes) ^ _STEP).view(np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(np.concatenate(([True], (self.line[1:] != self.line[:-1]) | (self.doc[1:] != self.doc[:-1]))))

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Content-defined: a block begins where the shingle's hash is less than the ones before it and at most the ones after it, within reach and the document."""
        new = np.concatenate(([True], self.doc[1:] != self.doc[:-1]))
        # documents are set apart by empty places, so that none reaches into its neighbours
        at = np.arange(self.n) + REACH * (np.cumsum(new) - 1) + REACH
        h = np.full(at[-1] + 1 + REACH, _NONE)
        h[at] = self.shingle
        cut = self.shingle != _NONE
        for k in range(1, REACH + 1):
            cut &= (self.shingle < h[at - k]) & (self.shingle <= h[at + k])
        return self.runs(cut | new)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash of RUN_WORDS words, words to the next seed or the document's end, their hash)."""
        new = np.concatenate(([True], self.doc[1:] != self.doc[:-1]))
        at = np.arange(self.n) + WINDOW * np.cumsum(new)
        h = np.full(at[-1] + 1 + WINDOW, _NONE)
        h[at] = self.grams(RUN_WORDS)
        real = h != _NONE
        window = real[: len(h) - WINDOW + 1] & real[WINDOW - 1 :]
        window[at[new]] = real[at[new]]  # a short document is one window
        first = np.flatnonzero(window)
        least = np.unique(first + np.lib.stride_tricks.sliding_window_view(h, WINDOW)[first].argmin(axis=1))
        for k in range(1, RUN_WORDS):
            least = least[h[least] != h[least - k]]
        cut = np.zeros(self.n, bool)
        cut[np.searchsorted(at, least)] = True
        starts, sizes = self.runs(cut | new)
        seed = cut[starts]
        return starts[seed], h[least].view(np.int64), sizes[seed], _sequence_hash(self.hash, starts, sizes).view(np.int64)[seed]

    def in_document(self, words: np.ndarray) -> np.ndarray:
        """Places of words in their documents."""
        return words - np.searchsorted(self.doc, self.doc[words])

    def minima(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """BANDS keys for each run of SHINGLE words or more, of the shingles within it."""
        inner = np.concatenate([np.arange(s, s + n - SHINGLE + 1) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        x, at = self.shingle[inner], np.concatenate(([0], np.cumsum(sizes - SHINGLE + 1)[:-1]))
        keys = []
        for b in range(BANDS):
            key = np.full(len(starts), b + 1, np.uint64)
            for r in range(ROWS):
                y = x * _MULTIPLY[b * ROWS + r]
                key = _mixed(key * _STEP + np.minimum.reduceat(y ^ (y >> np.uint64(32)), at))
            keys.append(key)
        return np.stack(keys, axis=1)


KEYS = [f"k{b}" for b in range(BANDS)]
PARAGRAPHS = "kind int, row long, doc_id long, at int, s int, e int, words int, h long, g long, " + ", ".join(f"{k} long" for k in KEYS)
LINE, SEED, WHOLE = range(3)


def _chunks(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, list]]:
    texts, held, first = [], 0, 0
    for i, t in enumerate(b.column(at)):
        texts.append(t.as_py())
        held += len(texts[-1] or b"")
        if held >= CHUNK:
            yield first, texts
            texts, held, first = [], 0, i + 1
    if texts:
        yield first, texts


def identified(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(row, doc_id, text, check): a row's number is a hash of its text, so that equal texts are one row; another hash tells apart what that one does not."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    check = F.shiftleft(F.hash(text).cast("long"), 32).bitwiseXOR(F.octet_length(text).cast("long"))
    return docs.select(F.xxhash64(F.lit(seed), text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), check.alias("check"))


def one_of_each(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, text) of different texts, each with its smallest doc_id; (row, doc_id) of every row of ``docs``; (row, kept_in) of the texts of two rows or more."""
    for seed in range(8):
        rows = identified(docs, seed)
        ids = stored(rows.select("row", "doc_id", "check"), "passages-ids")
        groups = stored(ids.groupBy("row").agg(F.min("doc_id").alias("kept_in"), F.count(F.lit(1)).alias("n"), (F.min("check") != F.max("check")).alias("mixed")).where("n > 1"), "passages-copies")
        if groups.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError("no hash tells the texts apart")
    several = groups.select(F.col("row").alias("same"), "kept_in")
    copies = stored(ids.join(several, F.col("row") == F.col("same")).groupBy("row", "doc_id", "kept_in").agg(F.count(F.lit(1)).alias("n")), "passages-rows-of-copies")
    own = F.col("doc_id").eqNullSafe(F.col("kept_in"))
    named = lambda df: df.select(F.col("row").alias("c_row"), F.col("doc_id").alias("c_id"))
    alike = (F.col("row") == F.col("c_row")) & F.col("doc_id").eqNullSafe(F.col("c_id"))
    twice = copies.where(own & (F.col("n") > 1))
    maybe, alone = maybe_in(rows.select("row", "doc_id", "text"), "row", several, "same")
    out = alone.unionByName(maybe.join(named(copies.where(~own).unionByName(twice)), alike, "left_anti"))  # by (row, doc_id) no large group of copies is one key
    if not twice.isEmpty():  # rows that repeat in id and text
        out = out.unionByName(maybe.join(named(twice), alike, "left_semi").dropDuplicates(["row"]))
    return out, ids.select("row", "doc_id"), several


def paragraphs(texts: DataFrame, least: int = SHINGLE, kinds: tuple = (LINE, SEED, WHOLE)) -> DataFrame:
    """Every line of ``least`` words or more (kind LINE), seed (SEED) and whole text (WHOLE) of every identified row, or some of these kinds.

    ``at`` counts the words before it. The band keys of a line come with its first occurrence in a chunk.
    """
    least = max(least, SHINGLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PARAGRAPHS.split(", ")]
        i32 = lambda x: pa.array(x.astype(np.int32))
        for b in batches:
            for first, texts in _chunks(b, 2):
                w = Words(texts)
                if not w.n:
                    continue
                starts, sizes = w.lines()
                long = sizes >= least
                none = (np.empty(0, np.int64),) * 4
                lines = starts[long], w.line_hash(starts, sizes)[long], sizes[long], np.zeros(int(long.sum()), np.int64)
                of_doc = np.flatnonzero(np.concatenate(([True], w.doc[1:] != w.doc[:-1])))
                n = np.diff(np.append(of_doc, w.n))
                whole = of_doc[n >= least], np.zeros(int((n >= least).sum()), np.int64), n[n >= least], np.zeros(int((n >= least).sum()), np.int64)
                for kind, (starts, h, sizes, g) in enumerate((lines, w.seeds() if SEED in kinds else none, whole)):
                    m = len(starts)
                    if not m or kind not in kinds:
                        continue
                    rows = pa.array(first + w.doc[starts])
                    s, e = (np.zeros(m),) * 2 if kind == SEED else (w.start[starts], w.end[starts + sizes - 1])
                    keys = [pa.nulls(m, pa.int64())] * BANDS
                    if kind == LINE:
                        new = np.unique(h, return_index=True)[1]
                        place = np.full(m, -1)
                        place[new] = np.arange(len(new))
                        take = pa.array(place, mask=place < 0)
                        keys = [pa.array(k).take(take) for k in w.minima(starts[new], sizes[new]).view(np.int64).T.copy()]
                    yield pa.record_batch([pa.array(np.full(m, kind, np.int32)), b.column(0).take(rows), b.column(1).take(rows), i32(w.in_document(starts)), i32(s), i32(e), i32(sizes), pa.array(h), pa.array(g), *keys], names=names)

    return texts.select("row", "doc_id", "text").mapInArrow(run, PARAGRAPHS)


def looked_up(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, at, side, h, w, v, o) for the stored (row, at, side, h), in one reading of the texts.

    side 0, 1: hashes v of the WINDOW words before (0) or from (1) the place ``at`` on, the nearest first, and where a passage
    begins or ends, in code points, that takes in none, one, ... of them; the hashes are of 32 bits there. side 2: the different
    shingles w of the row's line h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "at", "side", "h", "w", "v", "o"]
        lists = lambda sizes, flat: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
        for b in batches:
            for first, held in _chunks(b, 1):
                w = Words(held)
                asks = b.column(2).slice(first, len(held))
                doc = np.repeat(np.arange(len(held)), asks.value_lengths().to_numpy())
                at, side, h = (asks.flatten().field(k).to_numpy() for k in range(3))
                rows = lambda d: b.column(0).take(pa.array(first + d))  # noqa: B023, E731
                own = side == 2
                if own.any():
                    starts, sizes = w.lines()
                    hashes, wanted, found = w.line_hash(starts, sizes), set(zip(doc[own].tolist(), h[own].tolist(), strict=True)), {}
                    for i in np.flatnonzero(np.isin(hashes, h[own])).tolist():
                        key = int(w.doc[starts[i]]), int(hashes[i])
                        if key in wanted and key not in found:
                            x = w.shingle[starts[i] : starts[i] + sizes[i] - SHINGLE + 1]
                            found[key] = np.unique(x)
                    keys, x = list(found), list(found.values())
                    n, zero = len(keys), np.zeros(len(keys), np.int32)
                    if n:
                        yield pa.record_batch([rows(np.array([k[0] for k in keys])), pa.array(zero), pa.array(zero + 2), pa.array([k[1] for k in keys], pa.int64()), lists([len(v) for v in x], np.concatenate(x).view(np.int64)), *[lists(zero, np.empty(0, np.int32))] * 2], names=names)
                doc, at, side = doc[~own], at[~own], side[~own]
                if not len(doc):
                    continue
                begin, end = np.searchsorted(w.doc, doc), np.searchsorted(w.doc, doc, side="right")
                place, step = begin + at, np.where(side == 0, -1, 1)
                words = (place - (side == 0))[:, None] + step[:, None] * np.arange(WINDOW)
                there = (words >= begin[:, None]) & (words < end[:, None])
                n = there.sum(axis=1)
                edges = (place - (side == 1))[:, None] + step[:, None] * np.arange(WINDOW + 1)
                edges, taken = np.clip(edges, 0, w.n - 1), np.arange(WINDOW + 1) <= n[:, None]
                o = np.where(side[:, None] == 0, w.start[edges], w.end[edges])[taken]
                yield pa.record_batch([rows(doc), pa.array(at), pa.array(side), pa.array(np.zeros(len(doc), np.int64)), lists(n * 0, np.empty(0, np.int64)), lists(n, (w.hash[words[there]] >> np.uint64(32)).astype(np.uint32).view(np.int32)), lists(n + 1, o.astype(np.int32))], names=names)

    each = asked.distinct().groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("at", "side", "h")).alias("asks"))
    return maybe_in(texts, "row", asked, "row")[0].join(each, F.col("row") == F.col("r")).select("row", "text", "asks").mapInArrow(run, "row long, at int, side int, h long, w array<long>, v array<int>, o array<int>")


def _buckets(block: int):
    """Over rows (key, h) sorted by both: those of keys with two different h or more, each once, with its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h", "block"]
        key, h, place = None, None, 0  # the last row seen, and its place among the different ones of its key
        for b in batches:
            ks, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(ks):
                continue
            new_key = np.concatenate(([key is None or ks[0] != key], ks[1:] != ks[:-1]))
            new = new_key | np.concatenate(([h is None or hs[0] != h], hs[1:] != hs[:-1]))
            held = None if key is None else (key, h, place)
            count = np.cumsum(new)
            at_start = np.maximum.accumulate(np.where(new_key, count, 0))
            places = np.where(at_start > 0, count - at_start, place + count)
            # a row goes out if it is the second or later of its key; the first goes out with the second
            later = new & (places > 0)
            second = np.flatnonzero(later & (places == 1)).tolist()
            firsts = [(int(ks[i]), int(hs[i - 1]) if i and ks[i - 1] == ks[i] else held[1]) for i in second]
            # between a key's first and second row there may be repeats of the first only
            out_k = np.concatenate((ks[later], np.array([f[0] for f in firsts], np.int64)))
            out_h = np.concatenate((hs[later], np.array([f[1] for f in firsts], np.int64)))
            out_b = np.concatenate((places[later] // block, np.zeros(len(firsts), np.int64)))
            if len(out_k):
                yield pa.record_batch([pa.array(out_k), pa.array(out_h), pa.array(out_b.astype(np.int64))], names=names)
            key, h, place = ks[-1], hs[-1], int(places[-1])

    return run


def shingle_set(text: bytes) -> np.ndarray:
    w = Words([text])
    return np.unique(w.shingle[w.shingle != _NONE]) if w.n else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 0.0


def _similar_pairs(hs: np.ndarray, side: np.ndarray, own: bool, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the similar pairs between (or, with ``own``, within) two blocks of a bucket; sets lie one after the other in ``flat``.

    Two sets at SIMILAR or more share one of their rarest elements, counted here, up to the
    (1 - SIMILAR)-th part of each. Only pairs that do, and that no link connects yet, are compared.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    sets = [flat[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    if len(hs) == 2:
        return [(int(hs[0]), int(hs[1]))] if (own or side[0] != side[1]) and jaccard(*sets) >= SIMILAR else []
    owner = np.repeat(np.arange(len(hs)), sizes)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((number, count[number], owner))
    rank = np.arange(len(flat)) - starts[owner]
    rare = order[rank < (sizes - np.ceil(SIMILAR * sizes - 1e-9).astype(np.int64) + 1)[owner]]
    rare = rare[count[number[rare]] > 1]
    rare = rare[np.lexsort((owner[rare], number[rare]))]
    parent = list(range(len(hs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = []
    for group in np.split(owner[rare], np.flatnonzero(np.diff(number[rare])) + 1):
        met: dict[int, list[int]] = {}  # members so far by what they are linked to
        for x in group.tolist():
            for r in list(met):
                for y in met[r]:
                    if root(x) == root(y):
                        break
                    if (own or side[x] != side[y]) and SIMILAR * max(sizes[x], sizes[y]) <= min(sizes[x], sizes[y]) and jaccard(sets[x], sets[y]) >= SIMILAR:
                        pairs.append((int(hs[x]), int(hs[y])))
                        parent[root(y)] = root(x)
                        break
            met.setdefault(root(x), []).append(x)
    return pairs


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, i, j, side, h, w) that come sorted by (key, i, j), those of one (key, i, j) together."""
    held: pa.Table | None = None  # rows of the last group, which may go on

    def of(table: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table]:
        key = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        last = len(cuts) - 1 if whole else len(cuts) - 2
        hs, side, w = table.column("h").to_numpy(), table.column("side").to_numpy(), table.column("w").combine_chunks()
        sizes, flat = w.value_lengths().to_numpy(), w.flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        pairs = []
        for s, e in zip(cuts[:last].tolist(), cuts[1 : last + 1].tolist(), strict=True):
            if e - s > 1:
                pairs += _similar_pairs(hs[s:e], side[s:e], key[1, s] == key[2, s], sizes[s:e], flat[ends[s] : ends[e]])
        out = pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])
        return out, table.slice(cuts[last])

    for b in batches:
        if b.num_rows:
            table = pa.Table.from_batches([b])
            out, held = of(pa.concat_tables([held, table]) if held is not None and held.num_rows else table, False)
            yield out
    if held is not None and held.num_rows:
        yield of(held, True)[0]


def different_lines(lines: DataFrame) -> DataFrame:
    """(h, kept_in, lo, hi, band keys): a row per different line; ``lo`` and ``hi`` are the least and the greatest row that it lies in."""
    return lines.groupBy("h").agg(F.min("doc_id").alias("kept_in"), F.min("row").alias("lo"), F.max("row").alias("hi"), *[F.max(k).alias(k) for k in KEYS])


def buckets_of(lines: DataFrame, block: int) -> DataFrame:
    """(key, h, block): the different lines of every band key that has two or more."""
    keys = lines.select("h", F.explode(F.array(*KEYS)).alias("key")).select("key", "h").repartition("key").sortWithinPartitions("key", "h")
    return keys.mapInArrow(_buckets(block), "key long, h long, block long")


def links(buckets: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of all colliding lines that are similar."""
    # the same lines often meet in several bands: of buckets with the same members (by number, sum and xor of hashes) one is compared
    member = F.xxhash64("h")
    each = buckets.groupBy("key").agg(F.max("block").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.pmod(member, F.lit(1 << 40))).alias("sum"), F.bit_xor(member).alias("xor"))
    last = each.groupBy("n", "sum", "xor").agg(F.min("key").alias("k"), F.max("last").alias("last")).select("k", "last")
    dealt = buckets.join(last, F.col("key") == F.col("k")).select("key", "h", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    pairs = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "h")
    sets = shingles.select(F.col("h").alias("th"), "w")
    dealt = pairs.join(sets, F.col("h") == F.col("th")).select("key", "i", "j", "side", "h", "w").repartition("key", "i", "j")
    return dealt.sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "a long, b long")


def _wanted(buckets: DataFrame, lines: DataFrame) -> DataFrame:
    """What to look up for the lines of buckets: the shingles of one occurrence of each."""
    met = buckets.select(F.col("h").alias("met")).distinct()
    return lines.join(met, F.col("h") == F.col("met")).select(F.col("lo").alias("row"), F.lit(0).alias("at"), F.lit(2).alias("side"), "h")


def similar_lines(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): edges whose components are those of all colliding lines of ``docs`` that are similar."""
    texts = one_of_each(docs)[0]
    lines = stored(different_lines(paragraphs(texts).where(F.col("kind") == LINE)), "passages-lines")
    buckets = stored(buckets_of(lines, block), "passages-buckets")
    return links(buckets, stored(looked_up(texts, stored(_wanted(buckets, lines), "passages-asked")), "passages-looked-up"))


_SAME = ["row", "doc_id", "krow", "kept_in", "d"]


def _islands(df: DataFrame) -> DataFrame:
    whole = Window.partitionBy("row", "krow", "d")
    new = F.coalesce(F.col("p") > F.max("q").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))


def colliding(seeds: DataFrame) -> DataFrame:
    """(row, doc_id, krow, kept_in, d, island, p, q, h): runs of words [p, q) of a row that seeds and the words between them
    show equal to [p - d, q - d) of the first row, by doc_id, that has the seeds."""
    shared = stored(seeds.groupBy("h").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi").select(F.col("h").alias("hh")), "passages-shared")
    held = Stored(maybe_in(seeds, "h", shared, "hh")[0].join(shared, F.col("h") == F.col("hh"), "left_semi").select("row", "doc_id", "at", "words", "h", "g"), "passages-seeds")
    found = held.df
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at", "words", "g")).alias("k")
    kept = found.groupBy(F.col("h").alias("hh")).agg(first).select("hh", F.col("k.doc_id").alias("kept_in"), F.col("k.row").alias("krow"), F.col("k.at").alias("kat"), F.col("k.words").alias("kwords"), F.col("k.g").alias("kg"))
    pairs = found.join(kept, F.col("h") == F.col("hh")).where("row <> krow or at <> kat")
    until = F.col("at") + F.when((F.col("words") == F.col("kwords")) & (F.col("g") == F.col("kg")), F.greatest("words", F.lit(RUN_WORDS))).otherwise(RUN_WORDS)
    seeded = pairs.select("row", "doc_id", "krow", "kept_in", (F.col("at") - F.col("kat")).alias("d"), F.col("at").alias("p"), until.alias("q"), "h")
    out = stored(_islands(seeded).groupBy(*_SAME, "island").agg(F.min("p").alias("p"), F.max("q").alias("q"), F.min("h").alias("h")), "passages-runs")
    held.drop()
    return out


def _ends(runs: DataFrame) -> DataFrame:
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("at"), (F.col(c) - F.col("d")).alias("kat"))
    return runs.withColumn("x", F.explode(F.array(side(0, "p"), side(1, "q")))).select(*_SAME, "island", "p", "q", "h", "x.*")


def matches(runs: DataFrame, near: DataFrame, least: int = PARAGRAPH) -> DataFrame:
    """(row, doc_id, krow, kept_in, p, q, kp, kq, s, e, ks, ke, h): words [p, q) of a row that are [kp, kq) of another, but for edits; h is the least of their seeds.

    ``near``: the words around both ends of every run. Runs grow over them as far as the texts are equal.
    """
    own, other = (near.select(*[F.col(c).alias(x + c) for c in ("row", "at", "side", "v", "o")]) for x in ("a_", "b_"))
    both = _ends(runs).join(own, (F.col("row") == F.col("a_row")) & (F.col("at") == F.col("a_at")) & (F.col("side") == F.col("a_side")))
    both = both.join(other, (F.col("krow") == F.col("b_row")) & (F.col("kat") == F.col("b_at")) & (F.col("side") == F.col("b_side")))
    more = F.expr("coalesce(nullif(array_position(zip_with(a_v, b_v, (x, y) -> coalesce(x = y, false)), false), 0) - 1, size(a_v))").cast("int")
    grown = both.withColumn("more", more).select(*_SAME, "island", "p", "q", "h", "side", "more", F.expr("a_o[more]").alias("o"), F.expr("b_o[more]").alias("ko"))
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    grown = grown.groupBy(*_SAME, "island", "p", "q", "h").agg(
        (F.col("p") - of(0, "more")).alias("p2"), (F.col("q") + of(1, "more")).alias("q2"), of(0, "o").alias("s"), of(1, "o").alias("e"), of(0, "ko").alias("ks"), of(1, "ko").alias("ke")
    )
    grown = grown.select(*_SAME, F.col("p2").alias("p"), F.col("q2").alias("q"), "s", "e", "ks", "ke", "h")
    agg = lambda cs, f: [f(c).alias(c) for c in cs]
    equal = _islands(grown).groupBy(*_SAME, "island").agg(*agg(("p", "s", "ks", "h"), F.min), *agg(("q", "e", "ke"), F.max))
    # runs of one pair of rows, in order, that edits of a few words part
    order = Window.partitionBy("row", "krow").orderBy("p", "q", "d")
    apart = (F.col("p") > F.max("q").over(order.rowsBetween(Window.unboundedPreceding, -1)) + SLACK) | (F.abs(F.col("d") - F.lag("d").over(order)) > SLACK)
    chained = equal.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chained = chained.withColumn("kp", F.col("p") - F.col("d")).withColumn("kq", F.col("q") - F.col("d"))
    low, high = ("p", "kp", "s", "ks", "h"), ("q", "kq", "e", "ke")
    names = ["p", "q", "kp", "kq", "s", "e", "ks", "ke", "h"]
    rest = SHINGLE - 1
    alike = F.sum(F.greatest(F.col("q") - F.col("p") - rest, F.lit(0)))
    chains = chained.groupBy("row", "doc_id", "krow", "kept_in", "chain").agg(*agg(low, F.min), *agg(high, F.max), alike.alias("alike"), F.collect_list(F.struct(*names)).alias("parts"))
    a, b = F.col("q") - F.col("p") - rest, F.col("kq") - F.col("kp") - rest
    alike = F.least(F.col("alike"), a, b)
    similar = alike >= SIMILAR * (a + b - alike)
    out = chains.select("row", "doc_id", "krow", "kept_in", F.inline(F.when(similar, F.array(F.struct(*names))).otherwise(F.col("parts"))))
    return out.where(F.col("q") - F.col("p") >= least)


_SHOWN = "doc_id", "kind", "s", "e", "words", "cluster", "kept_in", "removed"


def whole_texts(ids: DataFrame, several: DataFrame, places: DataFrame) -> DataFrame:
    """A row for every row of ``ids`` whose text lies in two rows or more, from where each text (row, s, e, words) begins and ends."""
    places = places.select(F.col("row").alias("wrow"), "s", "e", "words")
    copied = several.join(places, F.col("same") == F.col("wrow")).select("same", "kept_in", "s", "e", "words", F.col("same").alias("cluster"))
    removed = (~F.col("doc_id").eqNullSafe(F.col("kept_in"))).alias("removed")
    return ids.join(copied, F.col("row") == F.col("same")).withColumns({"kind": F.lit("text"), "removed": removed}).select(*_SHOWN)


def repeated_texts(docs: DataFrame, least: int = SHINGLE) -> DataFrame:
    """The rows of kind ``text`` that ``repeated`` gives, without looking for lines and passages."""
    texts, ids, several = one_of_each(docs)
    met = maybe_in(texts, "row", several, "same")[0].join(several, F.col("row") == F.col("same"), "left_semi")
    places = stored(paragraphs(met, least, kinds=(WHOLE,)).select("row", "s", "e", "words"), "passages-places")
    return whole_texts(ids, several, places)


def repeated(docs: DataFrame, block: int = BLOCK, least: int = SHINGLE) -> DataFrame:
    """(doc_id, kind, s, e, words, cluster, kept_in, removed): every occurrence, in code points, of ``least`` words or more,
    of a line, a passage (of PARAGRAPH words or more) or a whole text that lies in two rows or more."""
    texts, ids, several = one_of_each(docs)
    found = Stored(paragraphs(texts, least), "passages-found")
    of_kind = lambda kind: found.df.where(F.col("kind") == kind)
    runs = colliding(of_kind(SEED).select("row", "doc_id", "at", "words", "h", "g"))
    lines = stored(different_lines(of_kind(LINE)), "passages-lines")
    occurrences = Stored(found.df.where(F.col("kind") != SEED).select("kind", "row", "doc_id", "s", "e", "words", "h"), "passages-occurrences")
    found.drop()
    buckets = stored(buckets_of(lines, block), "passages-buckets")
    ends = _ends(runs)
    zero = F.lit(0).cast("long").alias("h")
    asked = ends.select("row", "at", "side", zero).union(ends.select("krow", "kat", "side", zero)).union(_wanted(buckets, lines))
    seen = Stored(looked_up(texts, stored(asked, "passages-asked")), "passages-looked-up")
    passages = stored(matches(runs, seen.df.where("side < 2"), max(least, PARAGRAPH)), "passages-matches")
    roots = components(links(buckets, seen.df.where("side = 2")), "passages-components")
    # what lies in one row only drops out here, before anything is joined; a line may still have a similar one elsewhere
    named = stored(lines.join(roots, F.col("h") == F.col("node"), "left").where("root is not null or lo <> hi").select("h", F.coalesce("root", "h").alias("cluster"), "kept_in", "lo", "hi"), "passages-named")
    clusters = named.groupBy("cluster").agg(F.min("kept_in").alias("kept_in"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(F.col("cluster").alias("c"), "kept_in")
    hashes = named.select("h", "cluster").join(clusters, F.col("cluster") == F.col("c")).select(F.col("h").alias("hh"), "cluster", "kept_in")
    removed = (~F.col("doc_id").eqNullSafe(F.col("kept_in"))).alias("removed")
    shown = lambda kind: ("doc_id", F.lit(kind).alias("kind"), "s", "e", "words", "cluster", "kept_in", removed)
    out = stored(occurrences.df.where(F.col("kind") == LINE).select("doc_id", "s", "e", "words", "h").join(hashes, F.col("h") == F.col("hh")).select(*shown("line")), "passages-repeated-lines")
    # what is kept of one row: stretches that share words are one
    starts = passages.groupBy("krow", "kp").agg(F.first("kept_in").alias("kept_in"), F.max("kq").alias("kq"), F.min("ks").alias("ks"), F.max("ke").alias("ke"), F.min("h").alias("h"))
    order = Window.partitionBy("krow").orderBy("kp")
    new = F.coalesce(F.col("kp") >= F.max("kq").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    placed = stored(starts.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("cluster", F.min("h").over(Window.partitionBy("krow", "island"))), "passages-kept")
    kept = placed.groupBy("krow", "island", "kept_in", "cluster").agg(F.min("ks").alias("s"), F.max("ke").alias("e"), (F.max("kq") - F.min("kp")).alias("words"))
    kept = kept.select(F.col("kept_in").alias("doc_id"), F.lit("passage").alias("kind"), "s", "e", "words", "cluster", "kept_in", F.lit(False).alias("removed"))
    name = placed.select(F.col("krow").alias("nrow"), F.col("kp").alias("np"), "cluster")
    copies = passages.withColumn("words", F.col("q") - F.col("p")).join(name, (F.col("krow") == F.col("nrow")) & (F.col("kp") == F.col("np"))).select(*shown("passage"))
    # equal texts: one of them was compared, the others are copies of it
    wholes = stored(whole_texts(ids, several, occurrences.df.where(F.col("kind") == WHOLE)), "passages-whole-texts")
    occurrences.drop()
    seen.drop()
    return out.unionByName(copies).unionByName(kept).unionByName(wholes)
