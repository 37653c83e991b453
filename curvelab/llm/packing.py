"""Packing of tokenised documents into sequences by first-fit decreasing.

A document's ids are its tokens and one closing id. Whole sequences are cut off
its front; what is left is packed with other remainders by first-fit decreasing,
independently in groups that a random hash makes of bounded expected size. The
first bin with room is found in a tournament tree of the bins' free capacities.

Defined results: an empty table gives no pieces; remainders of equal length are placed in the order of their pieces; other columns
are not read; a null or empty text is its closing id alone; repeated rows are
packed each for itself; a null doc_id is kept as null; a document of any length
is streamed into pieces, and only their lengths and checksums go to the packing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import stored

CAPACITY, END_ID = 1024, 0
TOKENIZER = "byte_bpe_50k.json"
#: Remainders that a group is expected to hold.
GROUP = 8192
#: Entries of each of the tokenizer's four caches (two generations of two), and letters of a part or token that is kept there.
CACHED, CACHED_LETTERS = 600_000, 64


class _Cache(dict):
    """A dict that computes what it lacks and forgets in generations, so that its size stays bounded and frequent entries survive."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LETTERS:  # bounds the bytes too
            self[key] = value
        return value


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(other)}


class WordTokenizer:
    """The ids of ``tokenizers`` for whole texts, by cached parts.

    A byte-level BPE never merges over the cuts of its pre-tokenizer. Such cuts
    lie before every space and on both sides of every line feed, as long as no
    three blanks follow each other and no two end the text. Parts between them
    are looked up; unknown ones are split into pre-tokens, and only unknown
    pre-tokens go through the library's model. Texts with longer runs or other
    blanks are cut only before single spaces between two other characters.
    Tokenizers of other kinds encode whole texts.
    """

    RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]
    BLANKS = "\0\t\r\x0b\x0c"
    FAR_BLANKS = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    SAFE = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, most: int = CACHED):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        kind = json.loads(self.whole.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.by_parts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and kind["normalizer"] is None and kind["model"]["type"] == "BPE"
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.alphabet, self.model = _byte_letters(), self.whole.model
        self.tokens = _Cache(self._token, most)
        self.parts = _Cache(self._part, most)
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _token(self, token: str) -> bytes:
        found = self.model.tokenize(token.encode().decode("latin-1").translate(self.alphabet))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _part(self, part: str) -> bytes:
        tokens = self.pattern.findall(part)
        if len(tokens) == 1 and tokens[0] == part:  # kept as a part, so not as a token too
            return self._token(part)
        return b"".join(map(self.tokens.__getitem__, tokens))

    def forget(self) -> None:
        """Empty the caches, which a worker would else hold through the tasks of later queries."""
        for cache in (self.tokens, self.parts):
            cache.clear()
            cache.old = {}

    def _plain(self, text: str) -> bool:
        blanks = self.BLANKS if text.isascii() else self.BLANKS + self.FAR_BLANKS
        return not any(c in text for c in blanks) and not any(r in text for r in self.RUNS) and len(text[-2:].rstrip(" \n")) > 0

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_parts or any(s in text for s in self.special):
            return self._encode(text)
        if self._plain(text):
            return b"".join(map(self.parts.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))
        return b"".join(map(self.parts.__getitem__, self.SAFE.split(text)))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None) -> WordTokenizer:
    """One per worker process. path: of a tokenizer file; None: the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of every document, ``piece`` numbering them uniquely: whole sequences, then the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, n = tokenizer(path), END_ID.to_bytes(4, "little"), TaskContext.get().partitionId() << 38
        try:
            for b in batches:
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = tok.ids(text.as_py() or "") + end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        part = memoryview(ids)[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, n, start, len(part) // 4, zlib.crc32(part), total))
                        n += 1
                yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=[f.split()[0] for f in PIECES.split(", ")])
        finally:
            tok.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; the longest first, ties as they come."""
    leaves = 1 << max(1, (max(1, len(lengths)) - 1).bit_length())
    room = [capacity] * (2 * leaves)  # room[k]: the most that a bin under node k has free
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, k = int(lengths[i]), 1
        while k < leaves:  # the leftmost bin that has room
            k *= 2
            if room[k] < need:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - room[k]
        room[k] -= need
        while k > 1:
            k //= 2
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
    return bins, offsets


def _pack_group(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        keep = [f.split()[0] for f in PACKED.split(", ")][:5]
        sequence = ((np.int64(key[0].as_py()) << 24) + bins) * 2
        return pa.table([*(table.column(c) for c in keep), pa.array(sequence), pa.array(offsets)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group: int = GROUP) -> DataFrame:
    """A row per piece: where it lies in its document, and in which sequence at which offset.

    Sequences of one whole piece have odd ids, the packed ones even ids.
    """
    cut = stored(pieces(docs, capacity, path), "packing-pieces")
    whole = cut.where(F.col("length") == capacity).selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece * 2 + 1 as sequence_id", "0L as offset")
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    return whole.union(dealt.groupBy("grp").applyInArrow(_pack_group(capacity), PACKED))
