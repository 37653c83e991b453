"""Byte-level BPE over whole corpora: every distinct word is encoded once.

Texts are cut into pre-tokens ("words"). A task numbers the distinct words of a chunk of documents in the order
of their hashes and keeps each document as the numbers of its words by position. Only the chunks' distinct words are
shuffled, a range of hashes at a time, so equal words of all chunks meet; each is merged once by the ranks, the ids go back
to the words' numbers in every chunk, and the chunk's documents are reassembled by position. Decoding joins the ids with the
table of the tokens' bytes. A word that is everywhere moves once a chunk, not once an occurrence.

Defined results: an empty table gives no rows; a null or empty text has no ids and decodes to no bytes; a null doc_id is kept
as null; repeated rows give a row each; other columns are not read, whatever their names; texts of any length are encoded
whole, a chunk holding one very long text at least (some eight bytes a word in the task that holds it). Ties between equal ranks
go to the leftmost pair. A document with an id that the token table lacks decodes to null.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelab.llm.common import bucketed

RANKS = "byte_bpe_50k.tiktoken"
#: Characters after which a chunk of documents is closed, and of texts that are matched as a stream.
CHUNK, STREAMED = 8_000_000, 1_000_000
#: Ids after which a block of rows is decoded.
BLOCK = 1_000_000
#: A table of more tokens is no vocabulary, and is not broadcast.
MOST_TOKENS = 1_000_000


def ranks_of(path: str | None = None) -> dict[bytes, int]:
    """The tokens' bytes and ranks of a rank file; None: the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if len(ranks) > MOST_TOKENS:
        raise ValueError(f"{path} lists {len(ranks)} tokens; {MOST_TOKENS} at most are a vocabulary")
    return ranks


#: Bytes up to which a pre-token's pairs are searched as a list, and from which on as a heap.
SHORT = 200
_NONE = 1 << 62


class Merges:
    """The ranks of all pairs of neighbours that make a token, by the pair's ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bits = ranks, max(ranks.values(), default=0).bit_length()
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("a rank file has every single byte")
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << self.bits | b] = rank

    def ids(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the neighbours whose joined bytes have the lowest rank are merged, the leftmost first, until none has one."""
        if word in self.ranks:
            return [self.ranks[word]]
        parts = [self.single[b] for b in word]
        return self._by_list(parts) if len(word) <= SHORT else self._by_heap(parts)

    def _by_list(self, parts: list[int]) -> list[int]:
        get, bits = self.pairs.get, self.bits
        pairs = [get(a << bits | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            lowest = min(pairs)
            if lowest == _NONE:
                break
            i = pairs.index(lowest)
            parts[i] = lowest  # a token's id is its rank
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(lowest << bits | parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] << bits | lowest, _NONE)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n, get, bits = len(parts), self.pairs.get, self.bits
        own, after, before = array("l", parts), array("l", range(1, n + 1)), array("l", range(-1, n - 1))

        def offer(i: int) -> int | None:
            rank = get(own[i] << bits | own[after[i]]) if i >= 0 and after[i] < n else None
            return None if rank is None else rank * n + i

        heap = [o for o in map(offer, range(n)) if o is not None]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if own[i] < 0 or j == n or get(own[i] << bits | own[j]) != rank:  # one of the two has been merged otherwise
                continue
            k = after[i] = after[j]
            own[i], own[j] = rank, -1
            if k < n:
                before[k] = i
            for o in (offer(before[i]), offer(i)):
                if o is not None:
                    heappush(heap, o)
        return [p for p in own if p >= 0]


_loaded: dict[str | None, Merges] = {}


def _merges(path: str | None) -> Merges:
    """One copy per worker process."""
    if path not in _loaded:
        _loaded[path] = Merges(ranks_of(path))
    return _loaded[path]


def _packed(parts: list[bytes]) -> bytes:
    """Byte strings as one."""
    return zstandard.compress(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts), 3)


def _unpacked(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends], ends, strict=False)]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))


CHUNKS = "chunk long, n long, words binary, doc_ids array<long>, sizes array<long>, codes binary"


def chunked(docs: DataFrame, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of whole documents: their distinct words by hash, and every document as numbers of its words by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        match, number = regex.compile(pattern), TaskContext.get().partitionId() << 38
        words, doc_ids, codes, chars = defaultdict(), [], [], 0
        words.default_factory = words.__len__

        def closed() -> pa.RecordBatch:
            nonlocal words, doc_ids, codes, chars, number
            names = [w.encode() for w in words]
            order = np.argsort(_hashes(names), kind="stable")
            place = np.empty(len(names), np.uint32)
            place[order] = np.arange(len(names), dtype=np.uint32)
            body = zstandard.compress(b"".join([place[c].tobytes() for c in codes]) if names else b"", 3)
            out = pa.record_batch(
                [pa.array([number]), pa.array([len(names)]), pa.array([_packed([names[k] for k in order.tolist()])], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(c) for c in codes]], pa.list_(pa.int64())), pa.array([body], pa.binary())],
                names=["chunk", "n", "words", "doc_ids", "sizes", "codes"],
            )
            words, doc_ids, codes, chars, number = defaultdict(), [], [], 0, number + 1
            words.default_factory = words.__len__
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                tokens = match.findall(text) if len(text) <= STREAMED else (m[0] for m in match.finditer(text))
                codes.append(np.fromiter(map(words.__getitem__, tokens), np.uint32))
                doc_ids.append(doc_id)
                chars += len(text) + 16
                if chars >= chunk:
                    yield closed()
        if doc_ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS)


def _ranges(chunks: DataFrame, count: int) -> DataFrame:
    """(part, chunk, first, words): each chunk's words cut at ``count`` equal ranges of their hashes; ``first`` is the number of a piece's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = _unpacked(data.as_py())
                part = (_hashes(words).astype(np.uint64) * np.uint64(count)) >> np.uint64(32)
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(words) else np.zeros(0, int)
                pieces = [_packed(words[s:e]) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(words)], strict=False)]
                yield pa.record_batch([pa.array(part[cut].astype(np.int64)), pa.array([chunk] * len(cut), pa.int64()), pa.array(cut, pa.int64()), pa.array(pieces, pa.binary())], names=["part", "chunk", "first", "words"])

    return chunks.select("chunk", "words").mapInArrow(run, "part long, chunk long, first long, words binary")


def _encoded_range(path: str | None):
    """The ids of the words of all chunks in one range of hashes, each distinct word merged once."""

    def run(table: pa.Table) -> pa.Table:
        merges, out = _merges(path), []
        ids = {}
        for data in table.column("words"):
            lengths, flat = [], []
            for w in _unpacked(data.as_py()):
                if w not in ids:
                    ids[w] = merges.ids(w)
                lengths.append(len(ids[w]))
                flat += ids[w]
            out.append(zstandard.compress(np.array([len(lengths), *lengths, *flat], "<u4").tobytes(), 3))
        return pa.table([table.column("chunk"), table.column("first"), pa.array(out, pa.binary())], names=["chunk", "first", "ids"])

    return run


def _reassembled(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ids of a chunk's documents, from the ids of its words and the words' numbers by position."""
    parts = [np.frombuffer(zstandard.decompress(d.as_py()), "<u4") for d in left.sort_by("first").column("ids")]
    lengths = np.concatenate([np.zeros(0, np.int64), *(p[1 : 1 + p[0]] for p in parts)])
    flat = np.concatenate([np.zeros(0, np.int32), *(p[1 + p[0] :].astype(np.int32) for p in parts)])
    first = np.cumsum(lengths) - lengths
    sizes = right.column("sizes").combine_chunks().values.to_numpy()
    codes = np.frombuffer(zstandard.decompress(right.column("codes")[0].as_py()), "<u4")
    out, step = [], 1 << 20
    for s in range(0, len(codes), step):
        c = codes[s : s + step]
        per = lengths[c]
        shift = first[c] - (np.cumsum(per) - per)
        out.append(flat[np.repeat(shift, per) + np.arange(per.sum())])
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lengths[codes], out=total[1:])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ids = pa.array(np.concatenate(out) if out else flat[:0])
    return pa.table([right.column("doc_ids").combine_chunks().values, pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), ids)], names=["doc_id", "ids"])


#: Words that a task encodes together; the number of ranges goes by it.
RANGE = 400_000


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id and the ids of every text. path: of a rank file; pattern: of the pre-tokens, which must match whatever a text holds; both as installed by default.

    The chunks are a table dealt by chunk when it is written, so that the documents themselves are never shuffled: only their distinct words, and the ids of these.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = bucketed(chunked(docs, pattern, chunk), "chunk", parts, "bpe-chunks", "zstd")
    words = chunks.agg(F.sum("n")).first()[0] or 0
    ranges = _ranges(chunks, max(parts, -(-words // RANGE)))
    ids = ranges.groupBy("part").applyInArrow(_encoded_range(path), "chunk long, first long, ids binary")
    bodies = chunks.select(F.col("chunk").alias("body"), "doc_ids", "sizes", "codes")
    return ids.groupBy("chunk").cogroup(bodies.groupBy("body")).applyInArrow(_reassembled, "doc_id long, ids array<int>")


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, bytes of every token."""
    ranks = ranks_of(path)
    return spark.createDataFrame(pa.table([pa.array(list(ranks.values()), pa.int32()), pa.array(list(ranks), pa.binary())], names=["id", "bytes"]))


DECODED = "doc_id long, ids array<int>, bytes binary"
BLOCKS = "block long, doc_ids array<long>, sizes array<int>, ids binary, used array<int>"


def _blocks(encoded: DataFrame, block: int) -> DataFrame:
    """Successive rows together: their ids by position, and each id that they use once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_ids, parts = TaskContext.get().partitionId() << 38, [], []

        def closed() -> pa.RecordBatch:
            nonlocal number, doc_ids, parts
            ids = np.concatenate(parts)
            out = pa.record_batch(
                [pa.array([number]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([ids.astype("<i4").tobytes()], pa.binary()), pa.array([np.unique(ids)], pa.list_(pa.int32()))],
                names=["block", "doc_ids", "sizes", "ids", "used"],
            )
            number, doc_ids, parts = number + 1, [], []
            return out

        held = 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(doc_id)
                parts.append(ids.values.to_numpy().astype(np.int32, copy=False) if ids.is_valid else np.zeros(0, np.int32))
                held += len(parts[-1]) + 16
                if held >= block:
                    yield closed()
                    held = 0
        if doc_ids:
            yield closed()

    return encoded.select("doc_id", "ids").mapInArrow(run, BLOCKS)


def decode(encoded: DataFrame, tokens: DataFrame, block: int = BLOCK, then=None, schema: str = DECODED) -> DataFrame:
    """doc_id, ids and the bytes of every row of ``encoded`` (doc_id, ids), by a join of the ids with ``tokens`` (id, bytes).

    Successive rows make a block, each id that a block uses is joined once, and the rows are put together from the joined bytes by position.
    The token table is a vocabulary, so its size is bounded and it is broadcast; a block's ids then stay in its task
    and need no shuffle to come together again. That they come whole is checked. ``then`` makes batches of another ``schema`` of the decoded ones where they are.
    """
    each = _blocks(encoded, block).select("block", "doc_ids", "sizes", "ids", F.size("used").alias("n"), F.posexplode_outer("used").alias("k", "id"))
    once = F.coalesce(F.col("k"), F.lit(0)) == 0  # the block's rows go with its first id
    found = each.select("block", "n", "id", *[F.when(once, F.col(c)).alias(c) for c in ("doc_ids", "sizes", "ids")]).join(F.broadcast(tokens), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, body, keys, values = None, 0, None, [], []

        def closed() -> pa.RecordBatch:
            if body is None or len(keys) != n:
                raise RuntimeError("the ids of a block did not stay together")
            doc_ids, sizes, data = body
            ids, table = np.frombuffer(data, "<i4"), np.array(keys, np.int32)
            order = np.argsort(table, kind="stable")
            which = order[np.searchsorted(table[order], ids)] if n else np.zeros(0, int)
            lengths = np.array([-1 if v is None else len(v) for v in values], np.int64)
            blob, first = np.frombuffer(b"".join(v or b"" for v in values), np.uint8), np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            out, s = [], 0
            for size in sizes:
                w = which[s : s + size]
                per = lengths[w]
                out.append(None if (per < 0).any() else blob[np.repeat(first[w] - (np.cumsum(per) - per), per) + np.arange(per.sum())].tobytes())
                s += size
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])

        for b in batches:
            numbers = b.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]).tolist() if len(numbers) else []
            for s, e in zip(starts, [*starts[1:], len(numbers)], strict=False):
                if numbers[s] != at:
                    if at is not None:
                        yield closed()
                    at, n, body, keys, values = numbers[s], max(b.column(1)[s].as_py(), 0), None, [], []
                bodies = b.slice(s, e - s)
                for k in range(e - s):
                    if bodies.column(3)[k].is_valid:
                        body = tuple(bodies.column(c)[k].as_py() for c in (3, 4, 5))
                        break
                if n:
                    keys += bodies.column(2).to_pylist()
                    values += bodies.column(6).to_pylist()
        if at is not None:
            yield closed()

    made = run if then is None else lambda batches: then(run(batches))
    return found.select("block", "n", "id", "doc_ids", "sizes", "ids", "bytes").mapInArrow(made, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(batches: Iterator[pa.RecordBatch], block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Of decoded rows, checksums of the ids, written in decimal with one space between, and of the bytes."""
    for b in batches:
        rows = []
        for doc_id, ids, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            ids, sha = ids.values.to_numpy(), hashlib.sha256()
            for s in range(0, len(ids), block):
                sha.update((" " if s else "").encode() + " ".join(map(str, ids[s : s + block].tolist())).encode())
            rows.append((doc_id, len(ids), sha.hexdigest(), hashlib.sha256(data.as_buffer()).hexdigest() if data.is_valid else None))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[f.split()[0] for f in DIGEST.split(", ")])


def round_trip(docs: DataFrame) -> DataFrame:
    """The checksums of every document's ids and of the bytes that they decode to."""
    return decode(encode(docs), token_table(docs.sparkSession), then=digests, schema=DIGEST)
