"""SimHash near-duplicate detection with deletion-variant signatures.

A document's fingerprint has 64 bits; a bit is 1 if more than half of the
hashes of its word shingles have it. Two fingerprints are linked at 3 or fewer
differing bits. Cut into two segments of 32 bits, two linked fingerprints have
a segment in which they differ by one bit at most, so some one-wildcard variant
of that segment (one bit position left out) is equal in both. Every distinct
fingerprint is indexed under its 64 variants, equal variants meet, and the full
distance is verified. This is exact: no linked pair is missed.

Links of copies are never expanded: equal fingerprints are one row before the
index is made, and a bucket gives a spanning forest of its verified links, not
its pairs. Buckets over ``block`` fingerprints are cut into blocks, and pairs
of blocks are verified by separate tasks.

Defined results: an empty table gives no rows; the smallest doc_id of a component names it, so ties cannot arise; a text is hashed
whole in one task, its shingles 65,536 at a time; null and empty texts have fingerprint zero and are linked like
any other; repeated rows are copies; a null doc_id never is a component's name
unless no member has another (then it is null); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from curvelab.llm.common import stored, unique_names
from curvelab.llm.components import components, forest

SEED, BITS, MAX_BITS, SHINGLE = 42, 64, 3, 3
#: Fingerprints of a bucket that one task verifies against each other.
BLOCK = 2048


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole UTF-8 text, A-Z lower-cased."""
    words = text.lower().split() if text else []  # bytes.split cuts at the six ASCII blanks
    if not words:
        return 0
    if len(words) <= width:
        h = np.array([xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
        h = np.fromiter(map(xxh64_intdigest, map(flat.__getitem__, map(slice, starts, ends[width - 1 :].tolist())), repeat(SEED)), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65536):
        bits = np.unpackbits(h[k : k + 65536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        whole = len(bits) // 255 * 255
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
        if whole:  # sums of 255 bits fit a byte
            ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): a row for each of 64 one-wildcard segment variants of fp."""
    segment = F.when(F.col("bit") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    hole = F.expr("shiftleft(1L, cast(pmod(bit, 32) as int))")
    return (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
        .select(F.shiftleft(F.col("bit").cast("long"), 32).bitwiseOR(segment.bitwiseAND(F.bitwise_not(hole))).alias("key"), "fp")
    )


def links_within(left: np.ndarray, right: np.ndarray, most: int = MAX_BITS) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j) with left[i] and right[j] at most ``most`` bits apart; a stripe at a time."""
    for k in range(0, len(left), 256):
        i, j = np.nonzero(np.bitwise_count(left[k : k + 256, None] ^ right[None, :]) <= most)
        yield from zip((i + k).tolist(), j.tolist(), strict=True)


def _forest_of(left: np.ndarray, right: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    own = right is None
    right = left if own else right
    a, b = left.view(np.int64).tolist(), right.view(np.int64).tolist()
    roots = forest((a[i], b[j]) for i, j in links_within(left, right, most) if not own or i < j)
    return [(x, r) for x, r in roots.items() if x != r]


def _verify(block: int, most: int):
    """Over rows sorted by key: links of each small bucket as forest edges
    (key null), and the rows of large buckets with their block (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64())])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=schema)

        held_key, held, seen = None, np.empty(0, np.int64), 0  # the run that may go on in the next batch; rows of it already passed on
        rows: list[tuple] = []

        def close() -> None:
            nonlocal seen
            if seen:
                rows.extend((held_key, f, None, (seen + i) // block) for i, f in enumerate(held.tolist()))
            elif len(held) > 1:
                rows.extend((None, a, b, None) for a, b in _forest_of(held.view(np.uint64), None, most))
            seen = 0

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            inner = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))  # lone rows inside need nothing
            for s, e in zip(starts[inner].tolist(), ends[inner].tolist(), strict=True):
                if keys[s] != held_key:
                    close()
                    held_key, held = keys[s], fps[s:e]
                else:
                    held = np.concatenate((held, fps[s:e]))
                while len(held) > block or seen and len(held) >= block:  # pass whole blocks on
                    rows.extend((held_key, f, None, seen // block) for f in held[:block].tolist())
                    held, seen = held[block:], seen + block
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows.clear()
        close()
        yield out(rows)

    return run


def _verify_blocks(most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, fp = table.column("side").to_numpy(), table.column("a").to_numpy()
        left, right = fp[side == 0].view(np.uint64), fp[side == 1].view(np.uint64)
        edges = _forest_of(left, right if key[1].as_py() != key[2].as_py() else None, most)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return run


def links(fps: DataFrame, block: int = BLOCK, most: int = MAX_BITS) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct
    fingerprints at ``most`` (3 at the most) or fewer differing bits."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    by_key = variants(fps).repartition("key").sortWithinPartitions("key")
    found = stored(by_key.mapInArrow(_verify(block, most), "key long, a long, b long, block long"), "simhash-links")
    large = found.where("key is not null")
    counts = large.groupBy("key").agg(F.max("block").alias("last")).select(F.col("key").alias("k"), "last")
    # block b of n meets every block: (i, b) for i < b, (b, j) for j >= b
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    dealt = large.join(counts, F.col("key") == F.col("k")).select("key", "a", "block", other.alias("other"))
    pairs = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "a")
    verified = pairs.groupBy("key", "i", "j").applyInArrow(_verify_blocks(most), "a long, b long")
    return found.where("b is not null").select("a", "b").union(verified)


def _grouped(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row; (fp, first_id, n, root) of every fingerprint."""
    each = stored(fingerprints(docs), "simhash-fp")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), block), "simhash-components")
    return each, distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id, links) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the document's
    own included; links counts the rows of the other fingerprints and copies
    in the component.
    """
    each, named = _grouped(docs, block)
    whole = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("size")).withColumnRenamed("root", "r")
    classes = named.join(whole, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id", "size")
    return each.join(classes, F.col("fp") == F.col("f")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("size") - 1).alias("links"))


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() for t in b.column(at))
            fp = np.fromiter((fingerprint(t.encode() if isinstance(t, str) else t) for t in texts), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row of
    the smallest doc_id stays, or one without a doc_id where none has any."""
    each, named = _grouped(docs, block)
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("b")
    kept = stored(named.groupBy("root").agg(best).select(F.col("b.first_id").alias("_kept_id"), F.col("b.fp").alias("_kept_fp")), "simhash-kept")
    # an id of one row names it; rows that share an id, or have none, are told apart by their fingerprints
    shared = stored(each.where("doc_id is not null").groupBy(F.col("doc_id").alias("_shared_id")).count().where("count > 1").select("_shared_id"), "simhash-shared")
    same, alike = F.col("doc_id") == F.col("_kept_id"), F.col("doc_id") == F.col("_shared_id")
    alone = kept.where("_kept_id is not null").join(shared, F.col("_kept_id") == F.col("_shared_id"), "left_anti")
    (fp,) = unique_names("_fp", taken=docs.columns)
    others = _with_fingerprint(docs.where("doc_id is null").union(docs.join(shared, alike, "left_semi")), fp)
    others = others.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col(fp) == F.col("_kept_fp")), "left_semi").dropDuplicates(["doc_id", fp]).drop(fp)
    return docs.join(alone, same, "left_semi").union(others)
