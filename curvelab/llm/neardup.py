"""Near copies among whole texts: SimHash's index, bands of shingle minima, and exact verification.

SimHash at 3 bits of 64 finds few of the texts whose five-word shingles have a Jaccard similarity of 0.8 (they differ
in some seven bits), and links some that have less. Here its components only say which texts to compare, and so do
bands of minima over the shingles of each text, which miss one pair in a thousand at that similarity. A link counts only
if the exact similarity is 0.8 or more, so no text is taken for a copy unverified.

Defined results: an empty table stays empty; texts with the same words in the same order, blanks and the case of A-Z aside, are copies,
null, empty and blank ones among each other; texts of fewer than five words have no other near copies; repeated rows are copies; ties cannot arise, as
the smallest doc_id stays, or one row without a doc_id where a group has no other; a text is hashed whole in one task; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm import passages, simhash
from curvelab.llm.common import batches_of, maybe_in, stored, unique_names
from curvelab.llm.components import components

_BLANKS = "\t\n\x0b\x0c\r"
#: What texts without a word are known by.
_BLANK = 0
SIGNATURES = "row long, doc_id long, tag string, h long, fp long, " + ", ".join(f"{k} long" for k in passages.KEYS)


def _one_line(text: Column) -> Column:
    """A text as one line, so that the operator for lines compares whole texts."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _BLANKS, " " * len(_BLANKS))


#: Bytes of text that a task hashes at a time, and rows of an Arrow batch.
PIECE, TEXTS = 1 << 18, 500


def _pieces(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, list]]:
    """Some texts of a batch at a time, with the number of the first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(b.column(at)):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def signatures(texts: DataFrame) -> DataFrame:
    """Of each text (row, doc_id, text): a digest, the hash of its words, its SimHash fingerprint, and, from five words on, its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SIGNATURES.split(", ")]
        for b in batches:
            for first, held in _pieces(b, 2):
                n, w = len(held), passages.Words(held)
                h, keys, has = np.full(n, _BLANK, np.int64), np.zeros((n, passages.BANDS), np.int64), np.zeros(n, bool)
                if w.n:
                    starts, sizes = w.lines()
                    h[w.doc[starts]] = w.line_hash(starts, sizes)
                    long = sizes >= passages.SHINGLE
                    if long.any():
                        has[w.doc[starts[long]]] = True
                        keys[w.doc[starts[long]]] = w.minima(starts[long], sizes[long]).view(np.int64)
                fp = np.fromiter(map(simhash.fingerprint, held), np.uint64, n).view(np.int64)
                same = [b.column(c).slice(first, n) for c in (0, 1, 3)]
                yield pa.record_batch([*same, pa.array(h), pa.array(fp), *(pa.array(keys[:, k], mask=~has) for k in range(passages.BANDS))], names=names)

    return texts.select("row", "doc_id", "text", F.md5("text").alias("tag")).mapInArrow(run, SIGNATURES)


def shingles(texts: DataFrame) -> DataFrame:
    """(h, w): the different shingles of each text (h, text) of five words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in _pieces(b, 1):
                w = passages.Words(held)
                if not w.n:
                    continue
                starts, sizes = w.lines()
                starts, sizes = starts[sizes >= passages.SHINGLE], sizes[sizes >= passages.SHINGLE]
                sets = [np.unique(w.shingle[s : s + n - passages.SHINGLE + 1]).view(np.int64) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.record_batch([b.column(0).take(pa.array(first + w.doc[starts])), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["h", "w"])

    return texts.select("h", "text").mapInArrow(run, "h long, w array<long>")


def buckets(sig: DataFrame, lines: DataFrame, block: int) -> DataFrame:
    """(key, h, block): the different texts to be compared with each other, by band keys and by components of fingerprints."""
    fps = stored(sig.groupBy("fp", "h").agg(F.lit(1).alias("one")).select("fp", "h"), "neardup-fingerprints")
    roots = components(simhash.links(fps.select("fp").distinct()), "neardup-fingerprint-components")
    alike = fps.join(roots, F.col("fp") == F.col("node"), "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "h")
    banded = lines.select(F.explode(F.array(*passages.KEYS)).alias("key"), "h").where("key is not null")
    enough = lines.where(F.col(passages.KEYS[0]).isNotNull()).select(F.col("h").alias("long"))
    keys = banded.unionByName(alike.join(enough, F.col("h") == F.col("long"), "left_semi"))
    return keys.select("key", "h").repartition("key").sortWithinPartitions("key", "h").mapInArrow(passages._buckets(block), "key long, h long, block long")


def links(docs: DataFrame, block: int = passages.BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of the different texts of ``docs``; (row, doc_id) of all rows; (a, b): edges between hashes of texts whose components are those of all verified links."""
    texts, ids, _ = passages.one_of_each(docs.select("doc_id", _one_line(F.col("text")).alias("text")))
    sig = stored(signatures(texts), "neardup-signatures")
    lines = stored(passages.different_lines(sig), "neardup-texts")
    held = stored(buckets(sig, lines, block), "neardup-buckets")
    met = held.select(F.col("h").alias("met")).distinct()
    asked = stored(lines.join(met, F.col("h") == F.col("met")).select(F.col("lo").alias("asked"), "h"), "neardup-asked")
    of_asked = maybe_in(texts, "row", asked, "asked")[0].join(asked, F.col("row") == F.col("asked"))
    return sig, ids, passages.links(held, stored(shingles(of_asked), "neardup-shingles"))


def keep_one(docs: DataFrame, block: int = passages.BLOCK) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of verified links one row of the smallest doc_id stays."""
    with batches_of(docs.sparkSession, TEXTS):
        sig, ids, edges = links(docs, block)
        roots = components(edges, "neardup-components")
    named = sig.join(roots, F.col("h") == F.col("node"), "left").select("doc_id", "tag", F.coalesce("root", "h").alias("class"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("b")
    kept = stored(named.groupBy("class").agg(best).select(F.col("b.doc_id").alias("_kept_id"), F.col("b.tag").alias("_kept_tag")), "neardup-kept")
    # an id of one row names it; rows that share an id, or have none, are told apart by their texts
    shared = stored(ids.where("doc_id is not null").groupBy(F.col("doc_id").alias("_shared_id")).count().where("count > 1").select("_shared_id"), "neardup-shared")
    alone = kept.where("_kept_id is not null").join(shared, F.col("_kept_id") == F.col("_shared_id"), "left_anti")
    (tag,) = unique_names("_tag", taken=docs.columns)
    others = docs.where("doc_id is null").union(docs.join(shared, F.col("doc_id") == F.col("_shared_id"), "left_semi")).withColumn(tag, F.md5(_one_line(F.col("text"))))
    others = others.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col(tag) == F.col("_kept_tag")), "left_semi").dropDuplicates(["doc_id", tag]).drop(tag)
    return docs.join(alone, F.col("doc_id") == F.col("_kept_id"), "left_semi").union(others)
