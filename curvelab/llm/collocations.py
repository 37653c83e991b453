"""Phrases whose words stand together more often than their frequencies explain, mined by hashed passes.

Texts are lower-cased (A-Z), cut at punctuation into pieces and at blanks into words. Pass k counts the k-grams exactly
that can be frequent, and in the same pass the hash buckets of the (k + 1)-grams. A bucket that holds fewer than ``least``
occurrences holds no frequent phrase: the frequent buckets become a bitmap that is broadcast to the next
pass, with a bitmap of the frequent k-grams, for no phrase is frequent whose parts are not (Apriori). Bitmaps only
spare work; the exact counts decide. Counts are added up in tasks before they are shuffled.

Defined results: an empty table gives no phrases; null and empty texts have no words; a null language is ``und``; repeated
rows count each; texts of any length are counted whole, in blocks that overlap by a phrase; ties are ranked by count, then by the phrase's
bytes; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelab.llm.common import stored

LEAST, MAX_WORDS, TOP, COVER = 10, 3, 2000, 50
#: A bucket is one of 2 ** 32; a bitmap has a bit for so many of them that an eighth of the bits is set at most, as long as it has no more than this power of two (128 MB).
BUCKET_BITS, MOST_BITS, LEAST_BITS = 32, 30, 15
#: Bytes of text that a task counts at a time.
BLOCK = 4_000_000
#: Words that a part of a long text repeats of the part before; phrases may have one more.
MAX_BACK = 7
UNKNOWN = "und"
#: Parts in which a language's phrases are ranked first.
PARTS = 64
SCALE = 1_000_000

# fixed values: the bytes that end a piece, and those between words
_PIECE_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes(255 if b in _PIECE_ENDS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return (h ^ (h >> np.uint64(29))) * _MIX[0]


def _buckets(hashes: list[np.ndarray]) -> np.ndarray:
    """The bucket of each phrase, from the hashes of its words in order."""
    h = hashes[0]
    for other in hashes[1:]:
        h = _mixed(h) + other
    return _mixed(h) >> np.uint64(64 - BUCKET_BITS)


class Bitmap:
    """Which buckets may hold a frequent phrase. Broadcast to tasks; of bounded size."""

    def __init__(self, bits: int, body: bytes):
        self.shift, self.body = np.uint64(BUCKET_BITS - bits), np.frombuffer(body, np.uint8)

    def has(self, buckets: np.ndarray) -> np.ndarray:
        at = buckets >> self.shift
        return (self.body[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


_ROW_BITS = 32768  # of one bitmap_construct_agg


def bitmap(buckets: DataFrame) -> Bitmap:
    """A bitmap of the column ``bucket``; its size goes by the number of buckets, and is 128 MB at most."""
    n = buckets.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))
    place = F.shiftright("bucket", BUCKET_BITS - bits)
    rows = buckets.select(place.alias("place")).groupBy(F.expr(f"place div {_ROW_BITS}").alias("row")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(_ROW_BITS))).alias("body"))
    out = bytearray((1 << bits) // 8)
    for r in rows.toLocalIterator():
        out[r["row"] * _ROW_BITS // 8 : (r["row"] + 1) * _ROW_BITS // 8] = r["body"]
    return Bitmap(bits, bytes(out))


def _blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[dict[str, list[tuple[bytes, int]]]]:
    """Text by language, about BLOCK bytes at a time: (text, words at its front that the block before has counted).

    A text that is longer is cut before a blank or at the end of a piece, and what is cut off begins with the last words of the part before.
    """
    held, size = defaultdict(list), 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if not text.is_valid:
                continue
            data = text.as_py().encode().translate(_TABLE)
            known, again = 0, 0  # words and bytes at the front that were counted before
            while len(data) > again + block:
                stop = _stop(data, again, block)
                if stop == len(data):
                    break
                yield {lang: [(data[:stop], known)]}
                last = data[:stop].rpartition(_END)[2].split()[-MAX_BACK:]
                known, again = len(last), sum(map(len, last)) + len(last)
                data = b" ".join([*last, data[stop:]])
            held[lang].append((data, known))
            size += len(data)
            if size >= block:
                yield held
                held, size = defaultdict(list), 0
    if held:
        yield held


def _stop(data: bytes, start: int, block: int) -> int:
    """Where to cut a long text: behind a blank or the end of a piece, the first one after a block if there is none in its second half."""
    half, end = start + block // 2, start + block
    within = max(data.rfind(b" ", half, end), data.rfind(_END, half, end))
    if within >= 0:
        return within + 1
    return min((at + 1 for at in (data.find(b" ", end), data.find(_END, end)) if at >= 0), default=len(data))


def _tokens(texts: list[tuple[bytes, int]]) -> tuple[list[bytes], np.ndarray]:
    """Words of the texts, with ends of pieces between them, and which of them count as a phrase's last word."""
    words, new = [], []
    for data, known in texts:
        got = data.replace(_END, b" \xff ").split()
        words += got
        words.append(_END)
        new.append(np.arange(len(got) + 1) >= known)
    return words, np.concatenate(new)


COUNTS = "lang string, phrase string, bucket long, n long"


def _counted(docs: DataFrame, size: int, keep: tuple | None, ahead: bool, size_of_block: int = BLOCK) -> DataFrame:
    """Counts of one pass, by block: phrases of ``size`` words that ``keep`` lets through, and with ``ahead`` the buckets of longer ones.

    keep: broadcast bitmaps of the frequent shorter phrases and of the frequent buckets of this size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, own = (k.value for k in keep) if keep else (None, None)
        for block in _blocks(batches, size_of_block):
            for lang, texts in block.items():
                words, new = _tokens(texts)
                number = defaultdict()
                number.default_factory = number.__len__
                end = number[_END]
                codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                names = list(number)
                seed = xxhash.xxh64_intdigest(lang.encode())
                hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in names], np.uint64)
                n = len(codes)
                first = np.arange(max(0, n - size + 1))
                for k in range(size):
                    first = first[codes[first + k] != end]
                if keep:  # both shorter parts, then the bucket
                    for s in (0, 1):
                        first = first[shorter.has(_buckets([hashes[codes[first + s + k]] for k in range(size - 1)]))]
                    first = first[own.has(_buckets([hashes[codes[first + k]] for k in range(size)]))]
                told = first[new[first + size - 1]]
                key = codes[told]
                for k in range(1, size):
                    key = (np.unique(key, return_inverse=True)[1] if k > 1 else key) * len(names) + codes[told + k]
                _, place, count = np.unique(key, return_index=True, return_counts=True)
                which = [codes[told[place] + k].tolist() for k in range(size)]
                phrases = [b" ".join(names[c] for c in cs) for cs in zip(*which, strict=True)]
                if phrases:
                    yield _rows(lang, pa.array(phrases, pa.binary()).cast(pa.string()), None, count)
                if ahead:
                    may = np.zeros(n + 1, bool)
                    may[first] = True
                    longer = first[may[first + 1]]  # both parts of this size may be frequent
                    longer = longer[new[longer + size]]
                    buckets, count = np.unique(_buckets([hashes[codes[longer + k]] for k in range(size + 1)]), return_counts=True)
                    if len(buckets):
                        yield _rows(lang, None, pa.array(buckets.astype(np.int64)), count)

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))


def _rows(lang: str, phrases: pa.Array | None, buckets: pa.Array | None, count: np.ndarray) -> pa.RecordBatch:
    m = len(count)
    return pa.record_batch(
        [pa.array([lang] * m if phrases is not None else [None] * m, pa.string()), phrases if phrases is not None else pa.nulls(m, pa.string()), buckets if buckets is not None else pa.nulls(m, pa.int64()), pa.array(count.astype(np.int64))],
        names=["lang", "phrase", "bucket", "n"],
    )


def frequent(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of ``max_words`` words at most with ``least`` occurrences or more, and (lang, n), all words of each language."""
    if not 1 <= max_words <= MAX_BACK + 1 or least < 1:
        raise ValueError(f"phrases have 1 to {MAX_BACK + 1} words, and least is positive")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    keep, found, total = None, [], None
    for size in range(1, max_words + 1):
        counts = stored(_counted(texts, size, keep, size < max_words, block), f"collocations-{size}")
        exact = counts.where("phrase IS NOT NULL")
        if size == 1:
            total = exact.groupBy("lang").agg(F.sum("n").alias("n"))
        exact = exact.where(F.col("n") >= least)
        found.append(exact.select("lang", "phrase", F.lit(size).alias("words"), F.col("n").alias("a")))
        if size < max_words:
            buckets = counts.where("phrase IS NULL").where(F.col("n") >= least).select("bucket")
            keep = (spark.sparkContext.broadcast(bitmap(_hashed(exact, size))), spark.sparkContext.broadcast(bitmap(buckets)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, total


def _hashed(phrases: DataFrame, size: int) -> DataFrame:
    """The buckets of phrases as the passes compute them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [p.encode().split(b" ") for p in b.column(1).to_pylist()]
            seeds = [xxhash.xxh64_intdigest(g.encode()) for g in b.column(0).to_pylist()]
            hashes = [np.array([xxhash.xxh64_intdigest(w[k], s) for w, s in zip(words, seeds, strict=True)], np.uint64) for k in range(size)]
            yield pa.record_batch([pa.array(_buckets(hashes).astype(np.int64))], names=["bucket"])

    return phrases.select("lang", "phrase").mapInArrow(run, "bucket long")


def score() -> Column:
    """floor(10**6 a**2 / (l r)), exact: counts up to 10**15 fit."""
    return F.expr(f"CAST(CAST({SCALE} AS DECIMAL(38,0)) * a * a AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(19,0)) * r AS DECIMAL(38,0))")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, cover: int = COVER, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more.

    A phrase cut after its first words has l = f(first part), r = f(rest) and the score floor(10**6 a**2 / (l r)); its lowest cut counts. A
    phrase is left out where a longer one that contains it has ``cover`` percent or more of its occurrences.
    """
    phrases, total = frequent(docs, max_words, least, block)
    part = phrases.select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    joined = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    some = phrases.where("words > 1")
    cuts = some.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("words") - F.col("k"))})
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    lowest = cuts.withColumn("score", score()).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # every shorter phrase of two words or more inside a longer one, with the most that any longer one has
    inside = some.where("words > 2").select("lang", "a", "words", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inside = inside.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1), lambda s: F.array_join(F.slice("w", s, F.col("m")), " "))).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True)))
    # the first of each of some parts of a language, then of all: no task ranks a language's phrases alone
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    best = best.withColumn("rank", rank("lang", "part")).where(F.col("rank") <= top).withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
