"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (Han characters, Hangul syllables and letters beyond the basic plane share
some thousands, by a hash). A trigram's vector binds its
letters' vectors, permuted by their places (a roll each), by multiplication; a
text's vector bundles those of all its trigrams by addition. The prototype of a
language bundles the normalised vectors of sample texts in it, and a document
gets the language whose prototype has the largest cosine with its vector.

Letters are lower-cased; a run of anything else is one boundary. Learning takes
a hash sample of at most ``SAMPLE`` texts of each language in expectation, all
of them where there are fewer; every text is scored whole.

A table of more than ``LANGS`` languages is refused: prototypes must fit the driver and every task.

Defined results: an empty table gives no rows; of equal cosines the first language by name wins; texts of any length are
counted whole; other columns are not read; a null text and one without a letter are ``und`` with score 0;
so is everything if nothing could be learned; rows with a null lang are scored
and not learned from; a null doc_id counts as held out; repeated rows are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET, SIZE, SEED = 1 << 14, 1024, 7
#: Languages that can be learned.
LANGS = 500
#: Texts of a language that its prototype is learned from, in expectation.
SAMPLE = 1500
#: Scales cosines to a softmax score; letters that are counted at once.
SHARP, CHUNK = 25.0, 400_000
_V = ALPHABET**3


def _letter_table() -> np.ndarray:
    """Code points below 65536 to 0 (no letter), 1 to 26 (a to z), a number of their own, or, from 0x2E80 to 0xDFFF, a hashed number after those."""
    table, own = np.zeros(1 << 16, np.uint16), 27
    for cp in range(1 << 16):
        c = chr(cp)
        if "a" <= c <= "z":
            table[cp] = cp - 96
        elif c.isalpha() and not 0x2E80 <= cp < 0xE000:
            table[cp], own = own, own + 1
    for cp in range(0x2E80, 0xE000):
        if chr(cp).isalpha():
            table[cp] = _hashed(cp, own)
    return table


def _hashed(cp: int, first: int) -> int:
    return first + cp * 40503 % (ALPHABET - first)


_cache: dict[str, np.ndarray] = {}


def letters(text: str) -> np.ndarray:
    """The letters' numbers, with a 0 at either end and between words."""
    if "table" not in _cache:
        _cache["table"] = _letter_table()
    cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    table = _cache["table"]
    x = table[np.minimum(cps, 0xFFFF)]
    if len(cps) and cps.max() > 0xFFFF:
        for i in np.flatnonzero(cps > 0xFFFF).tolist():
            x[i] = _hashed(int(cps[i]), ALPHABET // 2) if chr(int(cps[i])).isalpha() else 0
    x = np.concatenate((np.zeros(1, np.uint16), x, np.zeros(1, np.uint16)))
    return x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]


def trigrams(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.int64)
    return (y[:-2] * ALPHABET + y[1:-1]) * ALPHABET + y[2:] if len(y) >= 3 else np.empty(0, np.int64)


def bound(grams: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The vectors of trigrams."""
    key = f"letters{size}"
    if key not in _cache:
        _cache[key] = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (ALPHABET, size))
    base = _cache[key]
    a, b, c = grams // ALPHABET**2, grams // ALPHABET % ALPHABET, grams % ALPHABET
    return np.roll(base[a], 2, axis=1) * np.roll(base[b], 1, axis=1) * base[c]


def vectors(texts: list[str | None], size: int = SIZE) -> np.ndarray:
    """A unit vector per text; zero for texts without a letter."""
    out = np.zeros((len(texts), size), np.float32)
    k = 0
    while k < len(texts):
        grams, total, first = [], 0, k
        while k < len(texts) and (not grams or total < CHUNK and k - first < 256):
            x = letters(texts[k]) if texts[k] else np.zeros(1, np.uint16)
            grams.append(trigrams(x) if x.any() else np.empty(0, np.int64))
            total += len(grams[-1])
            k += 1
        keys, counts = np.unique(np.concatenate([g + i * _V for i, g in enumerate(grams)]), return_counts=True)
        seen, at = np.unique(keys % _V, return_inverse=True)
        table = np.zeros((len(grams), len(seen)), np.float32)
        table[keys // _V, at] = counts
        out[first:k] = table @ bound(seen, size).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; true where there is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> tuple[list[str], np.ndarray]:
    """(languages, their unit prototypes) from the rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGS + 1).collect()}  # a row per language
    if len(counts) > LANGS:
        raise ValueError(f"lang has more than {LANGS} values; clean the column or raise LANGS")
    if not counts:
        return [], np.zeros((0, size), np.float32)
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, sample / n))])
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for k in range(0, b.num_rows, 512):
                vs = np.rint(vectors(b.column(0).slice(k, 512).to_pylist(), size).astype(np.float64) * 2**20).astype(np.int64)  # whole numbers add up alike in any order
                for lang in set(langs[k : k + 512]):
                    sums[lang] = sums.get(lang, 0) + vs[langs[k : k + 512] == lang].sum(axis=0)
        n = len(sums)
        yield pa.record_batch([pa.array(np.repeat(list(sums), size) if n else [], pa.string()), pa.array(np.tile(np.arange(size), n), pa.int32()), pa.array(np.concatenate(list(sums.values())) if n else [], pa.int64())], names=["lang", "at", "v"])

    sampled = rows.where(luck < F.element_at(share, F.col("lang"))).select(F.col("text").cast("string"), "lang")
    totals = sampled.mapInArrow(run, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in totals})
    table = np.zeros((len(langs), size), np.float64)
    for r in totals:
        table[langs.index(r["lang"]), r["at"]] = r["v"]
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return langs, (table / np.where(norm == 0, 1, norm)).astype(np.float32)


def identify(docs: DataFrame, sample: int = SAMPLE, size: int = SIZE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cosine) for every row of ``docs``."""
    langs, prototypes = learn(docs, sample, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            preds, scores, cosines = [], [], []
            for k in range(0, b.num_rows, 512):
                vs = vectors(b.column(2).slice(k, 512).to_pylist(), size)
                if not langs:
                    vs = vs * 0
                cos = vs @ prototypes.T if langs else np.zeros((len(vs), 1), np.float32)
                best, some = cos.argmax(axis=1), vs.any(axis=1)
                soft = np.exp(SHARP * (cos.astype(np.float64) - cos.max(axis=1, keepdims=True)))
                preds += [langs[i] if ok else "und" for i, ok in zip(best.tolist(), some.tolist(), strict=True)]
                scores.append(np.where(some, 1 / soft.sum(axis=1), 0.0))
                cosines.append(np.where(some, cos.max(axis=1), 0.0).astype(np.float64))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(preds, pa.string()), pa.array(np.concatenate(scores or [np.empty(0)])), pa.array(np.concatenate(cosines or [np.empty(0)]))], names=["doc_id", "held_out", "lang_pred", "score", "cosine"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cosine double")
