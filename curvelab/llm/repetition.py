"""Quality rules by repetition coverage.

For each of several n-gram lengths, rolling hashes of a document's words are
made in numpy, and the characters inside n-grams that occur more than once are
measured as a share of all characters of words; so are the characters of lines
that repeat an earlier line. A document stays if it passes the base rules and no
share is over its limit.

Defined results: an empty table gives no rows; a text of any length is measured whole in one task; null, empty and blank texts have no words and fail the base
rules; repeated rows are judged alike; no other column is read but doc_id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest share of characters inside duplicated n-grams, by n. All occurrences
#: count, the first one too, and documents may be a few dozen words long, where
#: one stock line printed twice is a quarter of the text: the limits are looser
#: than those published for long web pages, and fall with n like them.
NGRAM_LIMITS = {5: 0.36, 6: 0.34, 7: 0.32, 8: 0.30, 9: 0.28, 10: 0.26}
#: Largest share of characters in the lines that repeat an earlier line.
LINE_LIMIT = 0.20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(h: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window (by its hash) found twice or more."""
    inside = np.zeros(len(h) + n - 1, dtype=bool)
    if len(h) < 2:
        return inside
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return inside
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(inside) + 1, dtype=np.int64)
    steps[:-n][twice] += 1
    steps[n:][twice] -= 1
    return np.cumsum(steps[:-1]) > 0


def measure(text: bytes | None) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, then the characters inside duplicated n-grams of each length."""
    words = text.split() if text else []
    if not words:
        return [0, 0, int(_IS_SYMBOL[np.frombuffer(text, np.uint8)].sum()) if text else 0] + [0] * (3 + len(NGRAM_LIMITS))
    raw = np.frombuffer(text, np.uint8)
    symbols = int(_IS_SYMBOL[raw].sum())
    ids: dict[bytes, int] = defaultdict(count().__next__)
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    if text.isascii():
        chars = np.fromiter(map(len, words), np.int64, len(words))
    else:
        chars = np.fromiter(map(len, words), np.int64, len(words)) - _tails(words)
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(_length, line.split()))
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    rolled, repeat_words, by_n = _mixed(w + np.uint64(1)), 0, []
    single, longest = rolled.copy(), max(NGRAM_LIMITS)
    for n in range(2, longest + 1):  # the hash of n words from that of n - 1
        if len(words) < n:
            by_n += [0] * sum(k >= n for k in NGRAM_LIMITS)
            break
        rolled = rolled[:-1] * _STEP + single[n - 1 :]
        if n == 3:
            repeat_words = int(covered(_mixed(rolled), 3).sum())
        elif n in NGRAM_LIMITS:
            by_n.append(int(chars[covered(_mixed(rolled), n)].sum()) if repeat_words else 0)  # no repeated 3-gram, no longer one
    return [len(words), int(chars.sum()), symbols, dup_lines, repeat_words, dup_chars, *by_n]


def _length(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8", "replace"))


def _tails(words: list[bytes]) -> np.ndarray:
    """UTF-8 continuation bytes in each word."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    tails = np.concatenate(([0], np.cumsum((flat & 0xC0) == 0x80)))
    return tails[ends] - tails[np.concatenate(([0], ends[:-1]))]


def verdict(m: list[int]) -> tuple[bool, bool]:
    """(base_failed, kept) from the measures."""
    failed = m[0] < MIN_WORDS or 100 * m[4] > MAX_REPEAT_PERCENT * m[0]
    ok = m[5] <= LINE_LIMIT * m[1] and all(c <= limit * m[1] for c, limit in zip(m[6:], NGRAM_LIMITS.values(), strict=True))
    return failed, not failed and ok


def coverage(docs: DataFrame) -> DataFrame:
    """A row of measures and verdicts per row of ``docs``; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                m = measure(t.as_py())
                rows.append([*m[:5], *verdict(m), *m[5:]])
            columns = list(zip(*rows, strict=True)) or [[]] * (8 + len(NGRAM_LIMITS))
            kinds = [pa.bool_() if i in (5, 6) else pa.int64() for i in range(len(columns))]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([b.column(0), *arrays], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(at).cast(pa.binary()) if b.column(at).type != pa.large_string() else b.column(at).cast(pa.large_binary())
            yield b.filter(pa.array([verdict(measure(t.as_py()))[1] for t in text], pa.bool_()))

    return docs.mapInArrow(run, schema)
