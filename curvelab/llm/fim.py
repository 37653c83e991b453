"""Fill-in-the-middle rearrangement of whole documents by a parallel automaton scan.

A finite automaton over bytes finds where units (characters, words or lines) end and whether a text holds one of
the marks that the rearrangement inserts. A chunk of a text can be scanned before the state at its start is known: it
gives a function from each state at its start to the state at its end, and the number of units that end in it
from each of them. Such functions compose associatively, so a document's chunks are scanned by any tasks, composed
to the state and count at every chunk's start, and the two chunks that hold the cuts find them. Within
a task the same composition runs over rows of 64 bytes, in numpy. Documents of one chunk are scanned where they lie; longer
ones are written in chunks, which are dealt over all tasks.

Defined results: an empty table gives no rows; a null text is taken as empty and gives an empty output; an empty text and one with
a mark in it stay plain; a null doc_id draws the numbers of an empty id; repeated rows give equal rows; equal cuts give an
empty middle; further columns are kept, and new ones whose names clash get underscores; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelab.llm.common import stored, unique_names

#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = "1"
#: Percent of documents that stay plain, and of the others with the suffix first.
PLAIN, SPM = 10, 20
#: Bytes of a chunk, and of a row of the scan within a task.
CHUNK, ROW = 1 << 16, 64
#: Bytes that a task scans at a time.
BLOCK = 1 << 20


def _characters() -> tuple[int, list[list[tuple[int, bool]]]]:
    """States: the bytes still due of a UTF-8 character; a unit ends with its last byte."""
    due = lambda b: 0 if b < 0xC0 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
    return 0, [[(due(b), due(b) == 0) if s == 0 else (s - 1, s == 1) for b in range(256)] for s in range(4)]


def _lines() -> tuple[int, list[list[tuple[int, bool]]]]:
    """A unit ends with a line feed."""
    return 0, [[(0, b == 10) for b in range(256)]]


def _words() -> tuple[int, list[list[tuple[int, bool]]]]:
    """States: after a blank, within a word; a unit ends with the blank that ends a word."""
    blank = {9, 10, 11, 12, 13, 32}
    return 0, [[(0 if b in blank else 1, False) for b in range(256)], [(0, True) if b in blank else (1, False) for b in range(256)]]


UNITS = {"characters": _characters, "words": _words, "lines": _lines}


class Automaton:
    """The product of a unit's automaton with one that looks for marks; state 0 is the start.

    ``step[s * 257 + b]`` is the next state, ``ends`` whether a unit ends; byte 256 stands for none and changes nothing.
    """

    def __init__(self, unit: str, marks: tuple[str, ...]):
        start, table = UNITS[unit]()
        words = [m.encode() for m in marks]
        prefixes = {w[:k] for w in words for k in range(len(w))} | {b""}

        def looked(seen: bytes | None, b: int) -> bytes | None:
            """The longest suffix that begins a mark; None once a mark is found."""
            if seen is None or any((seen + bytes([b])).endswith(w) for w in words):
                return None
            seen += bytes([b])
            return next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in prefixes)

        states, todo, rows = {(start, b""): 0}, [(start, b"")], []
        while todo:
            s, seen = todo.pop(0)
            row = []
            for b in range(256):
                (t, ended), m = table[s][b], looked(seen, b)
                if (t, m) not in states:
                    states[t, m] = len(states)
                    todo.append((t, m))
                row.append((states[t, m], ended))
            rows.append([*row, (states[s, seen], False)])
        self.size = len(rows)
        self.step = np.array([[n for n, _ in r] for r in rows], np.int64).ravel()
        self.ends = np.array([[e for _, e in r] for r in rows], np.int64).ravel()
        self.found = [m is None for _, m in states]


@lru_cache(maxsize=16)
def automaton(unit: str, marks: tuple[str, ...]) -> Automaton:
    """One per worker process and use."""
    return Automaton(unit, marks)


class Scan:
    """Pieces of text scanned at once: for every row of 64 bytes the function from the state at its piece's start."""

    def __init__(self, pieces: list[bytes], auto: Automaton):
        self.auto, self.pieces = auto, pieces
        rows = [max(1, -(-len(p) // ROW)) for p in pieces]
        self.first = np.concatenate([[0], np.cumsum(rows)])
        data = np.full((self.first[-1], ROW), 256, np.int64)
        flat = data.reshape(-1)
        for p, f in zip(pieces, self.first, strict=False):
            flat[f * ROW : f * ROW + len(p)] = np.frombuffer(p, np.uint8)
        to = np.repeat(np.arange(auto.size)[:, None], len(data), 1)
        count = np.zeros_like(to)
        for k in range(ROW):  # every state at once, over all rows
            at = to * 257 + data[:, k]
            count += auto.ends[at]
            to = auto.step[at]
        to, count = np.ascontiguousarray(to.T), np.ascontiguousarray(count.T)
        place, d, longest = np.arange(len(data)) - np.repeat(self.first[:-1], rows), 1, max(rows, default=0)
        while d < longest:  # functions over 2d rows from those over d
            late = np.flatnonzero(place >= d)
            early = to[late - d]
            count[late] = count[late - d] + np.take_along_axis(count[late], early, 1)
            to[late] = np.take_along_axis(to[late], early, 1)
            d *= 2
        self.to, self.count = to, count

    def function(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The states at piece i's end and the units ended in it, by the state at its start."""
        return self.to[self.first[i + 1] - 1], self.count[self.first[i + 1] - 1]

    def cut(self, i: int, state: int, k: int) -> int:
        """The bytes of piece i up to the end of its k-th unit, where it is entered in ``state``."""
        if k == 0:
            return 0
        a, b = self.first[i], self.first[i + 1]
        row = int(np.searchsorted(self.count[a:b, state], k))
        at, s, seen = row * ROW, state, 0
        if row:
            s, seen = int(self.to[a + row - 1, state]), int(self.count[a + row - 1, state])
        while seen < k:
            e = s * 257 + self.pieces[i][at]
            seen, s, at = seen + int(self.auto.ends[e]), int(self.auto.step[e]), at + 1
        return at


def _scans(pieces: list[bytes], auto: Automaton) -> Iterator[tuple[int, Scan]]:
    """Scans of some pieces each, with the number of the first."""
    begin, held = 0, 0
    for i, p in enumerate(pieces):
        held += len(p) + ROW
        if held >= BLOCK or i + 1 == len(pieces):
            yield begin, Scan(pieces[begin : i + 1], auto)
            begin, held = i + 1, 0


def numbers(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits by hash."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _cut_counts(n: Column, one: Column, two: Column) -> tuple[Column, Column]:
    a, b = F.pmod(one, n + 1), F.pmod(two, n + 1)
    return F.least(a, b), F.greatest(a, b)


_CUTS = [T.StructField("n", T.LongType()), T.StructField("found", T.BooleanType()), T.StructField("u1", T.LongType()), T.StructField("u2", T.LongType()), T.StructField("p1", T.LongType()), T.StructField("p2", T.LongType())]


def _cut_whole(docs: DataFrame, text: str, seed: str, unit: str, marks: tuple[str, ...], names: list[str]) -> DataFrame:
    """Cuts of documents of one chunk, appended to their columns."""
    one, two = unique_names("h1", "h2", taken=[*docs.columns, *names])
    h = numbers(F.col("doc_id"), seed)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit, marks)
        for b in batches:
            h1, h2, out = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), []
            for begin, scan in _scans([t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()], auto):
                for i in range(len(scan.pieces)):
                    end, count = scan.function(i)
                    n, k = int(count[0]), begin + i
                    u1, u2 = sorted((h1[k] % (n + 1), h2[k] % (n + 1)))
                    out.append((n, auto.found[end[0]], u1, u2, scan.cut(i, 0, u1), scan.cut(i, 0, u2)))
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            new = [pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)]
            yield pa.record_batch([*b.columns[:-2], *new], names=[*b.schema.names[:-2], *names])

    return docs.withColumns({one: h[0], two: h[1]}).mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, f.dataType) for c, f in zip(names, _CUTS, strict=True)]]))


def _cut_giants(docs: DataFrame, text: str, seed: str, unit: str, marks: tuple[str, ...], names: list[str], chunk: int) -> DataFrame:
    """Cuts of documents of many chunks, which all tasks scan."""
    row, *work = unique_names("row", *names, taken=docs.columns)
    giants = stored(docs.withColumn(row, F.monotonically_increasing_id()), "fim-giants")
    data = giants.select(F.col(row).alias("row"), F.encode(text, "UTF-8").alias("data"))
    each = data.select("row", "data", F.explode(F.sequence(F.lit(0), ((F.octet_length("data") - 1) / chunk).cast("int"))).alias("no"))
    chunks = stored(each.select("row", "no", F.substring("data", F.col("no") * chunk + 1, F.lit(chunk)).alias("data")).repartition("row", "no"), "fim-chunks")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit, marks)
        for b in batches:
            ends, counts = [], []
            for _, scan in _scans(b.column(2).to_pylist(), auto):
                for i in range(len(scan.pieces)):
                    end, count = scan.function(i)
                    ends.append(end.tolist())
                    counts.append(count.tolist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ends, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["row", "no", "ends", "counts"])

    def composed(table: pa.Table) -> pa.Table:
        """The states and counts at the starts of one document's chunks, and at its end."""
        table, auto = table.sort_by("no"), automaton(unit, marks)
        state, n, states, before = 0, 0, [], []
        for end, count in zip(table.column("ends").to_pylist(), table.column("counts").to_pylist(), strict=True):
            states.append(state)
            before.append(n)
            state, n = end[state], n + count[state]
        return pa.table([[table.column("row")[0].as_py()], [n], [auto.found[state]], pa.array([states], pa.list_(pa.int32())), pa.array([before], pa.list_(pa.int64()))], names=["row", "n", "found", "states", "before"])

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit, marks)
        for b in batches:
            data, states, ks = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()
            at = [Scan([d], auto).cut(0, s, k) for d, s, k in zip(data, states, ks, strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([no * chunk + a for no, a in zip(b.column(1).to_pylist(), at, strict=True)], pa.int64())], names=["row", "which", "at"])

    h = numbers(F.col("doc_id"), seed)
    functions = chunks.mapInArrow(scanned, "row long, no int, ends array<int>, counts array<long>")
    whole = functions.groupBy("row").applyInArrow(composed, "row long, n long, found boolean, states array<int>, before array<long>")
    drawn = whole.join(giants.select(F.col(row).alias("row"), h[0].alias("one"), h[1].alias("two")), "row")
    u1, u2 = _cut_counts(F.col("n"), F.col("one"), F.col("two"))
    plan = stored(drawn.select("row", "n", "found", "states", "before", u1.alias("u1"), u2.alias("u2")), "fim-plan")
    wanted = plan.select("row", "states", "before", F.posexplode(F.array("u1", "u2")).alias("which", "u"))
    no = F.greatest(F.size(F.filter("before", lambda c: c < F.col("u"))) - 1, F.lit(0))  # the chunk in which the u-th unit ends
    wanted = wanted.withColumn("no", no).select("row", "no", "which", F.get("states", F.col("no")).alias("state"), (F.col("u") - F.get("before", F.col("no"))).alias("k"))
    found = chunks.join(wanted, ["row", "no"]).select("row", "no", "which", "data", "state", "k").mapInArrow(selected, "row long, which int, at long")
    cuts = found.groupBy("row").agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("p1"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("p2"))
    cuts = plan.select("row", "n", "found", "u1", "u2").join(cuts, "row").select(F.col("row").alias("_of"), *[F.col(f.name).alias(w) for f, w in zip(_CUTS, work, strict=True)])
    return giants.join(cuts, F.col(row) == F.col("_of")).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(w).alias(c) for w, c in zip(work, names, strict=True)])


def rearranged(docs: DataFrame, seed: str = SEED, unit: str = "characters", marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, spm: int = SPM, text: str = "text", chunk: int = CHUNK, names: tuple[str, ...] = ("units", "form", "prefix_units", "middle_units", "output")) -> DataFrame:
    """The columns of ``docs`` with the number of its units, the form, the units before the first cut and between the cuts (null if plain), and the rearranged text."""
    new = unique_names(*names, taken=docs.columns)
    work = unique_names("n", "found", "u1", "u2", "p1", "p2", taken=[*docs.columns, *new])
    long = F.coalesce(F.octet_length(text), F.lit(0)) > chunk
    cut = _cut_whole(docs.where(~long), text, seed, unit, marks, work).unionByName(_cut_giants(docs.where(long), text, seed, unit, marks, work, chunk))
    n, found, u1, u2, p1, p2 = map(F.col, work)
    h = numbers(F.col("doc_id"), seed)
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    form = F.when(found | (F.octet_length(data) == 0) | (F.pmod(h[2], F.lit(100)) >= 100 - plain), "plain").when(F.pmod(h[3], F.lit(100)) < spm, "spm").otherwise("psm")
    part = lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    prefix, middle, suffix = part(F.lit(0), p1), part(p1, p2), part(p2, F.octet_length(data))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col(new[1]) == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col(new[1]) == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.coalesce(F.col(text), F.lit("")))
    kept = F.col(new[1]) != "plain"
    out = cut.withColumn(new[1], form).withColumns({new[0]: n, new[2]: F.when(kept, u1), new[3]: F.when(kept, u2 - u1), new[4]: output})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *new)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of; each mark occurs in it exactly once unless it is plain."""
    p, s, m = marks
    middle, rest = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, s, 1), p, -1), middle, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), middle, F.substring_index(F.substring_index(rest, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """What the rearrangement of each document is, with checksums of the output and of the text rebuilt from it."""
    made = rearranged(docs.select("doc_id", "text"), names=("n", "form", "prefix_chars", "middle_chars", "output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
