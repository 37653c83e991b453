"""The automaton scan and the rearrangement, against plain Python over whole texts."""

import hashlib
import random

import duckdb
import pytest

from curvelab.llm import fim
from curvelab.llm import queries as q
from tests.llm.conftest import ODD

MARKED = ["<P>", "a <P b", "x<S>y", "<<M>", "<", "<M", "é<P>é", "<P<S<M>"]


def ends_of(text, unit):
    """Bytes up to the end of each unit."""
    out, at, word = [], 0, False
    for c in text:
        at += len(c.encode())
        blank = c in "\t\n\x0b\x0c\r "
        if unit == "characters" or (unit == "lines" and c == "\n") or (unit == "words" and blank and word):
            out.append(at)
        word = not blank
    return out


def texts(n=60):
    pick = random.Random(5)
    return MARKED + ["".join(pick.choice(["a", "é", "漢", "😀", " ", "\n", "<", "P", "S", ">", "\t"]) for _ in range(pick.choice([0, 1, 5, 63, 64, 65, 300, 2000]))) for _ in range(n)]


@pytest.mark.parametrize("unit", ["characters", "words", "lines"])
def test_scan_of_whole_pieces(unit):
    auto = fim.automaton(unit, fim.MARKS)
    ts = texts()
    scan = fim.Scan([t.encode() for t in ts], auto)
    for i, t in enumerate(ts):
        ends, (to, count) = ends_of(t, unit), scan.function(i)
        assert count[0] == len(ends) and auto.found[to[0]] == any(m in t for m in fim.MARKS)
        for k in {0, 1, len(ends) // 2, len(ends)} & set(range(len(ends) + 1)):
            assert scan.cut(i, 0, k) == ([0] + ends)[k]


@pytest.mark.parametrize("unit", ["characters", "words", "lines"])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100])
def test_functions_of_chunks_compose(unit, size):
    """Chunks that cut characters and marks anywhere give what the whole text gives."""
    auto = fim.automaton(unit, fim.MARKS)
    for t in texts(25):
        data = t.encode()
        chunks = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
        scan, state, n, begun = fim.Scan(chunks, auto), 0, 0, []
        for i in range(len(chunks)):
            begun.append((n, state))
            to, count = scan.function(i)
            state, n = int(to[state]), n + int(count[state])
        ends = ends_of(t, unit)
        assert n == len(ends) and auto.found[state] == any(m in t for m in fim.MARKS)
        for k in {1, len(ends) // 3, len(ends)} - {0} if ends else ():
            c = max(i for i, (before, _) in enumerate(begun) if before < k)
            assert c * size + scan.cut(c, begun[c][1], k - begun[c][0]) == ends[k - 1]


def brute(doc_id, text):
    text = text or ""
    n, x = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("chunk", [16, 150, fim.CHUNK])
def test_documents_of_one_chunk_and_of_many(spark, make, chunk):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts()))]
    got = fim.rearranged(make(rows, extra=True), chunk=chunk)
    assert sorted([(r["doc_id"], r["units"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in got.collect()], key=repr) == sorted([brute(*r[:2]) for r in rows], key=repr)


def test_further_columns_stay(spark, make):
    got = fim.rearranged(make([(1, "some text"), (2, "x" * 100)], extra=True).withColumnRenamed("label", "form"), chunk=20)
    assert {"_form", "form", "shard", "n", "lang"} <= set(got.columns) and {(r["n"], r["form"], r["units"]) for r in got.collect()} == {("x", "x", 9), ("x", "x", 100)}


def test_words_and_lines_as_units(spark, make):
    rows = [(i, "one two\nthree four five\nsix\n" * 9) for i in range(30)]
    for unit in ("words", "lines"):
        for r in fim.rearranged(make(rows), unit=unit, chunk=50).where("form = 'psm'").collect():
            prefix = r["output"][3:].split("<S>")[0]
            assert len(ends_of(prefix, unit)) == r["prefix_units"] and (not prefix or prefix[-1] in " \n")


def test_query_against_sql(spark, tmp_path, make):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts())), (999, "é" * 200_000)]
    rows = [r for r in rows if r[0] is not None]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.QUERIES["op11_automaton_fim"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({q.ORACLE_SQL['op11_automaton_fim']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.where("output_sha256 <> restored_sha256 AND form = 'plain'").count() == 0


def test_empty_table(spark, make):
    assert fim.digests(make([])).collect() == []
