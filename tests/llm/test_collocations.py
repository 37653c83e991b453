"""Hashed passes against counting every phrase."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from curvelab.llm import collocations as C
from curvelab.llm import queries as q
from tests.llm.conftest import ODD


def brute(rows, max_words=3, least=10, top=2000, cover=50):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        mine = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        scored = []
        for p, a in mine.items():
            longer = [b for o, b in mine.items() if len(o) > len(p) and any(o[i : i + len(p)] == p for i in range(len(o)))]
            if any(100 * b >= cover * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, lf, r, n[lang], -s) for i, (s, a, p, lf, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def prose(n, seed=6, langs=("en", "de", None)):
    pick = random.Random(seed)
    words = ["New", "york", "city", "Of", "the", "in", "a", "très", "été", "漢", "x_y", "a-b", "'s", "<|x|>"]
    stock = ["New York City", "of the", "in the end", "carte bleue très chère", "a a a a"]
    rows = []
    for i in range(n):
        parts = [pick.choice(stock) if pick.random() < 0.3 else pick.choice(words) for _ in range(pick.randint(0, 40))]
        text = "".join(p + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "\r\n"]) for p in parts)
        rows.append((i, text, pick.choice(langs), "src1"))
    return rows


@pytest.mark.parametrize(("max_words", "least", "cover"), [(3, 10, 50), (2, 3, 50), (5, 4, 80)])
def test_against_counting_all(spark, make, max_words, least, cover):
    rows = prose(250)
    got = C.collocations(make(rows, extra=False).repartition(3), max_words=max_words, least=least, cover=cover, top=40)
    assert sorted(map(tuple, got.collect())) == brute(rows, max_words, least, 40, cover)


@pytest.mark.parametrize("block", [1, 30, 500])
def test_long_texts_in_overlapping_blocks(spark, make, block):
    rows = [(1, " ".join(t for _, t, *_ in prose(30)), "en", "s"), (2, "no ends here " * 200, "en", "s"), (3, "w" * 900 + " y" * 12, "en", "s")]
    assert sorted(map(tuple, C.collocations(make(rows), least=3, block=block).collect())) == brute(rows, least=3)


def test_blocks_hold_every_word_once():
    rows = prose(20) + [(99, "v" * 5000, "en", "s"), (98, " ".join("u" * 700 for _ in range(30)), "en", "s")]
    batch = pa.record_batch([pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    for block in (1, 50, 1000, 10**6):
        count = Counter()
        for held in C._blocks(iter([batch]), block):
            for lang, texts in held.items():
                words, new = C._tokens(texts)
                count.update((lang, w) for w, n in zip(words, new, strict=True) if n and w != b"\xff")
        want = Counter((r[2], w.encode()) for r in rows for w in re.sub("[A-Z]", lambda m: m[0].lower(), r[1]).translate(str.maketrans(dict.fromkeys(".,;:!?\n\r\x0b\x0c", " "))).split())
        assert count == want


def test_odd_rows(spark, make):
    rows = [(*r, "en", "s")[:4] if len(r) < 3 else (*r, None)[:4] for r in ODD] + [(50, "a\x00b c" * 12, None, None)]
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", None) for r in rows]
    assert sorted(map(tuple, C.collocations(make(rows, extra=True)).collect())) == brute(rows)


def test_bitmap_grows_with_its_buckets_and_loses_none(spark):
    import numpy as np

    for n in (0, 1, 1000, 50_000):
        buckets = np.unique(np.random.default_rng(n).integers(0, 1 << 32, n))
        b = C.bitmap(spark.createDataFrame(pa.table({"bucket": pa.array(buckets, pa.int64())})))
        assert b.has(buckets.astype(np.uint64)).all() and len(b.body) * 8 >= 8 * n
        others = np.random.default_rng(1).integers(0, 1 << 32, 10_000).astype(np.uint64)
        assert b.has(others).mean() < 0.16


def test_products_beyond_64_bits(spark):
    """The score's products are exact where 64 bits would overflow."""
    from pyspark.sql import functions as F

    a, lf, r = 3_000_000_007, 4_000_000_009, 5_000_000_029
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(lf).alias("l"), F.lit(r).alias("r"))
    assert row.select(C.score()).first()[0] == 1_000_000 * a * a // (lf * r)


def test_query_against_sql(spark, tmp_path, make):
    make(prose(400, seed=7)).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.QUERIES["op12_pcy_collocations"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({q.ORACLE_SQL['op12_pcy_collocations']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) == brute(prose(400, seed=7))


def test_empty_table(spark, make):
    assert C.collocations(make([])).collect() == []
