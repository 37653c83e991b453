import hashlib
import math
from collections import Counter

import pytest

from curvelab.llm import mixing


def plain_count(doc_id, rate, seed=mixing.SEED):
    m, n = max(math.ceil(rate / mixing.PART), 1), 0
    for j in range(m):
        u, mean = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}/{j}".encode()).hexdigest()[:13], 16) / 2**52, rate / m
        p = c = math.exp(-mean)
        for k in range(1, mixing.STEPS + 1):
            if u < c:
                break
            p *= mean / k
            c += p
            n += 1
    return n


def test_counts_order_and_shares(spark, make):
    rows = [(i, "x" * (10 + i % 5), "en", "a" if i % 3 else "b") for i in range(3000)] + [(9000, None, "en", "b"), (9001, "zz", None, None), (9002, "zz", "en", "other")]
    docs = make(rows, extra=True)
    rates = mixing.rates(docs, {"a": 1, "b": 3, "gone": 5})
    out = mixing.mix(docs, {"a": 1, "b": 3, "gone": 5})
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    want = {r[0]: plain_count(r[0], rates.get(r[3], 1.0) if r[3] else 1.0) for r in rows}
    assert Counter(r.doc_id for r in got) == Counter({d: n for d, n in want.items() if n})
    assert [r._mix_key for r in got] == sorted(r._mix_key for r in got)
    share = sum(len(r.text or "") for r in got if r.source == "b") / sum(len(r.text or "") for r in got)
    assert 0.7 < share < 0.8
    assert rates["gone"] == 0


def test_large_rates_keep_their_mean(spark, make):
    docs = make([(i, "x", "en", "tiny" if i < 100 else "big") for i in range(10_000)])
    n = Counter(r.source for r in mixing.mix(docs, {"tiny": 1, "big": 1}).select("source").collect())
    assert abs(n["tiny"] - 5000) < 300 and abs(n["big"] - 5000) < 300


def test_odd_rows_and_empty_tables(spark, make, odd):
    docs = make(odd, extra=True)
    assert {r.doc_id for r in mixing.mix(docs, {"src1": 1}).collect()} <= {r[0] for r in odd}
    assert mixing.mix(make([]), {"src1": 1}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src1": 0})
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src1": -1, "b": 2})
