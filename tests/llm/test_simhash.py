import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from curvelab.llm import simhash
from curvelab.llm.components import components, forest


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    roots = forest(edges)
    name = {}
    for i, d in enumerate(ids):
        r = roots.get(i, i)
        name[r] = min([x for x in (name.get(r), d) if x is not None], default=None)
    return [name[roots.get(i, i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "Ä Öb c d", "x y z " * 400, "a\x0bb\x1cc d e", "é " * 70000])
def test_fingerprint_is_the_stated_one(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_variants_meet_exactly_where_a_segment_differs_by_one_bit_at_most(spark):
    fps = [0, 1 << 5, 1 << 40, (1 << 5) | (1 << 40), -1]
    rows = simhash.variants(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    keys = {x: {r.key for r in rows if r.fp == x} for x in fps}
    assert all(len(k) == 64 for k in keys.values())
    assert len(keys[0] & keys[1 << 5]) == 33  # the one that leaves bit 5 out, and all of the other segment
    assert len(keys[0] & keys[(1 << 5) | (1 << 40)]) == 2
    assert not keys[0] & keys[-1]


def near(rng, n, base, bits):
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(n)]


@pytest.mark.parametrize("block", [2, 7, 2048])
def test_links_have_the_components_of_all_pairs(spark, block):
    rng = random.Random(block)
    fps = sorted(set(near(rng, 60, rng.getrandbits(64), 3) + near(rng, 20, rng.getrandbits(64), 6) + [rng.getrandbits(64) for _ in range(50)]))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 64 for a, b in edges)
    got, want = forest((a, b) for a, b in edges), forest((signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3)
    assert got == want


def test_documents_against_brute_force(spark, make, odd):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)]
    rows = list(odd)
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((100 + i, " ".join(w)))
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{x:016x}" for x in fps], plain_components([r[0] for r in rows], fps)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(make(rows, extra=True), block=8).collect()), key=str)
    assert got == want
    kept = simhash.keep_one(make(rows, extra=True)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([c for c in {w[2] for w in want if w[2] is not None}] + [None], key=str)


def test_one_row_of_a_component_stays(spark, make):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (7, a), (9, b), (None, a), (None, c), (None, c), (11, d), (None, d), (12, d)]
    kept = simhash.keep_one(make(rows, extra=True))
    assert kept.columns == make(rows, extra=True).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, a), (5, b), (None, c), (11, d)], key=str)


def test_empty_table(spark, make):
    assert simhash.near_duplicates(make([])).collect() == []
    assert simhash.keep_one(make([])).collect() == []


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 4), (4, 5), (5, 3), (9, 9), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(200, 260)]}, 3: 3, 4: 3, 5: 3}
