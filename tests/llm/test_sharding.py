import zlib
from collections import Counter, defaultdict

import pytest

from curvelab.llm import sharding


def check(rows, got, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))


def spread(got):
    by = defaultdict(set)
    for r in got:
        by[r.text_crc32, r.size].add(r.shard)
    return by


@pytest.mark.parametrize("hot", [0, 700])
def test_groups_meet_and_counts_stay_even(spark, make, hot):
    rows = [(i, f"lone {i}") for i in range(1200)] + [(2000 + i, f"group {i % 60}") for i in range(240)] + [(5000 + i, "hot") for i in range(hot)]
    got = sharding.shard(make(rows, extra=True), shards=8).collect()
    check(rows, got, 8)
    by = spread(got)
    small = [by[zlib.crc32(f"group {i}".encode()), len(f"group {i}") + 8] for i in range(60)]
    assert sum(len(s) == 1 for s in small) >= 57
    if hot:
        assert len(by[zlib.crc32(b"hot"), 11]) <= 5  # 700 rows; a shard has 267


def test_everything_linked(spark, make):
    rows = [(i, f"group {i % 10}") for i in range(400)]
    got = sharding.shard(make(rows), shards=4).collect()
    check(rows, got, 4)


def test_odd_rows_and_few_rows(spark, make, odd):
    check(odd, sharding.shard(make(odd, extra=True)).collect(), 24)
    assert sharding.shard(make([])).collect() == []


def test_one_document_repeated(spark, make):
    rows = [(7, "same")] * 300 + [(i, f"t{i}") for i in range(100, 400)]
    check(rows, sharding.shard(make(rows), shards=6).collect(), 6)


def test_quotas():
    assert sharding.quotas(10, 4) == [3, 3, 2, 2] and sum(sharding.quotas(99, 24)) == 99


def test_fewer_links_are_cut_than_by_hashing(spark, make):
    """Copies of a text are together more often than a hash would have them, against a plain count of pairs."""
    import collections
    import random

    rng = random.Random(3)
    rows = [(i, f"text {i}") for i in range(1500)]
    for g in range(120):
        rows += [(10_000 + 100 * g + k, f"copy {g}") for k in range(rng.choice([2, 3, 5, 9, 30]))]
    rows += [(90_000 + k, "hot") for k in range(900)]
    shard = {r.doc_id: r.shard for r in sharding.shard(make(rows)).collect()}
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t].append(shard[d])
    of = lambda s: sum(n * (n - 1) // 2 for n in collections.Counter(s).values())
    small = [s for t, s in groups.items() if len(s) > 1 and t != "hot"]
    kept, pairs = sum(map(of, small)), sum(len(s) * (len(s) - 1) // 2 for s in small)
    assert kept > 0.7 * pairs  # hashing keeps one pair in 24
    largest = sorted(collections.Counter(groups["hot"]).values(), reverse=True)[:7]  # at FILL of a shard each, the hot group needs seven
    assert sum(largest) > 0.85 * 900 and max(collections.Counter(shard.values()).values()) - min(collections.Counter(shard.values()).values()) <= 1
