import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from curvelab.llm import packing


@pytest.fixture(scope="module")
def tok():
    return packing.tokenizer(None)


TEXTS = ["", " ", "a", " a", "a ", "it's  we'll 12a, b.\nC\n\nd \n e\t f", "naïve café x y\u0085z\x1cq", "a\x00b", "x <|endoftext|> y", "don't 'tis 's s", "日本語 テスト。\r\nok", "🎉🎉 a1b2 ___ !!\n", "word\n", "\nword", "a \nb", "a\n b", "a  b", "a   b", "a \n\n b", "a\n\n\nb", "a  ", "a\n\n", "a\t b \tc\t\td", "  a", "\n\na", "x\u3000 y \u2003z"]


def test_ids_are_those_of_the_library(tok):
    rng = random.Random(0)
    some = TEXTS + ["".join(rng.choice(["a", "the", " ", "\n", ".", "'s", "é", "1", "\t", ",", "  "]) for _ in range(60)) for _ in range(300)]
    for t in some:
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == tok.whole.encode(t, add_special_tokens=False).ids, t


def test_caches_forget_without_changing_results():
    import public_tokenizers

    small = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER), most=5)
    text = " ".join(f"w{i % 37} the" for i in range(500))
    assert np.frombuffer(small.ids(text), "<u4").tolist() == small.whole.encode(text, add_special_tokens=False).ids
    assert len(small.parts) <= 5 and len(small.parts.old) <= 5


def plain_ffd(lengths, capacity):
    room, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(capacity)
        out[i] = (b, capacity - room[b])
        room[b] -= lengths[i]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 500])
def test_tournament_tree_is_first_fit_decreasing(n):
    rng = np.random.default_rng(n)
    lengths = rng.integers(1, 1024, n)
    bins, offsets = packing.first_fit_decreasing(lengths)
    assert list(zip(bins.tolist(), offsets.tolist())) == plain_ffd(lengths.tolist(), 1024)


def test_round_trip(spark, make, odd, tok):
    rng = random.Random(2)
    rows = [*odd, *((100 + i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(900)))) for i in range(60))]
    got = packing.pack(make(rows, extra=True), group=16).collect()
    ids = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids[doc_id].append([*tok.whole.encode(text or "", add_special_tokens=False).ids, 0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = {d: sorted((s, len(x[s : s + 1024]), zlib.crc32(np.array(x[s : s + 1024], "<u4").tobytes()), len(x)) for x in xs for s in range(0, len(x), 1024)) for d, xs in ids.items()}
    assert {d: sorted(p) for d, p in by_doc.items()} == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(sum(x[1] for x in p) for p in by_sequence.values()) / (1024 * len(by_sequence)) > 0.7


def test_empty_table(spark, make):
    assert packing.pack(make([])).collect() == []


def test_the_cache_is_bounded_in_bytes():
    made = []
    cache = packing._Cache(lambda k: made.append(k) or k.encode(), 3)
    for key in ("a", "b" * 1000, "a", "b" * 1000, "c", "d", "e"):
        assert cache[key] == key.encode()
    assert made.count("a") == 1 and made.count("b" * 1000) == 2 and all(len(k) <= packing.CACHED_LETTERS for k in [*cache, *cache.old]) and len(cache) <= 3 and len(cache.old) <= 3
