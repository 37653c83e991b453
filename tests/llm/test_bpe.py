"""Byte-level BPE by distinct words, against the public library for whole texts."""

import hashlib
import random

import pytest

from curvelab.llm import bpe


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(), special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.ranks_of())


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin shr", "é漢x😀", " ", "=-", "0123456789"])
def test_words_of_any_length(merges, library, letters):
    pick = random.Random(letters)
    for n in (1, 2, 3, 7, 50, 199, 200, 201, 900, 5000):
        word = "".join(pick.choice(letters) for _ in range(n)).encode()
        assert merges.ids(word) == library._encode_single_piece(word)


def test_list_and_heap_agree(merges):
    pick = random.Random(2)
    for n in range(1, 120):
        parts = [merges.single[b] for b in bytes(pick.choice(b"abcdeinrst ,") for _ in range(n))]
        assert merges._by_list(list(parts)) == merges._by_heap(list(parts))


def test_every_character_is_cut_as_the_library_cuts_it(merges, library):
    import public_tokenizers
    import regex

    match = regex.compile(public_tokenizers.PATTERN)
    for c in [*range(0x3100), 0x3000, 0xFEFF, 0x1D7D8, 0x1F600, 0x2F800, 0xE0001]:
        text = f"a{chr(c)}a 1{chr(c)}1 ,{chr(c)}, \t{chr(c)}x{chr(c)}{chr(c)} '{chr(c)}s"
        assert [i for w in match.findall(text) for i in merges.ids(w.encode())] == library.encode_ordinary(text), hex(c)


def wanted(library, rows):
    out = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_round_trip_of_odd_texts(spark, make, odd, library):
    rows = [*odd, (20, "don't  we'll\r\n\r\n  x   \t"), (21, "   "), (22, "a" * 3000), (23, "漢字かな交じり文 123456 ½²"), (24, "same word " * 3)]
    got = bpe.round_trip(make(rows, extra=True))
    assert sorted(map(tuple, got.collect()), key=repr) == wanted(library, rows)


@pytest.mark.parametrize("chunk", [1, 300, 100_000])
def test_chunks_of_any_size(spark, make, library, chunk):
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(0, 120)))) for i in range(60)]
    ids = bpe.encode(make(rows).repartition(3), chunk=chunk)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode_ordinary(t) for i, t in rows}


def test_more_words_than_two_bytes_number(spark, make, library):
    text = " ".join(f"w{i}" for i in range(70_000))
    assert bpe.encode(make([(1, text), (2, "w5 w69999")])).where("doc_id = 1").first().ids == library.encode_ordinary(text)


def test_only_documents_without_words(spark, make):
    got = bpe.round_trip(make([(1, None), (2, "")])).collect()
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sorted(got)] == [(i, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()) for i in (1, 2)]


def test_empty_table(spark, make):
    assert bpe.round_trip(make([])).collect() == []


def test_decode_any_ids(spark):
    """Ids that no text gives, bytes that are no text, ids without a token, null ids; over more ids than an Arrow batch holds."""
    ranks = bpe.ranks_of()
    by = {r: t for t, r in ranks.items()}
    pick = random.Random(4)
    rows = [(i, [pick.choice(list(by)) for _ in range(pick.choice([0, 1, 5, 25_000]))]) for i in range(12)] + [(100, [1, 10**6, 2]), (101, None)]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2), bpe.token_table(spark))
    found = {r.doc_id: r.bytes for r in got.collect()}
    assert found[100] is None and found[101] == b""
    assert all(bytes(found[i]) == b"".join(by[t] for t in ids) for i, ids in rows[:12])


def test_documents_are_not_shuffled(spark, make):
    """Only distinct words and their ids go through exchanges; tokens are joined by broadcast."""
    plan = bpe.decode(bpe.encode(make([(1, "a b")])), bpe.token_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("BroadcastHashJoin") == 1 and "Bucketed: true" in plan


def test_text_of_many_words_streams(spark, make, library):
    text = "lorem ipsum dolor sit amet " * 60_000  # 1.6 MB, over a tenth of a chunk
    got = bpe.round_trip(make([(1, text)])).collect()
    assert [tuple(r) for r in got] == wanted(library, [(1, text)])
