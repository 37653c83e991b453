"""Verified near copies of whole texts, against comparing all pairs."""

import random
import re
from itertools import combinations

import pytest

from curvelab.llm import neardup


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def plain_classes(texts):
    """The component of each text over pairs of equal words or a five-word Jaccard similarity of 0.8 or more."""
    words = [words_of(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if words[i] == words[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * union):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))]


def corpus(seed=21):
    """Texts, near copies at every distance around the limit, chains of them, exact copies, and odd ones."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randint(3, 6)))
    rows, doc_id = [], 0
    for k in range(40):
        text = [word() for _ in range(pick.choice([6, 40, 120, 400]))]
        for changes in range(6):
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
            for _ in range(max(1, len(text) * (k % 7) // 200)):
                text[pick.randrange(len(text))] = word()  # each is a copy of the one before
    rows += [(doc_id + i, t) for i, t in enumerate([rows[3][1], rows[3][1].upper().replace(" ", "\n\t"), None, "", " \n", "a b c", "A  b\nc", "a b d", "x " * 9, "x " * 12])]
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_kept_rows_are_those_of_all_pairs(spark, make, block):
    rows = corpus()
    got = {r.doc_id for r in neardup.keep_one(make(rows, extra=True).repartition(4), block).collect()}
    names = plain_classes([t for _, t in rows])
    want = {rows[i][0] for i, c in enumerate(names) if i == c}
    missed = want ^ got
    assert not missed and len(want) < len(rows) - 80


def test_what_is_less_alike_stays(spark, make):
    """Texts within SimHash's bits but below the limit are no copies; those at the limit are, however many bits they differ by."""
    pick = random.Random(5)
    words = [f"w{pick.randrange(10**6)}" for _ in range(200)]
    near = words[:]
    near[60] = near[130] = "other"  # 10 of 196 shingles: 0.9
    far = words[:]
    for i in range(5, 200, 18):
        far[i] = "other"  # 55 of 196 shingles: under 0.6
    got = {r.doc_id for r in neardup.keep_one(make([(3, " ".join(words)), (4, " ".join(near)), (5, " ".join(far))])).collect()}
    assert got == {3, 5}


def test_rows_that_share_an_id_or_have_none(spark, make):
    long = "one two three four five six seven eight"
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, long), (2, long), (None, long), (None, "nobody else says this at all"), (None, "nobody else says this at all"), (7, "short"), (7, "short")]
    got = sorted(((r.doc_id, r.text) for r in neardup.keep_one(make(rows)).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (1, long), (None, rows[4][1]), (7, "short")], key=str)


def test_odd_rows_and_empty_table(spark, make, odd):
    rows = neardup.keep_one(make(odd, extra=True)).collect()
    names = plain_classes([r[1] for r in odd])
    assert len(rows) == len(set(names)) and neardup.keep_one(make([])).collect() == []
