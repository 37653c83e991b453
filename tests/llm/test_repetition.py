import random
import re

import pytest

from curvelab.llm import repetition


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, dup_chars = text.split("\n"), 0, 0
    for i, line in enumerate(lines):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        if w and line in lines[:i]:
            dup += 1
            dup_chars += sum(map(len, w))

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        return {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + n)}

    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside(3)), dup_chars, *(sum(len(words[k]) for k in inside(n)) for n in repetition.NGRAM_LIMITS)]


def texts():
    rng = random.Random(3)
    out = [None, "", "\n \n", "a", "a b", "a b c", "a b c a b c", "x " * 300, "é ü é ü é ü\né ü é ü\n\né ü é ü", "#a|b <c>\x0b$ a\x1cb"]
    for k in (2, 3, 6, 50):
        out.append(" ".join(rng.choice([f"w{i}é" if i % 3 else f"w{i}" for i in range(k)]) + rng.choice(["", "\n", "\n\n", "\t"]) for _ in range(200)))
    return out


@pytest.mark.parametrize("text", texts())
def test_measures_against_brute_force(text):
    assert repetition.measure(None if text is None else text.encode()) == plain(text)


def test_query_columns_and_filter(spark, make, odd):
    rng = random.Random(5)
    clean, looped = " ".join(f"w{rng.randrange(5000)}" for _ in range(300)), "one two three four five six seven eight nine ten eleven twelve " * 5 + " ".join(f"v{rng.randrange(5000)}" for _ in range(120))
    rows = [*odd, (50, clean), (51, looped), (52, "same line of words here\n" * 30 + clean)]
    got = {r.doc_id: r for r in repetition.coverage(make(rows, extra=True)).collect()}
    for doc_id, text, *_ in rows:
        m = plain(text) if doc_id != 7 else None
        r = got[doc_id]
        if m:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == m[:5]
            assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
    assert got[50].kept and not got[51].kept and not got[51].base_failed and not got[7].kept
    docs = make(rows, extra=True)
    kept = repetition.passing(docs)
    assert kept.schema == docs.schema and [r.doc_id for r in kept.collect()] == [50]
    assert repetition.coverage(make([])).collect() == []
