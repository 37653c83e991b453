"""Language identification and the line field: held-out accuracy and defined results."""

import zlib

import numpy as np
import pytest

from curvelab.llm import langid, linecrf

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_languages_of_held_out_documents(spark, docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert np.mean(held) >= 0.97


def test_languages_of_odd_rows(spark, make, odd):
    rows = [*odd, *((100 + i, "the quick brown fox", "en") for i in range(9)), *((200 + i, "der schnelle braune fuchs", "de") for i in range(9)), (300, "12 34 !!"), (301, "𝒳 жук 字")]
    got = {r.doc_id: r for r in langid.identify(make(rows, extra=True)).collect()}
    for d in (1, 2, 3, 8, 300):
        assert got[d].lang_pred == "und" and got[d].score == 0
    assert got[None].held_out and got[301].lang_pred in ("en", "de")
    assert langid.identify(make([])).collect() == []
    assert {r.lang_pred for r in langid.identify(make([(1, "abc", None), (2, "abc", None)])).collect()} == {"und"}


def test_vectors_are_the_stated_bundles():
    text = "Ab, ça!"
    x = langid.letters(text)
    base = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.ALPHABET, langid.SIZE))
    v = sum(np.roll(base[a], 2).astype(int) * np.roll(base[b], 1) * base[c] for a, b, c in zip(x, x[1:], x[2:]))
    assert np.allclose(langid.vectors([None, text, ""])[1], v / np.linalg.norm(v), atol=1e-6)
    assert x.tolist() == [0, 1, 2, 0, x[4], 1, 0] and x[4] > 26


def test_chunks_do_not_change_vectors(monkeypatch):
    texts = ["one two three " * k for k in range(40)]
    whole = langid.vectors(texts)
    monkeypatch.setattr(langid, "CHUNK", 50)
    assert np.allclose(langid.vectors(texts), whole, atol=1e-6)


def brute_marginals(e, trans, first):
    from itertools import product

    total, good = 0.0, np.zeros(len(e))
    for y in product((0, 1), repeat=len(e)):
        w = np.exp(first * y[0] + sum(e[t] * y[t] for t in range(len(e))) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals_and_transitions_against_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([1, 5, 3, 1, 7, 2])
    e, trans = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    field = linecrf.Field(np.zeros(1), trans, 0.3)
    got, expected, first, n = linecrf.marginals(e, lines, field, pairs=True)
    at = np.concatenate(([0], np.cumsum(lines)))
    want = np.concatenate([brute_marginals(e[a:b], trans, 0.3) for a, b in zip(at, at[1:])])
    assert np.allclose(got, want) and n == 6 and np.isclose(first, want[at[:-1]].sum())
    assert np.isclose(expected.sum(), (lines - 1).sum()) and np.isclose(expected[:, 1].sum(), want.sum() - want[at[:-1]].sum())


def test_measures_do_not_depend_on_what_else_is_measured():
    texts = [b"", None, b"one two two two\n\n#$%", "é ü\né ü\nZ!".encode(), b"x" * 300 + b"\nline"]
    x, sizes, lines = linecrf.measure(texts)
    alone = [linecrf.measure([t]) for t in texts]
    assert np.allclose(x, np.concatenate([a[0] for a in alone])) and lines.tolist() == [1, 1, 3, 3, 2]
    assert sizes.tolist() == np.concatenate([a[1] for a in alone]).tolist()


def test_quality_of_held_out_documents(spark, docs, labels):
    got = {r.doc_id: r for r in linecrf.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_of_odd_rows(spark, make, odd):
    rows = [*odd, *((100 + i, "A fine line of text.\nAnd one more of them.") for i in range(40)), *((200 + i, "###$$$ %%%\n#$#$ ***") for i in range(40))]
    labels = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(40)] + [(None, 1), (1, None), (5, 1), (5, 0), (999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in linecrf.score(make(rows, extra=True), labels).collect()}
    assert set(got) == {r[0] for r in rows}
    assert all(got[100 + i].predicted == 1 and got[200 + i].predicted == 0 for i in range(40))
    assert {r.score for r in linecrf.score(make(rows), labels.where("quality = 1")).collect()} == {0.5}
    assert linecrf.score(make([]), labels).collect() == []


def test_letters_of_their_own():
    for first, last in ((0x430, 0x450), (0x3B1, 0x3CA), (0x5D0, 0x5EB), (0xE0, 0x100)):
        own = [langid.letters(chr(c))[1] for c in range(first, last) if chr(c).isalpha()]
        assert len(set(own)) == len(own) and min(own) > 26
    assert len({int(langid.letters(chr(c))[1]) for c in range(0x4E00, 0x9FFF)}) > 5000


def test_too_many_languages_are_refused(spark, make, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        langid.identify(make([(i, "abc def", f"l{i % 4}") for i in range(30)]))


def plain_profile(text):
    """A text's bundle, letter by letter."""
    rng = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.ALPHABET, langid.SIZE))
    x = langid.letters(text or "").tolist()
    v = np.zeros(langid.SIZE)
    if any(x):
        for a, b, c in zip(x, x[1:], x[2:]):
            v += np.roll(rng[a], 2).astype(float) * np.roll(rng[b], 1) * rng[c]
    n = np.linalg.norm(v)
    return v / n if n else v


def test_languages_against_brute_force(spark, make):
    """The whole query, with every learned text in the sample."""
    words = {"xx": "alba cordu melon tari ves", "yy": "krot zemlja polje ruka voda", "zz": "жук лето вода рука поле"}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 6)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 12)] + [(900, "12 !", None), (901, "alba voda", None), (902, None, "xx")]
    learned = {lang: sum(plain_profile(t) for d, t, x in rows if x == lang and zlib.crc32(str(d).encode()) % 5) for lang in words}
    names, table = sorted(learned), np.stack([learned[x] / np.linalg.norm(learned[x]) for x in sorted(learned)])
    for r in langid.identify(make(rows)).collect():
        text = next(t for d, t, _ in rows if d == r.doc_id)
        cos = table @ plain_profile(text)
        soft = np.exp(langid.SHARP * (cos - cos.max()))
        want = (names[cos.argmax()], 1 / soft.sum()) if any(c.isalpha() for c in text or "") else ("und", 0.0)
        assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=1e-4)


QUALITY_ROWS = [*((i, f"A fine line number {i}.\nAnd one more of them here.\nIt ends.") for i in range(60)), *((100 + i, f"###$$$ %%% {i}\n#$#$ ***\n| | |") for i in range(60)), (300, ""), (301, "A fine line.\n#$%\n\nAnd more.")]


def test_quality_against_brute_force(spark, make):
    """The whole query: chains are enumerated instead of passed through."""
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)], "doc_id long, quality int")
    docs = make(QUALITY_ROWS)
    field = linecrf.learn(docs, labels)
    for r in linecrf.score(docs, labels).collect():
        x, sizes, lines = linecrf.measure([dict(QUALITY_ROWS)[r.doc_id].encode()])
        marg = brute_marginals(x @ field.w.astype(np.float32), field.trans, field.first)
        mean = np.clip((marg * (sizes + 1)).sum() / (sizes + 1).sum(), 1e-6, 1 - 1e-6)
        assert lines.sum() == r.lines and r.score == pytest.approx(1 / (1 + np.exp(-(field.slope * np.log(mean / (1 - mean)) + field.shift))), abs=1e-5)


def test_long_documents_are_learned_from(spark, make, monkeypatch):
    """Bad documents are all longer than any limit on bytes that a sample might have had."""
    monkeypatch.setattr(linecrf, "SAMPLE_LINES", 20)
    rows = [*((i, "A fine line of text.\nAnd one more of them.") for i in range(30)), *((100 + i, "###$$$ %%% #$#$ ***\n" * 4000) for i in range(10))]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(10)], "doc_id long, quality int")
    got = {r.doc_id: r for r in linecrf.score(make(rows), labels).collect()}
    assert all(got[d].predicted == (d < 100) for d, _ in rows)


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_pieces_of_chains_give_the_same_marginals(piece):
    rng = np.random.default_rng(3)
    lines = np.array([1, 9, 3, 1, 20, 2, 7, 6])
    e, field = rng.normal(size=lines.sum()) * 3, linecrf.Field(np.zeros(1), rng.normal(size=(2, 2)), 0.4)
    assert np.allclose(linecrf.marginals(e, lines, field, piece=piece)[0], linecrf.marginals(e, lines, field, pairs=True)[0])


LONG = [b"\n".join(b"line %d of text, and more!" % (k % 37) if k % 5 else b"" for k in range(400)), b"\n" * 70, b"x" * 500 + b"\n\nshort\n" + b"y " * 90, b"one line only " * 20]


@pytest.mark.parametrize("text", LONG)
@pytest.mark.parametrize("chunk", [1, 60, 1000])
def test_long_texts_have_the_evidence_of_short_ones(monkeypatch, text, chunk):
    w = np.random.default_rng(4).normal(size=linecrf.FEATURES)
    x, sizes, _ = linecrf.measure([text])
    monkeypatch.setattr(linecrf, "CHUNK", chunk)
    monkeypatch.setattr(linecrf, "SAMPLE_LINES", 30)
    assert b"\n".join(linecrf.windows(text)) == text
    e, n = linecrf.evidence_of(text, w)
    assert np.allclose(e, x @ w, atol=1e-4) and n.tolist() == sizes.tolist()
    for h in (0, 1, 17, 12345):
        at = h % max(1, len(x) - 29)
        part, n = linecrf.stretch(text, h)
        assert np.array_equal(part[:, linecrf.AGAIN], x[at : at + 30, linecrf.AGAIN]) and n.tolist() == sizes[at : at + 30].tolist()
        assert np.allclose(part, x[at : at + 30])


def test_a_million_lines(spark, make):
    rows = [*QUALITY_ROWS, (500, "\n" * 1_200_000), (501, "A fine line of text.\n" * 600_000)]
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r for r in linecrf.score(make(rows), labels).collect()}
    assert got[500].lines == 1_200_001 and got[501].lines == 600_001 and all(0 <= r.score <= 1 for r in got.values())
