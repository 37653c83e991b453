import random

import numpy as np
import pyarrow as pa
import pytest

from curvelab.llm import passages
from curvelab.llm.components import forest


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_blocks_do_not_depend_on_what_surrounds_a_passage():
    rng = random.Random(0)
    for trial in range(30):
        passage = prose(rng, 51)
        texts = [" ".join(prose(rng, 30) + passage + prose(rng, 30)), " ".join(prose(rng, 7) + passage).replace(" w1", "\nW1"), " ".join(passage)]
        hashes = []
        for batch in (texts, texts[1:]):
            w = passages.Words([t.encode() for t in batch])
            starts, sizes = w.blocks()
            h = passages._sequence_hash(w.hash, starts, sizes)
            hashes.append([{int(x): int(n) for x, n, s in zip(h, sizes, starts) if w.doc[s] == d} for d in range(len(batch))])
        assert hashes[0][1:] == hashes[1]
        a, b, c = hashes[0]
        assert sum(n for x, n in a.items() if x in b) >= passages.RUN_WORDS and sum(n for x, n in a.items() if x in c) >= passages.RUN_WORDS


def test_words_and_places():
    w = passages.Words(["é Ab\tc\n\nd".encode(), None, b"", b" ab C d"])
    assert w.doc.tolist() == [0, 0, 0, 0, 3, 3, 3] and w.start.tolist() == [0, 2, 5, 8, 1, 4, 6] and w.end.tolist() == [1, 4, 6, 9, 3, 5, 7]
    assert w.hash[1] == w.hash[4] and w.hash[2] == w.hash[5] and len(set(w.hash.tolist())) == 4
    assert passages.Words([None, b""]).n == 0


@pytest.mark.parametrize("n", range(1, 6))
def test_batches_of_few_words(n):
    w = passages.Words([b"a B c d e"[: 2 * n - 1], None])
    assert w.n == n and (w.shingle != passages._NONE).sum() == max(0, n - 4)
    assert [x.tolist() for x in w.lines()] == [x.tolist() for x in w.blocks()] == [[0], [n]]


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_jaccard_is_exact_and_bands_recall():
    rng, met, total = random.Random(1), 0, 0
    for _ in range(300):
        a = prose(rng, 60)
        b = list(a)
        b[rng.randrange(60)] = "changed"
        x, y = plain_set(" ".join(a)), plain_set(" ".join(b))
        want = len(x & y) / len(x | y)
        ta, tb = " ".join(a).encode(), " ".join(b).encode()
        assert passages.jaccard(passages.shingle_set(ta), passages.shingle_set(tb)) == pytest.approx(want)
        if want >= 0.8:
            w = passages.Words([ta, tb])
            k = w.minima(*w.lines())
            met, total = met + bool((k[0] == k[1]).any()), total + 1
    assert total > 100 and met / total >= 0.99


@pytest.mark.parametrize("cut", [1, 2, 3, 100])
def test_buckets_across_batches(cut):
    rows = sorted([(1, 5), (1, 5), (2, 7), (2, 8), (2, 8), (2, 9), (3, 1), (4, 4), (4, 4), (4, 6), (5, 2)])
    batches = [pa.record_batch([pa.array([r[0] for r in rows[i : i + cut]], pa.int64()), pa.array([r[1] for r in rows[i : i + cut]], pa.int64())], names=["key", "h"]) for i in range(0, len(rows), cut)]
    got = [tuple(r.values()) for b in passages._buckets(2)(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [(2, 7, 0), (2, 8, 0), (2, 9, 1), (4, 4, 0), (4, 6, 0)]


def corpus():
    rng = random.Random(7)
    base, passage = prose(rng, 60), prose(rng, 55)
    rows = [(i, "\n".join(" ".join(prose(rng, rng.randint(5, 80))) for _ in range(3))) for i in range(40)]  # clean
    for i in range(8):  # lines that differ by a word at an end
        line = list(base)
        line[0 if i % 2 else -1] = f"x{i}"
        rows.append((100 + i, " ".join(line) + "\n" + " ".join(prose(rng, 30))))
    for i in range(6):
        rows.append((200 + i, " ".join(prose(rng, 20) + passage + prose(rng, 20))))
    return rows


@pytest.mark.parametrize("block", [2, 512])
def test_planted_cases(spark, make, block):
    rows = corpus()
    got = passages.repeated(make(rows, extra=True).repartition(3), block=block).collect()
    assert {r.doc_id for r in got} == {*range(100, 108), *range(200, 206)}
    assert {(r.doc_id, r.kept_in, r.removed) for r in got if r.kind == "line"} == {(100 + i, 100, i > 0) for i in range(8)}
    text = dict(rows)
    spans = [r for r in got if r.kind == "passage" and r.doc_id >= 200]
    # where its surroundings cut a passage's ends differs by document, and so may the parts that two of them share
    passage = " ".join(text[200].split()[20:75])
    assert {r.doc_id for r in spans if r.removed and r.kept_in == 200} == set(range(201, 206)) and not any(r.removed for r in spans if r.doc_id == 200)
    assert all(text[r.doc_id][r.s : r.e] in passage and r.words == len(text[r.doc_id][r.s : r.e].split()) for r in spans)


def test_similar_lines_against_all_pairs(spark, make):
    rng = random.Random(9)
    lines = []
    for _ in range(5):
        base = prose(rng, 70)
        for _ in range(12):
            line = list(base)
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(70)] = f"y{rng.randrange(99)}"
            lines.append(" ".join(line))
    lines = sorted(set(lines))
    w = passages.Words([x.encode() for x in lines])
    h = w.line_hash(*w.lines()).tolist()
    want = forest((h[i], h[j]) for i in range(len(lines)) for j in range(i) if len(plain_set(lines[i]) & plain_set(lines[j])) >= 0.8 * len(plain_set(lines[i]) | plain_set(lines[j])))
    edges = passages.similar_lines(make(list(enumerate(lines))), block=4).collect()
    assert forest((e.a, e.b) for e in edges) == want


def test_odd_rows_and_empty_table(spark, make, odd):
    got = passages.repeated(make([*odd, (7, "word " * 20_000)], extra=True)).collect()
    assert {r.doc_id for r in got} <= {7}
    assert passages.repeated(make([])).collect() == []


def test_passages_are_found_whole(spark, make):
    """From RUN_WORDS + WINDOW - 1 words on all of them, to their true ends."""
    rng, rows, want = random.Random(3), [], {}
    for i in range(150):
        passage = prose(rng, rng.randint(31, 120))
        for d, cut in ((2 * i, "\n"), (2 * i + 1, " ")):
            before, after = ([f"{x}{d}" for x in prose(rng, rng.randint(0, 40))] for _ in range(2))
            rows.append((d, " ".join(before + passage[:9]) + cut + " ".join(passage[9:] + after)))
            s = len(" ".join(before)) + bool(before)
            want[d] = (s, s + len(" ".join(passage)), len(passage), 2 * i, d % 2 == 1)
    got = [r for r in passages.repeated(make(rows).repartition(3)).collect() if r.kind == "passage"]
    assert len(got) == len(want) and {r.doc_id: (r.s, r.e, r.words, r.kept_in, r.removed) for r in got} == want


def test_places_of_seeds_and_short_documents():
    rng = random.Random(4)
    for n in (1, 11, 12, 13, 31, 32, 400):
        words = prose(rng, n)
        alone, w = (passages.Words([t.encode() for t in texts]) for texts in ([" ".join(words)], ["x " * 40, " ".join(words), "", "y"]))
        at, h, sizes, _ = w.seeds()
        mine = w.doc[at] == 1
        assert w.in_document(at)[mine].tolist() == alone.seeds()[0].tolist() and h[mine].tolist() == alone.seeds()[1].tolist()
        at = alone.seeds()[0]
        assert len(at) == 0 if n < 12 else at[0] < 20 and n - at[-1] <= 31 and (np.diff(at) <= 20).all()
    assert len(passages.Words([b"loop de loop " * 90]).seeds()[0]) <= 3


def test_abutting_passages_have_a_keeper_each(spark, make):
    rng = random.Random(6)
    p, q, other = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(3, p), (5, q), (9, p + q), (10, other), (11, p[:40] + ["z"] + other), (12, q + p + other), (13, p[10:] + q[:50])]
    rows = [(d, " ".join([*prose(rng, 15), f"a{d}", *words, f"b{d}", *prose(rng, 15)])) for d, words in rows]
    got = [r for r in passages.repeated(make(rows)).collect() if r.kind == "passage"]
    assert {(r.doc_id, r.kept_in, r.words) for r in got if r.removed and r.kept_in != 9} == {(9, 3, 60), (9, 5, 60), (11, 3, 40), (11, 10, 60), (12, 3, 60), (12, 5, 60), (12, 10, 60), (13, 3, 50), (13, 5, 50)}
    for keeper in (3, 5, 10):
        assert len({r.cluster for r in got if r.kept_in == keeper}) == 1 and [r.doc_id for r in got if r.kept_in == keeper and not r.removed] == [keeper]
    assert len({r.cluster for r in got if r.kept_in in (3, 5, 10)}) == 3


def test_short_equal_lines(spark, make):
    rng = random.Random(8)
    rows = [(i, "\n".join([" ".join(prose(rng, 8)), "all of five words here", " ".join(prose(rng, 9)), "only four words here"])) for i in (4, 6, 9)]
    got = passages.repeated(make(rows)).collect()
    assert sorted((r.doc_id, r.kind, dict(rows)[r.doc_id][r.s : r.e], r.words, r.kept_in, r.removed) for r in got) == [(i, "line", "all of five words here", 5, 4, i > 4) for i in (4, 6, 9)]
    assert len({r.cluster for r in got}) == 1


def test_short_similar_lines(spark, make):
    """Lines under PARAGRAPH words go through the bands too."""
    rng = random.Random(10)
    base = prose(rng, 18)
    rows = [(i, "\n".join([" ".join(prose(rng, 9)), " ".join([*base[:-1], f"end{i}"]), " ".join(prose(rng, 12))])) for i in (2, 5, 8)]
    got = passages.repeated(make(rows)).collect()
    assert sorted((r.doc_id, r.kind, r.words, r.kept_in, r.removed) for r in got) == [(i, "line", 18, 2, i > 2) for i in (2, 5, 8)] and len({r.cluster for r in got}) == 1
    assert passages.repeated(make(rows), least=passages.PARAGRAPH).collect() == []


def test_passages_with_edits_are_whole(spark, make):
    """A word replaced, put in or left out does not end a passage while its Jaccard similarity is 0.8 or more."""
    rng, rows, want = random.Random(12), [], {}
    for i, edit in enumerate((lambda w: [*w[:35], "changed", *w[36:]], lambda w: [*w[:35], "put", *w[35:]], lambda w: [*w[:35], *w[36:]], lambda w: [*w[:20], "a", *w[21:40], "b", *w[41:60], "c", *w[61:]])):
        passage = prose(rng, 80)
        rows += [(10 * i + k, " ".join([*prose(rng, 25), f"x{k}", *words, f"y{k}", *prose(rng, 25)])) for k, words in enumerate((passage, edit(passage)))]
        want[10 * i + 1] = len(edit(passage))
    got = {r.doc_id: (r.words, r.kept_in) for r in passages.repeated(make(rows)).collect() if r.removed and r.kind == "passage"}
    assert got == {d: (n, d - 1) for d, n in want.items() if d != 31}  # three edits in 80 words are under 0.8, and no part has 31 words


def test_equal_texts_are_one(spark, make):
    rng = random.Random(13)
    a, b = " ".join(prose(rng, 70)), " ".join(prose(rng, 50))
    rows = [(4, a), (2, a), (9, " ".join([b, "z", *prose(rng, 20)])), (7, b), (None, a), (8, b), (8, b), (6, "too short"), (3, "too short")]
    got = passages.repeated(make(rows, extra=True), least=passages.PARAGRAPH).collect()
    key = lambda r: (str(r), )
    assert sorted([(r.doc_id, r.s, r.e, r.words, r.kept_in, r.removed) for r in got if r.kind == "text"], key=key) == sorted(
        [(d, 0, len(a), 70, 2, d != 2) for d in (2, 4, None)] + [(d, 0, len(b), 50, 7, d != 7) for d in (7, 8, 8)], key=key
    )
    assert {(r.doc_id, r.words, r.kept_in, r.removed) for r in got if r.kind == "passage"} == {(9, 50, 7, True), (7, 50, 7, False)}


def test_blocks_of_a_hot_bucket(spark):
    """Many different lines with one stock passage meet in a bucket; few are similar."""
    rng = random.Random(14)
    stock, lines = prose(rng, 30), []
    for i in range(60):
        line = prose(rng, 10) + stock + prose(rng, 10)
        lines += [line, [*line[:-1], "end"]] if i % 3 == 0 else [line]
    sets = [passages.shingle_set(" ".join(x).encode()).view(np.int64) for x in lines]
    plain = [plain_set(" ".join(x)) for x in lines]
    want = forest((i, j) for i in range(len(lines)) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]))
    for cut in (len(lines), 17):
        edges = []
        for i in range(0, len(lines), cut):
            for j in range(i, len(lines), cut):
                members = [(k, 0 if k < i + cut else 1) for k in range(len(lines)) if i <= k < i + cut or j <= k < j + cut]
                rows = [{"key": 1, "i": i // cut, "j": j // cut, "side": s, "h": k, "w": sets[k].tolist()} for k, s in members]
                batches = [pa.RecordBatch.from_pylist(rows[k : k + 30]) for k in range(0, len(rows), 30)]
                edges += [tuple(r.values()) for b in passages._compare(iter(batches)) for r in b.to_pylist()]
        assert forest(edges) == want and len(want) == 40
