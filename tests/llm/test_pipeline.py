"""The whole pipeline on a small fixture, against a brute-force version of every stage."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from curvelab.llm import packing, repetition
from curvelab.llm.queries import MIX_WEIGHTS
from tests.llm.test_mixing import plain_count
from tests.llm.test_neardup import plain_classes
from tests.llm.test_pii import PLAIN, plain as plain_spans
from tests.llm.test_repetition import plain as plain_measures


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(rng.randint(60, 400)))
        if i % 7 == 0:
            text += " write to me.too@mail.example.org or +49 (30) 1234567, 10.0.0.7"
        rows.append((i, text, "en", f"src{i % 4}"))
        if i % 5 == 0:  # an exact and a near copy
            rows.append((1000 + i, text, "en", "src1"))
            rows.append((2000 + i, text.replace(text.split()[30], "zz", 1), "en", "src2"))
    rows += [(500, "loop de loop " * 80, "en", "src0"), (501, "too short", "en", "src0"), (502, None, "en", "src0"), (503, rows[0][1], None, None)]
    return rows


def redacted(text):
    out, at = [], 0
    for s, k, e in plain_spans(text):
        if s >= at:
            out += [text[at:s], f"<{list(PLAIN)[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def brute(rows):
    kept = []
    for r in rows:
        m = plain_measures(r[1])
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        if not failed and m[5] <= repetition.LINE_LIMIT * m[1] and all(c <= limit * m[1] for c, limit in zip(m[6:], repetition.NGRAM_LIMITS.values())):
            kept.append(r)
    kept.sort(key=lambda r: r[0])
    names = plain_classes([r[1] for r in kept])
    kept = [r for i, (r, c) in enumerate(zip(kept, names)) if i == c]
    kept = [(r[0], redacted(r[1]), *r[2:]) for r in kept]
    chars = Counter()
    for r in kept:
        chars[r[3]] += len(r[1])
    have = {s: chars[s] for s in MIX_WEIGHTS if chars[s]}
    total, weight = sum(have.values()), sum(MIX_WEIGHTS[s] for s in have)
    out = Counter()
    for r in kept:
        rate = MIX_WEIGHTS[r[3]] / weight * total * 1.0 / have[r[3]] if r[3] in have else 1.0
        out[r[0], r[1]] += plain_count(r[0], rate)
    return out


def test_run_against_brute_force(spark, make, tmp_path):
    rows = corpus()
    make(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(rows)
    tok = packing.tokenizer(None).whole
    pieces, sequences = Counter(), defaultdict(list)
    for (doc_id, text), n in want.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            pieces[doc_id, s, len(ids[s : s + 1024]), len(ids)] += n
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in got) == +pieces
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() == [o for o, _ in sorted(p)] and sum(n for _, n in p) <= 1024 for p in sequences.values())


def test_stages_keep_the_columns(spark, make, tmp_path):
    docs = make(corpus())
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{len(sizes)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(sizes)}")
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert any("<EMAIL>" in r.text for r in docs.select("text").collect()) and not any(re.search(r"\S@\S", r.text) for r in docs.select("text").collect())


def test_empty_table(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
