import hashlib
import random
import re
import sys

import pytest

from curvelab.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    out = []
    for n, (kind, p) in enumerate(PLAIN.items()):
        out += [(m.start(), n, m.end()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return sorted(out)


def texts():
    rng = random.Random(0)
    bits = ["a@b.c", "a@b.c_d@e.f", "x@y@z.com", ".@d.e", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.0.00.1", "4111 1111 1111 1111", "4111111111111112", "4012-8888-8888-1881", "+1 (974) 555-3436", "+49 30 123456", "++1 23 ", "é", "日本", "🎉", "\x01", "\x02", " ", "\n", "-", "word", "9", "12", "%", "+", "(", "x" * 30, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    out = [None, "", " "]
    return out + ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(250)]


def test_base_spans_against_plain_regexes(spark, make):
    sys.setrecursionlimit(10_000)
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in pii.find(make(rows, extra=True)).collect()}
    for i, t in rows:
        spans = plain(t)
        text = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, got[i].spans, text)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert set(filter(None, text.split(","))) <= set(filter(None, got[i].spans.split(",")))


def test_long_texts(spark, make):
    many, digits, word = "ip 1.2.3.4 and a@b.co " * 3000, "1 " * 60_000, "a." * 60_000 + "@"
    got = {r.doc_id: r for r in pii.find(make([(1, many), (2, digits), (3, word), (4, "a@b" + ".c" * 60_000)])).collect()}
    assert (got[1].n_ip, got[1].n_email) == (3000, 3000)
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in plain(many)).encode()).hexdigest()
    assert got[2].n_card == 0 and got[3].n_email == 0 and got[4].n_email == 1


def secrets(n):
    rng = random.Random(n)
    return ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)]


def test_weak_supervision_adds_secrets_and_not_words(spark, make):
    rows = [(i, f'so the token = "{s}" of it') for i, s in enumerate(secrets(60))] + [(100 + i, f"the {'un' * i}{'interest' * 4}ingness of antidisestablishmentarianism{'s' * i}") for i in range(60)]
    got = {r.doc_id: r for r in pii.find(make(rows)).collect()}
    assert all(got[i].spans == "secret:16:56" for i in range(60))
    assert all(got[100 + i].spans == "" for i in range(60))


def test_estimates_recover_reliabilities():
    rng = random.Random(4)
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.3
        v = "".join((("+" if y else "-") if rng.random() < acc else ("-" if y else "+")) if rng.random() < 0.9 else "0" for acc in (0.95, 0.9, 0.8, 0.6))
        counts[0, v] = counts.get((0, v), 0) + 1
        truth[v] = truth.get(v, 0) + y
    post = pii.reliabilities(counts)
    error = sum(n * abs(post[k] - truth[k[1]] / n) for k, n in counts.items()) / 20_000
    assert error < 0.03


def test_redaction(spark, make, odd):
    s = secrets(40)
    rows = [*odd, (30, "é a@b.co, +1 (974) 555-3436."), *((50 + i, f'token = "{x}"!') for i, x in enumerate(s))]
    docs = make(rows, extra=True)
    out = pii.redact(docs)
    assert out.schema.names == docs.schema.names
    got = {r.doc_id: r for r in out.collect()}
    assert got[30].text == "é <EMAIL>, <PHONE>." and got[30].n_chars == len(got[30].text)
    assert all(got[50 + i].text == 'token = "<SECRET>"!' for i in range(40))
    for doc_id, text, *_ in odd:
        assert got[doc_id].text == text


def test_empty_table(spark, make):
    assert pii.find(make([])).collect() == []
    assert pii.redact(make([])).collect() == []


@pytest.mark.parametrize("d", ["4111111111111111", "4111111111111112", "0" * 12, "79927398713"])
def test_luhn(spark, d):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(d)).alias("x")).first().x == luhn(d)
