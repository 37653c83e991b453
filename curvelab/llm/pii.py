"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four fixed patterns. Further candidates come from loose
patterns; on each, labelers vote for, against or not at all: a strict regex, a
gazetteer (endings of mail domains, card issuers, prefixes of keys), the words
before the candidate, and its surroundings. Expectation-maximisation estimates
from the counts of all vote patterns in the corpus how reliable each labeler
is; the posteriors it gives are the soft labels of a final span classifier (a
naive Bayes model over votes and shapes), whose accepted candidates are the
spans that the method adds.

The corpus is reduced to a table of counts by (kind, votes, shape), whose size
the number of patterns bounds; only that table comes to the driver.

Positions are code points. They are found without user functions: matches are
set off by a control character, the text is split there, and lengths are summed.
That character stands for itself nowhere: it is replaced in the text first, by
another that no pattern accepts.

Defined results: an empty table gives no rows, and columns beside doc_id and text are kept by redaction and not read; null is the empty text and has no spans; repeated rows are
treated alike; without any candidate nothing is added; a very long text is
summed in blocks of parts.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import stored, unique_names

MARK, STAND_IN = "\x01", "\x02"
#: The base patterns. Quantifiers are possessive and starts anchored where the
#: match is the same, so that matching is linear and needs no deep stack.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINT = {"email": "@", "phone": "+"}
KINDS = [*BASE, "secret", "mail", "number"]
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
    "mail": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)\x20?)?[0-9]++(?:[\x20.-][0-9]++)++(?![0-9A-Za-z])",
}
#: Words before a candidate that speak for it, by kind.
CONTEXT = {
    "secret": r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|bearer|credential|auth)\w{0,12}[\"']?\x20?[=:]?\x20?[\"']?$",
    "mail": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)\w{0,8}\W{0,6}(?:me|us|to|at|an|a)?\W{0,3}$",
    "number": r"(?i)(?:phone|tel|call|fax|mobile|cell|ssn|social|passport|account|iban|ausweis|konto|tel[ée]fono|t[ée]l)\w{0,8}[^\w\n]{0,4}(?:no|nr|is|number)?[^\w\n]{0,4}$",
}
STRICT = {
    "secret": r"^(?=[^0-9]*[0-9])(?=[^a-zA-Z]*[a-zA-Z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32,64}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{24,})$",
    "mail": r"(?i)(?:\.|dot[\])])\x20?[a-z]{2,24}$",
    "number": r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4})$",
}
GAZETTEER = {
    "secret": r"^(?:ghp_|gho_|github_pat_|sk-|pk_|AKIA|ASIA|xox[abp]-|eyJ|AIza|glpat-)",
    "mail": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "number": r"^\(?(?:20[1-9]|21[0-9]|30[1-9]|31[0-9]|40[1-9]|41[0-9]|50[1-9]|51[0-9]|60[1-9]|61[0-9]|70[1-9]|80[0-9]|81[0-9]|90[1-9]|91[0-9])\)?[ .-]",
}
#: What speaks against a candidate.
AGAINST = {
    "secret": r"^(?:[A-Za-z/_-]+|[0-9/_+-]+|(.)\1+)$",
    "mail": r"(?i)^(?:noreply|example|user|name)\b",
    "number": r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)?[0-9]{2}|[0-9]+\.[0-9]+|[0-9]{1,3}(?:[ .][0-9]{3})+|(?:19|20)[0-9]{2}-(?:19|20)?[0-9]{2})$",
}
LABELERS = 4
#: Characters before a candidate that labelers see, and parts that are summed at once.
BEFORE, BLOCK = 32, 256
#: Rounds of expectation-maximisation; least probability at which a span is added.
ROUNDS, ACCEPT = 40, 0.9

_SPAN = "struct<s:int,e:int,m:string,before:string,after:string>"


def _prefix(lengths: Column) -> Column:
    """Running sums of an array, without the element itself, in blocks."""

    def run(xs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: run(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    # let: the blocks' arrays are used twice
    return F.element_at(F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(bs, run(F.transform(bs, lambda b: b["at"]))["out"], lambda b, at: F.transform(b["out"], lambda x: x + at)))), 1)


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of a pattern: array of (s, e, m, before, after), in code points."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)

    def spans(p: Column) -> Column:
        starts = _prefix(F.transform(p, lambda x: F.char_length(x)))
        odd = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
        one = lambda at: F.transform(odd, lambda i: F.struct(F.get(at, i).alias("s"), (F.get(at, i) + F.char_length(F.get(p, i))).alias("e"), F.get(p, i).alias("m"), F.right(F.get(p, i - 1), F.lit(BEFORE)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after")))
        return F.when(F.size(p) > 2, F.element_at(F.transform(F.array(starts), one), 1)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    found = F.element_at(F.transform(F.array(parts), spans), 1)
    return found if hint is None else F.when(hint, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    place = lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(place(i))).otherwise(place(i)))
    return total % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])?+(?:\.|$)){4}$"),
    "card": lambda m: F.when(F.char_length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.char_length(_digits(m)).between(9, 15),
}


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, STAND_IN)


def _hint(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(HINT[kind])) if kind in HINT else text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """array of (s, k, e): k numbers the kind; sorted by start, then kind."""

    def of(k: int, kind: str) -> Column:
        valid = F.filter(matches(text, BASE[kind], _hint(kind, text)), lambda x: _VALID[kind](x["m"]))
        return F.transform(valid, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(BASE))))


def candidates(text: Column, base: Column) -> Column:
    """array of (s, k, e, votes, shape) of loose matches that no base span overlaps; votes is a string of one of +, - and 0 per labeler."""
    hints = {"secret": text.rlike(r"[A-Za-z0-9_+/-]{20}"), "mail": text.rlike(r"(?i)[\[(]at[\])]"), "number": text.rlike(r"[0-9][\x20.-][0-9]|[0-9]\)")}

    def labelled(x: Column, kind: str) -> Column:
        m = x["m"]
        vote = lambda yes, no=None: F.when(yes, "+").when(no, "-").otherwise("0") if no is not None else F.when(yes, "+").otherwise("0")
        votes = F.concat(
            vote(m.rlike(STRICT[kind]), m.rlike(AGAINST[kind])),
            vote(m.rlike(GAZETTEER[kind])),
            vote(x["before"].rlike(CONTEXT[kind])),
            vote(x["before"].rlike("[\"'=:(<]\\x20?$") & x["after"].rlike("^(?:[\"')>,;.\\s]|$)"), x["after"].rlike("[A-Za-z0-9]")),
        )
        share = F.char_length(_digits(m)) * 4 / F.char_length(m)
        shape = F.concat(F.least(F.char_length(m) / 8, F.lit(9)).cast("int").cast("string"), F.lit("/"), F.floor(share).cast("int").cast("string"), F.lit("/"), F.when(m.rlike("[ .-]"), "s").otherwise("n"))
        return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), votes.alias("votes"), shape.alias("shape"))

    free = lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    def of(kind: str) -> Column:
        return F.transform(F.filter(matches(text, LOOSE[kind], hints[kind]), free), lambda x: labelled(x, kind))

    return F.concat(*map(of, LOOSE))


def reliabilities(counts: dict[tuple[int, str], float], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """The posterior of each (kind, votes) by expectation-maximisation over their counts.

    Per kind: a share of true spans, and per labeler how often it votes +, 0 or
    - on true and on false spans (add-one smoothed). It starts from the votes'
    majority.
    """
    out: dict[tuple[int, str], float] = {}
    for kind in {k for k, _ in counts}:
        own = {v: n for (k, v), n in counts.items() if k == kind}
        post = {v: 1 / (1 + math.exp(-1.5 * (v.count("+") - v.count("-")) + 1.0)) for v in own}
        for _ in range(rounds):
            total = {1: sum(n * post[v] for v, n in own.items()), 0: sum(n * (1 - post[v]) for v, n in own.items())}
            log = {}
            for y in (0, 1):
                for j in range(LABELERS):
                    for c in "+0-":
                        seen = sum(n * (post[v] if y else 1 - post[v]) for v, n in own.items() if v[j] == c)
                        log[y, j, c] = math.log((seen + 1) / (total[y] + 3))
            prior = math.log((total[1] + 1) / (total[0] + 1))
            post = {v: 1 / (1 + math.exp(min(60, max(-60, -prior - sum(log[1, j, c] - log[0, j, c] for j, c in enumerate(v)))))) for v in own}
        out |= {(kind, v): p for v, p in post.items()}
    return out


def classifier(counts: dict[tuple[int, str, str], float], soft: dict[tuple[int, str], float]) -> dict[str, float]:
    """The probability of each "kind|votes|shape" by naive Bayes over the votes' posterior and the shape, trained on the soft labels."""
    by = defaultdict(lambda: [1.0, 1.0])
    for (k, v, shape), n in counts.items():
        p = soft[k, v]
        for key in ((k,), (k, shape)):
            by[key][0] += n * (1 - p)
            by[key][1] += n * p
    out = {}
    for k, v, shape in counts:
        votes = math.log(max(soft[k, v], 1e-12) / max(1 - soft[k, v], 1e-12))
        # the shape's log odds against the kind's
        odds = math.log(by[k, shape][1] / by[k, shape][0]) - math.log(by[k,][1] / by[k,][0])
        out[f"{k}|{v}|{shape}"] = 1 / (1 + math.exp(min(60, max(-60, -votes - odds))))
    return out


def learn(cands: Column, df: DataFrame) -> dict[str, float]:
    """The classifier from every candidate of ``df``."""
    rows = df.select(F.explode(cands).alias("c")).groupBy("c.k", "c.votes", "c.shape").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the patterns' number
    counts = {(r["k"], r["votes"], r["shape"]): r["n"] for r in rows}
    votes: dict[tuple[int, str], float] = defaultdict(float)
    for (k, v, _), n in counts.items():
        votes[k, v] += n
    return classifier(counts, reliabilities(votes))


def accepted(cands: Column, model: dict[str, float], least: float = ACCEPT) -> Column:
    good = sorted(k for k, p in model.items() if p >= least)
    key = lambda c: F.concat_ws("|", c["k"].cast("string"), c["votes"], c["shape"])
    kept = F.filter(cands, lambda c: key(c).isin(good)) if good else F.filter(cands, lambda c: F.lit(False))
    return F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of ``docs``."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _clean(F.col("text")).alias("t"))
    seen = seen.select("doc_id", "t", base_spans(F.col("t")).alias("base"))
    held = stored(seen.select("doc_id", "base", candidates(F.col("t"), F.col("base")).alias("cands")), "pii-candidates")
    model = learn(F.col("cands"), held)
    out = held.withColumn("added", accepted(F.col("cands"), model))
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and n_chars, where there is such a column, as it is then.

    Overlapping spans become one, named after the first. Texts without a span
    stay as they are, nulls too.
    """
    t, base, cands, spans = unique_names("t", "base", "cands", "spans", taken=docs.columns)
    seen = docs.withColumn(t, _clean(F.col("text")))
    seen = seen.withColumn(base, base_spans(F.col(t)))
    seen = stored(seen.withColumn(cands, candidates(F.col(t), F.col(base))).drop(t), "pii-redact")
    model = learn(F.col(cands), seen)
    seen = seen.withColumn(spans, F.array_sort(F.concat(base, accepted(F.col(cands), model))))
    text, names = F.col("text").cast("string"), F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        shown = F.concat(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit("<"), F.upper(F.get(names, x["k"])), F.lit(">"))
        return F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(shown)).alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))

    end = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text)))
    done = seen.withColumn("text", F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, step, end)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
