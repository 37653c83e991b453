"""Mixing sources to target weights by Poisson replication, in SQL functions only.

Every source has a target rate: how often a document of it is repeated on
average so that the source makes up its target share of the mixture. A
document's count is a Poisson variate with that mean, by inversion of its
distribution function at a number in [0, 1) that a seeded hash makes of the
doc_id; documents are exploded by their counts, and all copies are put into a
global order by a second hash.

Defined results: copies with equal keys (of repeated doc_ids) lie next to each other in any order; texts of any length are copied whole; null texts have size 0 and are replicated like others; rows
with a null doc_id or repeated doc_ids share one variate each; sources without
a weight, a null source among them, keep ``rest_rate`` (1: as often as they are,
on average); an empty table gives an empty mixture; a listed source with no
characters gets rate 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import unique_names

SEED = "mix-1"
#: A rate is drawn as the sum of independent parts of at most this mean.
PART = 16.0
#: Probability steps after which the distribution function of one part is 1 in doubles.
STEPS = 80


def uniform(name: str, key: Column) -> Column:
    """A number in [0, 1) of 52 bits by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(name), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson(rate: Column, u_of) -> Column:
    """The Poisson variate of mean ``rate``: for each part, the count of k whose cumulative probability is at most u. u_of: part number (a column) -> uniform number."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    mean = rate / parts

    def draw(j: Column) -> Column:
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
        u = u_of(j)

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * mean / k
            return F.when(u < acc["c"], acc).otherwise(F.struct(p.alias("p"), (acc["c"] + p).alias("c"), (acc["n"] + 1).alias("n")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda a: a["n"])

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, j: n + draw(j))


def rates(docs: DataFrame, weights: dict[str, float], total_scale: float = 1.0) -> dict[str, float]:
    """The target rate of each source in ``weights``, from characters counted over all documents.

    Weights are shares of the characters that the named sources have together,
    times ``total_scale``. Only sources named in the parameter come to the
    driver.
    """
    if any(w < 0 or not math.isfinite(w) for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be finite, none negative, and one positive")
    rows = docs.where(F.col("source").isin(list(weights))).groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("n")).collect()
    have = {r["source"]: r["n"] for r in rows}
    all_chars, all_weights = sum(have.values()), sum(w for s, w in weights.items() if have.get(s))
    return {s: (weights[s] / all_weights * all_chars * total_scale / have[s]) if have.get(s) else 0.0 for s in weights}


def mix(docs: DataFrame, weights: dict[str, float], seed: str = SEED, total_scale: float = 1.0, rest_rate: float = 1.0, names: tuple[str, str, str] = ("copy", "copies", "mix_key")) -> DataFrame:
    """The columns of ``docs``, each row as often as its count says, with the
    number of the copy, the count, and the key of the global order; sorted by
    that key over all partitions. Names that clash with columns of ``docs`` get
    underscores."""
    copy, copies, key = unique_names(*names, taken=docs.columns)
    by = rates(docs, weights, total_scale)
    rate = F.lit(float(rest_rate))
    if by:
        table = F.create_map(*[x for s, r in by.items() for x in (F.lit(s), F.lit(r))])
        rate = F.when(F.col("source").isin(list(by)), F.element_at(table, F.col("source"))).otherwise(rate)
    u_of = lambda j: uniform(seed, F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), j.cast("string")))
    counted = docs.withColumn(copies, poisson(rate, u_of).cast("long")).where(F.col(copies) > 0)
    out = counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy).cast("string")))
    return out.withColumn(key, order).orderBy(key, copy)
