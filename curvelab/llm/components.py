"""Connected components over edge tables that never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelab.llm.common import Stored


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find over pairs; every node seen, with the least node of its set."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while parent[r] != r:
            r = parent[r]
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges of each batch, as edges to its roots."""
    for b in batches:
        roots = forest(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        out = [(x, r) for x, r in roots.items() if x != r]
        yield pa.record_batch([pa.array([e[k] for e in out], pa.int64()) for k in range(2)], names=["a", "b"])


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, long); root
    is the least node that the node reaches.

    Edges are first written down, as a task that both made and contracted them
    would keep two Python workers; they are contracted batch by batch (linear memory, one batch at a
    time), then alternating large-star and small-star rounds run as Spark
    joins until nothing changes. Minima are pre-aggregated before they are
    shuffled, and a node with very many edges is one skewed join key, which
    adaptive execution splits. Nulls, loops and repeated edges are dropped. No
    edge or label reaches the driver: it compares two numbers a round.
    """
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    given = Stored(clean, f"{name}-edges")
    now = Stored(given.df.mapInArrow(_contract, "a long, b long").distinct(), name)
    given.drop()
    mark = _mark(now.df)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = Stored(_round(now.df), name)
        new = _mark(after.df)
        now.drop()
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    x = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(x).alias("x"), F.sum(F.pmod(x, F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
    large = (
        both.join(least, F.col("u") == F.col("lu"))
        .where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("la"), "m")
    small = large.join(low, F.col("a") == F.col("la")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select(F.col("la").alias("a"), F.col("m").alias("b"))).distinct()
