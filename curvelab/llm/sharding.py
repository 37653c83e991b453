"""Balanced sharding by label propagation, in DataFrame functions only.

Documents with equal texts are linked. Every document starts in a shard that a
hash of its doc_id names; then, round by round, linked documents ask to move to
the shard where most of their group is, and requests are granted as far as the
shard's quota has room. What is linked to nothing fills the shards up, so that
the row counts of any two shards differ by one at most, whatever the links are.

Links are never expanded. A group's documents are dealt over nodes, at most
``NODE`` rows each on average and 24 times as many nodes as shards it needs, so
a group of any size is many small rows; propagation joins nodes with their
group's mass by shard (a row per shard at most). A group too large for a shard
is gathered in as few shards as its size needs.

Defined results: a null text is the empty text; repeated rows are dealt like
others and take a slot each; a null doc_id hashes like a value; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelab.llm.common import ranked, stored

SHARDS, ROUNDS = 24, 8
#: Share of a shard's quota that a group larger than a shard may plan to take.
FILL = 0.9
#: Rows of a node, and of a sub-group that is ranked at once.
NODE, RANKED = 50_000, 50_000
#: Groups of more than an n-th part of all rows are broadcast with their sizes: fewer than so many.
HOT = 100_000


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _chosen(values: list[int | float], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def _loads(nodes: DataFrame, shards: int) -> list[int]:
    have = {r["shard"]: r["load"] for r in nodes.groupBy("shard").agg(F.sum("n").alias("load")).collect()}  # a row per shard
    return [have.get(s, 0) for s in range(shards)]


def propagate(nodes: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move the nodes (class, part, n, class_n, shard) of each class together under quotas."""
    shards, cap = len(quota), max(1, min(quota))
    needs = F.greatest(F.ceil(F.col("class_n") / F.lit(FILL * cap)), F.lit(1))
    last = None
    for it in range(rounds):
        loads = _loads(nodes, shards)
        room = [max(0, q - x) for q, x in zip(quota, loads, strict=True)]
        mass = nodes.groupBy("class", "class_n", "shard").agg(F.sum("n").alias("mass"))
        open_ = _chosen([int(r > 0) for r in room], F.col("shard")) == 1
        # a group that fits a shard prefers one with room, unless it is together already; then by mass, ties by a hash that spreads them
        suits = open_ | (F.col("class_n") > cap) | (F.col("mass") == F.col("class_n"))
        by = Window.partitionBy("class").orderBy(suits.desc(), F.desc("mass"), F.xxhash64("class", "shard"))
        homes = mass.withColumn("rank", F.row_number().over(by)).withColumn("home", F.col("rank") <= needs)
        goals = homes.where(F.col("home") & open_).groupBy("class").agg(F.sort_array(F.collect_list("shard")).alias("goals"))
        homes = homes.select(F.col("class").alias("hc"), F.col("shard").alias("hs"), "home")
        asked = (
            nodes.join(homes, (F.col("class") == F.col("hc")) & (F.col("shard") == F.col("hs")))
            .join(goals.withColumnRenamed("class", "gc"), F.col("class") == F.col("gc"), "left")
            .withColumn("goal", F.when(~F.col("home") & F.col("goals").isNotNull(), F.element_at("goals", (F.pmod(F.xxhash64("class", "part"), F.size("goals")) + 1).cast("int"))))
            .select("class", "part", "n", "class_n", "shard", "goal")
        )
        asked = stored(asked, f"sharding-asked-{it}")
        inbound = {r["goal"]: r["n"] for r in asked.where("goal is not null").groupBy("goal").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        if not inbound or inbound == last:
            break
        last = inbound
        share = [min(1.0, room[s] / inbound[s]) if s in inbound else 0.0 for s in range(shards)]
        # requests over the room are granted class by class, or node by node where a class is larger than a shard
        luck = F.pmod(F.when(F.col("class_n") > cap, F.xxhash64("class", "part", F.lit(it))).otherwise(F.xxhash64("class", F.lit(it))), F.lit(1_000_000)) / 1_000_000
        moves = F.col("goal").isNotNull() & (luck < _chosen(share, F.col("goal")))
        nodes = asked.withColumn("shard", F.when(moves, F.col("goal")).otherwise(F.col("shard"))).drop("goal")
    return nodes


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows) for every row of ``docs``, by the law `rows`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("class")), "sharding-base")
    counts = base.groupBy("class").agg(F.count(F.lit(1)).alias("class_n")).select(F.col("class").alias("c"), "class_n")
    n = base.count()
    # what no task should get whole is joined by broadcast, the rest by class
    hot = F.col("class_n") > F.lit(max(1, n // HOT))
    counts = stored(counts, "sharding-counts")
    told = base.join(F.broadcast(counts.where(hot)), F.col("class") == F.col("c"), "left")
    sized = told.where("c is not null").unionByName(told.where("c is null").drop("c", "class_n").join(counts.where(~hot), F.col("class") == F.col("c")))
    quota = quotas(n, shards)
    per = max(1, min(max(1, min(quota)), shards * NODE))
    parts = F.lit(shards) * F.greatest(F.ceil(F.col("class_n") / per), F.lit(1))
    rows = stored(
        sized.drop("c")
        .withColumn("part", F.when(F.col("class_n") > 1, F.pmod(F.xxhash64("doc_id"), parts))), "sharding-rows",
    )
    linked = rows.where("part is not null")
    nodes = linked.groupBy("class", "part", "class_n").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", F.pmod("part", F.lit(shards)).cast("int"))
    nodes = stored(propagate(stored(nodes, "sharding-nodes"), quota, rounds), "sharding-moved")
    kept = [min(q, x) for q, x in zip(quota, _loads(nodes, shards), strict=True)]

    labels = nodes.select(F.col("class").alias("c"), F.col("part").alias("p"), "shard")
    placed = linked.join(labels, (F.col("class") == F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    groups = -(-max(quota, default=1) // RANKED)
    placed = stored(ranked(placed, ["shard"], [F.col("class"), F.col("doc_id")], "slot", F.xxhash64("class", "part"), groups=groups), "sharding-placed")
    over = F.col("slot") >= _chosen(quota, F.col("shard"))
    rest = rows.where("part is null").unionByName(placed.where(over).drop("shard", "slot"))
    starts = [sum(quota[:s]) - sum(kept[:s]) for s in range(shards)]  # where a shard's room starts in the order of the rest
    rest = ranked(rest.withColumn("all", F.lit(0)), ["all"], [F.col("class"), F.col("doc_id")], "at", F.xxhash64("class", "part"), groups=-(-n // RANKED)).drop("all")
    rest = rest.withColumn("shard", (F.size(F.filter(F.array(*map(F.lit, starts)), lambda b: b <= F.col("at"))) - 1).cast("int"))
    # shards without room share their start with the next one, which the size() above prefers
    rest = rest.withColumn("slot", F.col("at") - _chosen(starts, F.col("shard")) + _chosen(kept, F.col("shard")))
    out = placed.where(~over).select("doc_id", "size", "text_crc32", "class_n", "shard", "slot").unionByName(rest.select("doc_id", "size", "text_crc32", "class_n", "shard", "slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("class_n").alias("group_rows"))
