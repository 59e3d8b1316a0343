"""Reference graph (G1 to G4): edges, neighbours in hops, counts, closure in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored


def edges(refs: DataFrame, contains: DataFrame) -> DataFrame:
    """G1: one edge for each (src, dst), the last written. Both inputs have src, dst, type and seq (order of writing)."""
    both = refs.select("src", "dst", "type", "seq").unionByName(contains.select("src", "dst", "type", "seq"))
    last = both.groupBy("src", "dst").agg(F.max(F.struct("seq", "type")).alias("e"))  # partial maxima before the shuffle
    return last.select("src", "dst", F.col("e.type").alias("type"))


def neighbours(start: DataFrame, e: DataFrame, hops: int = 1, forward: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(start, id, depth): least number of steps up to `hops`; the start itself is left out, unknown starts give nothing."""
    e = e if kinds is None else e.filter(F.col("type").isin(kinds))
    step = e.select("src", "dst")
    if not forward:
        step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = step.distinct()
    seen = start.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, hops + 1):
        new = front.join(step, front["id"] == step["src"]).select("start", F.col("dst").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = stored(new.withColumn("depth", F.lit(d)))  # read by the next hop and by all later sets of what was seen
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def stats(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Number of nodes and of edges."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges"))))  # one row each


def rounds(lists: Column, budget: int, held: Column) -> Column:
    """Array of (id, at): round after round each list's next neighbour that nobody holds, until the budget is spent; `at` is the
    list's place. A neighbour claimed earlier in a round lets its list go on to the next one at once, so this is a fold."""
    n = F.size(lists)
    longest = F.coalesce(F.array_max(F.transform(lists, lambda x: F.size(x))), F.lit(0))
    turns = F.when(longest * n > 0, F.sequence(F.lit(0), F.greatest(longest * n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def turn(acc: Column, i: Column) -> Column:
        free = F.filter(F.get(lists, i % n), lambda x: ~F.array_contains(acc["all"], x))
        pick = F.get(free, F.lit(0))
        go = (F.size(acc["out"]) < budget) & pick.isNotNull()
        new = F.array(F.struct(pick.alias("id"), (i % n).cast("int").alias("at")))
        return F.struct(F.when(go, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"), F.when(go, F.concat(acc["all"], F.array(pick))).otherwise(acc["all"]).alias("all"))

    zero = F.struct(F.array().cast("array<struct<id:string,at:int>>").alias("out"), held.cast("array<string>").alias("all"))
    return F.aggregate(turns, zero, turn, lambda acc: acc["out"])


def take_in_rounds(lists: Column, budget: int, held: Column) -> Column:
    """The neighbours alone."""
    return F.transform(rounds(lists, budget, held), lambda x: x["id"])


def closure(hits: DataFrame, e: DataFrame, types: DataFrame, kinds: list[str], by_reference: int = 5, by_parent: int = 4) -> DataFrame:
    """(q_id, id, via): what the hits refer to, then what they contain; `via` is the hit that it came by. Hits have q_id, id, rank,
    type; chapters and sections are neither seeds nor targets, and what is a hit is not taken again. Edges are followed forward
    only. A seed needs no more of its neighbours than the budget, what is held and what others may take, so lists are bounded."""
    no = ["chapter", "section"]
    good = types.filter(~F.col("type").isin(no)).select(F.col("id").alias("dst"))
    held = hits.groupBy("q_id").agg(F.collect_set("id").alias("held"))
    seeds = hits.filter(~F.col("type").isin(no)).select("q_id", F.col("id").alias("src"), "rank")

    def lists(of: DataFrame, name: str, most: int) -> DataFrame:
        near = seeds.join(of.select("src", "dst").distinct().join(good, "dst", "left_semi"), "src").join(hits.select("q_id", F.col("id").alias("dst")), ["q_id", "dst"], "left_anti")
        near = near.withColumn("i", F.row_number().over(Window.partitionBy("q_id", "src").orderBy("dst"))).filter(F.col("i") <= most)
        near = near.groupBy("q_id", "rank", "src").agg(F.sort_array(F.collect_list("dst")).alias("n"))
        return near.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "src", "n"))).alias(name))

    x = held.join(lists(e.filter(F.col("type").isin(kinds)), "refs", by_reference), "q_id", "left").join(lists(e.filter("type = 'contains'"), "kin", by_reference + by_parent), "q_id", "left")
    none = F.array().cast("array<array<string>>")
    x = x.withColumn("a", rounds(F.coalesce(F.col("refs")["n"], none), by_reference, F.col("held")))
    x = x.withColumn("b", rounds(F.coalesce(F.col("kin")["n"], none), by_parent, F.concat("held", F.col("a")["id"])))
    named = lambda taken, by: F.transform(taken, lambda v: F.struct(v["id"].alias("id"), F.get(F.col(by)["src"], v["at"]).alias("via")))
    return x.select("q_id", F.explode(F.concat(named("a", "refs"), named("b", "kin"))).alias("n")).select("q_id", "n.*")


def rank_within(df: DataFrame, group: str, order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
