"""Machines behind browsers: strong and weak identifiers seen together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramaline.operators.graph import connected_components


def link_machines(seen: DataFrame, order: list[str], strong: tuple[str, ...] = ("cookie", "copy"), weak: str = "print") -> DataFrame:
    """kind, id, machine: the machine of every identifier, named by its oldest one (as kind:id).

    seen has a row per visit, in order, with the identifiers that it showed, or null. Strong ones that were shown together are
    one machine. A weak one, which different machines may share, belongs to the machine of its first visit, and
    brings a visit to its own machine only if that visit shows no strong one that was known before: it never joins two
    machines. The oldest identifier is the one that was seen first, of those of one visit the first by kind.
    """
    kinds = [*strong, weak]
    visits = seen.select(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *(F.col(k).cast("string").alias(k) for k in kinds))
    at = F.struct(*(f"o{i}" for i in range(len(order))))
    named = [F.when(F.col(k).isNotNull(), F.struct(F.lit(i).alias("rank"), F.concat(F.lit(f"{k}:"), F.col(k)).alias("node"))) for i, k in enumerate(kinds)]
    shown = visits.select(at.alias("at"), F.explode(F.array_compact(F.array(*named))).alias("x")).select("at", "x.rank", "x.node")
    first = shown.groupBy("node").agg(F.min(F.struct("at", "rank")).alias("first"))
    # of each visit: its identifiers with the visits that they were first shown on
    of_visit = shown.join(first.select("node", F.col("first.at").alias("since")), "node").groupBy("at").agg(F.collect_set(F.struct("rank", "node", "since")).alias("ids"))
    is_weak = len(strong)
    sure = F.array_sort(F.filter("ids", lambda x: x["rank"] < is_weak))
    weak_one = F.get(F.filter("ids", lambda x: x["rank"] == is_weak), F.lit(0))
    stranger = ~F.exists("ids", lambda x: (x["rank"] < is_weak) & (x["since"] < F.col("at")))
    chosen = of_visit.select(sure.alias("sure"), F.when(stranger | (weak_one["since"] == F.col("at")), weak_one).alias("weak"))
    chain = F.transform(F.sequence(F.lit(1), F.size("sure") - 1), lambda i: F.struct(F.get("sure", i - 1)["node"].alias("a"), F.get("sure", i)["node"].alias("b")))
    pairs = chosen.where("size(sure) > 1").select(F.explode(chain).alias("e")).select("e.a", "e.b")
    loose = chosen.where("weak is not null and size(sure) > 0").select(F.get("sure", F.lit(0))["node"].alias("a"), F.col("weak.node").alias("b"))
    linked = connected_components(pairs.unionByName(loose).distinct(), "a", "b")
    all_ids = first.join(linked.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    oldest = F.first("node").over(Window.partitionBy("component").orderBy("first", "node"))
    return all_ids.select(F.split("node", ":", 2)[0].alias("kind"), F.split("node", ":", 2)[1].alias("id"), oldest.alias("machine"))
