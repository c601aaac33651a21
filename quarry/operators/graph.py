"""Network graphs as two tables: joins, hops, growth, merges and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import forward_edge, stack_scale
from quarry.session import materialize


def hops_to(edges: DataFrame, sinks: DataFrame, most: int = 64) -> DataFrame:
    """[W15] (id, hops): the least number of edges (from_id, to_id) to any sink (id).

    Breadth first: each round joins the last frontier only, and is a written table.
    """
    found = materialize(sinks.select("id", F.lit(0).alias("hops")).distinct(), "hops")
    frontier = found
    for hop in range(1, most + 1):
        near = edges.join(frontier.select(F.col("id").alias("to_id")), "to_id").select(F.col("from_id").alias("id")).distinct()
        fresh = materialize(near.join(found, "id", "left_anti").select("id", F.lit(hop).alias("hops")), "hops")
        if fresh.isEmpty():
            break
        found, frontier = found.union(fresh), fresh
    return found


def grow_region(edges: DataFrame, root: DataFrame, radius: int, most_members: int, most_edges: int) -> DataFrame:
    """[W16] Members reached from the root within the radius: each hop takes the heaviest
    edges first, up to the caps on edges a member and on members."""
    region = materialize(root.select("id", F.lit(0).alias("hops")), "region")
    frontier = region
    both = edges.select("from_id", "to_id", "weight").union(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "weight"))
    for hop in range(1, radius + 1):
        out = both.join(frontier.select(F.col("id").alias("from_id")), "from_id")
        strongest = Window.partitionBy("from_id").orderBy(F.desc(F.abs("weight")), "to_id")
        out = out.withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= most_edges)
        fresh = out.groupBy(F.col("to_id").alias("id")).agg(F.max(F.abs("weight")).alias("w")).join(region, "id", "left_anti")
        room = max(most_members - region.count(), 0)
        fresh = materialize(fresh.orderBy(F.desc("w"), "id").limit(room).select("id", F.lit(hop).alias("hops")), "region")
        if fresh.isEmpty():
            break
        region, frontier = region.union(fresh), fresh
    return region


def unused_sources(sources: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """[J13, P13] Sources (id, pos) without an edge into a focus (focus, focus_pos) and before it."""
    legal = sources.join(focus, forward_edge(F.col("pos"), F.col("focus_pos")))
    used = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("focus"))
    return legal.join(used, ["id", "focus"], "left_anti")


def incoming_statistics(edges: DataFrame, focus: DataFrame, stats: DataFrame) -> DataFrame:
    """[J12] Edges into the focus with the statistics of their sources, where there are any."""
    into = edges.join(focus.select(F.col("id").alias("to_id")), "to_id")
    return into.join(stats.withColumnRenamed("id", "from_id"), "from_id", "left")


def structural_diff(base: DataFrame, other: DataFrame, key: list[str], value: str) -> DataFrame:
    """[J14] New, changed and removed rows between two graphs."""
    a = base.select(*key, F.col(value).alias("old"), F.lit(True).alias("in_base"))
    b = other.select(*key, F.col(value).alias("new"), F.lit(True).alias("in_other"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("in_base").isNull(), "new").when(F.col("in_other").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(*key, "old", "new", "kind")


def merge_deltas(deltas: DataFrame, key: list[str]) -> DataFrame:
    """[J15] Changes of several candidates by key; those that disagree are conflicts."""
    return deltas.groupBy(*key).agg(F.min("new").alias("new"), F.count_distinct("variant").alias("variants"), (F.count_distinct("new") > 1).alias("conflict"))


def classify_grafts(requirements: DataFrame, parts: DataFrame, present: DataFrame) -> DataFrame:
    """[J16] Grafts that are present, applicable (all that they require exists) or inapplicable."""
    known = present.select("id", F.lit(True).alias("there")).distinct()
    has = parts.join(known, "id", "left").groupBy("graft").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("present"))
    can = requirements.join(known, "id", "left").groupBy("graft").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("applicable"))
    both = has.join(can, "graft", "full_outer")
    return both.select("graft", F.when(F.coalesce("present", F.lit(False)), "present").when(F.coalesce("applicable", F.lit(True)), "applicable").otherwise("inapplicable").alias("state"))


def prune_dangling(records: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """[J17] Side records whose key resolves, and the keys that dangle."""
    return records.join(keys, key, "left_semi"), records.join(keys, key, "left_anti").select(key).distinct()


def contributors(base: DataFrame, variants: DataFrame) -> DataFrame:
    """[A45] Variants that add an edge into each target."""
    added = variants.join(base.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    return added.groupBy("to_id").agg(F.count_distinct("variant").alias("k"))


def dampen(base: DataFrame, merged: DataFrame, k: DataFrame) -> DataFrame:
    """[G14] New edges of a merged graph with their weight scaled by k^-0.5 of their target."""
    known = base.select("from_id", "to_id", F.lit(True).alias("old"))
    joined = merged.join(known, ["from_id", "to_id"], "left").join(k, "to_id", "left")
    scale = F.when(F.col("old").isNull(), stack_scale(F.coalesce("k", F.lit(1)))).otherwise(1.0)
    return joined.select("from_id", "to_id", F.col("weight").alias("weight_before"), (F.col("weight") * scale).alias("weight"), scale.alias("scale"))


def improvement_signals(outputs: DataFrame, hidden: DataFrame, hops: DataFrame) -> DataFrame:
    """[G20] Error mass of outputs, and blame of hidden neurons halved at each hop to an output."""
    near = hidden.where(~F.coalesce("no_change", F.lit(False)) & (F.col("count") > 0)).join(hops, "id")
    blame = F.abs("total_adjusted_bias") * F.pow(F.lit(0.5), F.col("hops"))
    both = outputs.select("id", F.col("abs_error_mass").alias("signal")).union(near.select("id", blame.alias("signal")))
    return both.where(F.col("signal") > 1e-12)


def focus_weights(signals: DataFrame, history: DataFrame) -> DataFrame:
    """[K9, G21] Focus candidates by signal and past outcomes, heaviest first."""
    joined = signals.join(history, "id", "left")
    of = lambda c: F.coalesce(c, F.lit(0))
    weight = (F.lit(0.01) + F.col("signal") * 50.0 + of("accepts") * 8.0 + of("near_misses") * 3.0) / (of("hard_fails") + 1.0)
    return joined.select("id", "signal", F.greatest(weight, F.lit(0.01)).alias("weight")).orderBy(F.desc("weight"), "id")


def top_sources(ranked: DataFrame, focus: list[str], head: int = 48, more_hidden: int = 16) -> DataFrame:
    """[K4, K11] The best sources of each focus, ties by id, and the next hidden ones behind them."""
    best = Window.partitionBy(*focus).orderBy(F.desc("score"), "source")
    rows = ranked.withColumn("rank", F.row_number().over(best))
    hidden = ~F.col("source").cast("string").startswith("input-")
    later = Window.partitionBy(*focus, "late_hidden").orderBy("rank")
    rows = rows.withColumn("late_hidden", hidden & (F.col("rank") > head)).withColumn("late", F.row_number().over(later))
    return rows.where((F.col("rank") <= head) | (F.col("late_hidden") & (F.col("late") <= more_hidden))).drop("late_hidden", "late")


def elite(ranked: DataFrame, focus: list[str]) -> DataFrame:
    """[K5] Sources near the top score, from which one is drawn."""
    top = F.max("score").over(Window.partitionBy(*focus))
    return ranked.withColumn("bar", F.greatest(top * 0.85, top - 0.05)).where(F.col("score") + 2.220446049250313e-16 >= F.col("bar")).drop("bar")


def best_incoming(edges: DataFrame, focus: str) -> DataFrame:
    """[K6, K7] Of each focus: the edge of greatest correlation over 0.05, else of greatest
    proposed change; and the lightest edge."""
    strong = F.abs("correlation")
    return edges.groupBy(focus).agg(
        F.coalesce(F.max_by("source", F.when(strong > 0.05, F.struct(strong, F.col("source")))), F.max_by("source", F.struct(F.abs("proposed"), F.col("source")))).alias("best"),
        F.min_by("source", F.struct(F.abs("weight"), F.col("source"))).alias("lightest"),
    )


def highest_signal(signals: DataFrame, excluded: DataFrame) -> DataFrame:
    """[K8] The focus of greatest signal outside a set; ties go to the larger id."""
    return signals.join(excluded, "id", "left_anti").agg(F.max_by("id", F.struct("signal", "id")).alias("focus"))


def insertion_order(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """[K20] Edges by the places of their ends, as a written graph keeps them."""
    a, b = positions.select(F.col("id").alias("from_id"), F.col("pos").alias("from_pos")), positions.select(F.col("id").alias("to_id"), F.col("pos").alias("to_pos"))
    placed = edges.join(a, "from_id").join(b, "to_id")
    return placed.orderBy("from_pos", "to_pos")


def legal_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """[P13] The edges that go forward."""
    return insertion_order(edges, positions).where(forward_edge(F.col("from_pos"), F.col("to_pos")))


def add_edge(edges: DataFrame, positions: DataFrame, from_id: str, to_id: str, weight: float) -> DataFrame:
    """[G19] The graph with one more edge; an edge that exists or goes backwards is an error."""
    spark = edges.sparkSession
    new = spark.createDataFrame([(from_id, to_id, weight)], "from_id string, to_id string, weight double")
    if legal_edges(new, positions).isEmpty():
        raise ValueError(f"{from_id} -> {to_id} isn't a forward edge")
    if not edges.where((F.col("from_id") == from_id) & (F.col("to_id") == to_id)).isEmpty():
        raise ValueError(f"{from_id} -> {to_id} exists")
    return edges.select("from_id", "to_id", "weight").union(new)


def split_edge(edges: DataFrame, from_id: str, to_id: str, middle: str) -> DataFrame:
    """[G19] The edge replaced by two through a new neuron: weight 1 in, the old weight out."""
    hit = (F.col("from_id") == from_id) & (F.col("to_id") == to_id)
    ways = F.when(hit, F.array(F.struct(F.lit(from_id).alias("f"), F.lit(middle).alias("t"), F.lit(1.0).alias("w")), F.struct(F.lit(middle).alias("f"), F.lit(to_id).alias("t"), F.col("weight").alias("w")))).otherwise(
        F.array(F.struct(F.col("from_id").alias("f"), F.col("to_id").alias("t"), F.col("weight").alias("w")))
    )
    return edges.select(F.explode(ways).alias("e")).select(F.col("e.f").alias("from_id"), F.col("e.t").alias("to_id"), F.col("e.w").alias("weight"))
