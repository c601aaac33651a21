"""Queries over graphs, paired arms, strata and landscapes (WL2, WL4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph as g
from quarry.operators import paired as p
from quarry.plans.profile import rounded
from quarry.plans.registry import query
from quarry.plans.tables import DELTAS, candidate_deltas
from quarry.session import table

EDGE_SQL = """SELECT 'c' || c_custkey AS from_id, 'n' || c_nationkey AS to_id, c_acctbal AS weight FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_acctbal FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey AS DOUBLE) FROM nation UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_totalprice FROM orders"""


def edges(spark, d):
    """Orders, customers, suppliers, nations and regions as a graph."""
    of = lambda t, a, x, b, y, w: table(spark, d, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("from_id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("to_id"), F.col(w).cast("double").alias("weight"))
    parts = [of("customer", "c", "c_custkey", "n", "c_nationkey", "c_acctbal"), of("supplier", "s", "s_suppkey", "n", "s_nationkey", "s_acctbal"), of("nation", "n", "n_nationkey", "r", "n_regionkey", "n_nationkey"), of("orders", "o", "o_orderkey", "c", "o_custkey", "o_totalprice")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    "bfs_hops",
    f"""WITH RECURSIVE e AS ({EDGE_SQL}), h AS (SELECT 'r' || r_regionkey AS id, 0 AS hops FROM region UNION SELECT e.from_id, h.hops + 1 FROM h JOIN e ON e.to_id = h.id WHERE h.hops < 10)
SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM h GROUP BY 1""",
)
def bfs_hops(spark, d):
    """Hops to the nearest output."""
    sinks = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return g.hops_to(edges(spark, d), sinks)


@query("unused_sources_anti", "SELECT s.s_suppkey AS id, n.n_nationkey AS focus FROM supplier s, nation n WHERE s.s_suppkey < n.n_nationkey + 10 AND s.s_nationkey <> n.n_nationkey")
def unused_sources_anti(spark, d):
    """Legal sources that aren't connected yet."""
    sources = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("pos"))
    focus = table(spark, d, "nation").select(F.col("n_nationkey").alias("focus"), (F.col("n_nationkey") + 10).alias("focus_pos"))
    used = table(spark, d, "supplier").select(F.col("s_suppkey").alias("from_id"), F.col("s_nationkey").alias("to_id"))
    return g.unused_sources(sources, used, F.broadcast(focus)).select("id", "focus")


@query("incoming_statistics", "SELECT n_nationkey AS to_id, c_custkey AS from_id, count(o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def incoming_statistics(spark, d):
    """Edges into focuses with their sources' statistics."""
    into = table(spark, d, "customer").select(F.col("c_custkey").alias("from_id"), F.col("c_nationkey").alias("to_id"))
    focus = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    stats = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    return g.incoming_statistics(into, focus, stats).select("to_id", "from_id", F.coalesce("orders", F.lit(0)).alias("orders"))


@query(
    "structural_diff",
    "WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'new' WHEN b.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size",
)
def structural_diff(spark, d):
    """New, changed and removed parts."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    other = part.where("p_partkey % 4 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return g.structural_diff(part.where("p_partkey % 3 <> 0"), other, ["p_partkey"], "p_size").select("p_partkey", "kind")


@query("merge_conflicts", "SELECT l_partkey, count(DISTINCT l_orderkey) AS variants, count(DISTINCT l_discount) > 1 AS conflict FROM lineitem GROUP BY 1")
def merge_conflicts(spark, d):
    """Merged changes and conflicts."""
    deltas = table(spark, d, "lineitem").select("l_partkey", F.col("l_discount").alias("new"), F.col("l_orderkey").alias("variant"))
    return g.merge_deltas(deltas, ["l_partkey"]).select("l_partkey", "variants", "conflict")


@query(
    "graft_states",
    """WITH k AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey % 3 = 0), h AS (SELECT l_orderkey AS graft, bool_and(l_partkey IN (SELECT id FROM k)) AS p FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey AS graft, bool_and(l_partkey IN (SELECT id FROM k)) AS a FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT h.graft, CASE WHEN p THEN 'present' WHEN coalesce(a, true) THEN 'applicable' ELSE 'inapplicable' END AS state FROM h LEFT JOIN r USING (graft)""",
)
def graft_states(spark, d):
    """Grafts present, applicable or not."""
    lines = table(spark, d, "lineitem")
    parts = lines.select(F.col("l_orderkey").alias("graft"), F.col("l_partkey").alias("id"), "l_quantity")
    return g.classify_grafts(parts.where("l_quantity > 25"), parts, lines.where("l_orderkey % 3 = 0").select(F.col("l_partkey").alias("id")))


@query("prune_dangling", "SELECT count(*) AS kept, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS dropped FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def prune_dangling(spark, d):
    """Records whose key resolves, and those whose doesn't."""
    keys = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, d, "orders").select("o_custkey")
    kept, _ = g.prune_dangling(orders, keys, "o_custkey")
    return kept.agg(F.count("*").alias("kept")).crossJoin(orders.join(keys, "o_custkey", "left_anti").agg(F.count("*").alias("dropped")))


@query(
    "stack_dampening",
    """WITH k AS (SELECT l_partkey AS to_id, count(DISTINCT l_orderkey) AS k FROM lineitem WHERE l_quantity >= 20 GROUP BY 1) SELECT l.l_partkey AS to_id, count(*) AS edges, round(sum(l_extendedprice) + 1e-5, 2) AS before,
 round(sum(l_extendedprice * CASE WHEN l_quantity < 20 OR k <= 1 THEN 1 ELSE pow(k, -0.5) END) + 1e-5, 2) AS after FROM lineitem l LEFT JOIN k ON k.to_id = l.l_partkey GROUP BY 1""",
)
def stack_dampening(spark, d):
    """Weights of stacked new edges scaled by their contributors."""
    lines = table(spark, d, "lineitem")
    edge = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_extendedprice").alias("weight"), F.col("l_orderkey").alias("variant"), "l_quantity")
    base = edge.where("l_quantity < 20")
    out = g.dampen(base, edge, g.contributors(base, edge))
    return out.groupBy("to_id").agg(F.count("*").alias("edges"), F.round(F.sum("weight_before") + 1e-5, 2).alias("before"), F.round(F.sum("weight") + 1e-5, 2).alias("after"))


@query(
    "improvement_signals",
    """SELECT 'r' || r_regionkey AS id, round(r_regionkey + 1.0, 6) AS signal FROM region UNION ALL SELECT 'n' || n_nationkey, round(abs(n_nationkey - 12) * 0.5, 6) FROM nation WHERE n_nationkey <> 12""",
)
def improvement_signals(spark, d):
    """Output mass and decayed hidden blame."""
    out = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), (F.col("r_regionkey") + 1.0).alias("abs_error_mass"))
    hidden = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), (F.col("n_nationkey") - 12).cast("double").alias("total_adjusted_bias"), F.lit(1).alias("count"), F.lit(False).alias("no_change"))
    hops = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(1).alias("hops"))
    return rounded(g.improvement_signals(out, hidden, hops))


@query(
    "focus_weights",
    "SELECT n_nationkey AS id, round(greatest((0.01 + 50 * (n_nationkey / 100.0) + 8 * (n_nationkey % 3) + 3 * (n_nationkey % 2)) / (1 + n_nationkey % 4), 0.01), 6) AS weight FROM nation",
)
def focus_weights(spark, d):
    """Focus candidates by signal and history."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    history = n.select("id", (F.col("id") % 3).alias("accepts"), (F.col("id") % 2).alias("near_misses"), (F.col("id") % 4).alias("hard_fails"))
    return g.focus_weights(n.select("id", (F.col("id") / 100.0).alias("signal")), history).select("id", F.round("weight", 6).alias("weight"))


@query(
    "top_sources",
    f"WITH r AS (SELECT experiment, stem AS source, delta AS score, row_number() OVER (PARTITION BY experiment ORDER BY delta DESC, stem) AS rk FROM ({DELTAS})) SELECT experiment, source, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 4",
)
def top_sources(spark, d):
    """Shortlist and the next hidden sources."""
    rows = candidate_deltas(spark, d).select("experiment", F.col("stem").alias("source"), F.col("delta").alias("score"))
    return g.top_sources(rows, ["experiment"], 3, 1).select("experiment", "source", "rank")


@query("elite_sources", f"WITH r AS (SELECT experiment, stem, score / 100000 AS s, max(score / 100000) OVER (PARTITION BY experiment) AS t FROM ({DELTAS})) SELECT experiment, stem FROM r WHERE s + 2.220446049250313e-16 >= greatest(t * 0.85, t - 0.05)")
def elite_sources(spark, d):
    """K5: sources near the top score."""
    return g.elite(candidate_deltas(spark, d).withColumn("score", F.col("score") / 100000), ["experiment"]).select("experiment", "stem")


@query(
    "best_incoming",
    "SELECT l_orderkey AS focus, coalesce(arg_max(l_partkey, (l_tax, l_partkey)) FILTER (l_tax > 0.05), arg_max(l_partkey, (l_extendedprice, l_partkey))) AS best, arg_min(l_partkey, (l_quantity, l_partkey)) AS lightest FROM lineitem GROUP BY 1",
)
def best_incoming(spark, d):
    """K6, K7: the strongest and the lightest edge into a focus."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("focus"), F.col("l_partkey").alias("source"), F.col("l_tax").alias("correlation"), F.col("l_extendedprice").alias("proposed"), F.col("l_quantity").alias("weight"))
    return g.best_incoming(e, "focus")


@query("highest_signal", "SELECT arg_max(c_custkey, (c_acctbal, c_custkey)) AS focus FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def highest_signal(spark, d):
    """K8: the strongest focus outside a set."""
    signals = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("signal"))
    return g.highest_signal(signals, table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")))


@query("duplicate_structures", "WITH f AS (SELECT l_orderkey, string_agg(l_partkey % 50 || ':' || CAST(l_quantity AS INTEGER) % 5, ',' ORDER BY l_partkey % 50, CAST(l_quantity AS INTEGER) % 5) AS s FROM lineitem GROUP BY 1) SELECT count(*) AS candidates, count(DISTINCT s) AS structures FROM f")
def duplicate_structures(spark, d):
    """Structural duplicates by a hash of sorted edges."""
    from quarry.operators.ledgers import fingerprints

    e = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).alias("from_id"), (F.col("l_quantity").cast("int") % 5).alias("to_id"), F.lit(1).alias("weight"))
    return fingerprints(e, ["l_orderkey"]).agg(F.count("*").alias("candidates"), F.count_distinct("fingerprint").alias("structures"))


PAIRS = """WITH r AS (SELECT o_custkey % 5 AS cell, o_custkey AS seed, o_orderpriority AS arm, o_totalprice AS v, o_orderkey AS line FROM orders),
t AS (SELECT cell, seed, arg_min(v, line) FILTER (arm = '1-URGENT') AS t, arg_min(v, line) FILTER (arm = '5-LOW') AS c FROM r GROUP BY 1, 2), q AS (SELECT cell, seed, t - c AS d FROM t)"""


def _pairs(spark, d):
    runs = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("cell"), F.col("o_custkey").alias("seed"), F.col("o_orderpriority").alias("arm"), "o_totalprice", F.col("o_orderkey").alias("line"), F.lit(None).cast("string").alias("error"))
    return p.pair_arms(runs, ["cell"], "seed", "o_totalprice", "1-URGENT", "5-LOW")


@query(
    "paired_summary",
    f"{PAIRS} SELECT cell, count(d) AS pairs, round(avg(d), 4) AS mean, round(median(d), 4) AS median, count(*) FILTER (d < 0) AS wins, count(*) FILTER (d > 0) AS losses, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d IS NULL) AS failures FROM q GROUP BY 1",
)
def paired_summary(spark, d):
    """Paired arms by seed."""
    return rounded(p.paired_summary(_pairs(spark, d), ["cell"]), 4)


@query(
    "verdict",
    f"{PAIRS}, s AS (SELECT cell, count(d) AS n, avg(d) AS m, 1.96 * stddev_samp(d) / sqrt(count(d)) AS h FROM q GROUP BY 1) SELECT cell, CASE WHEN n < 3 OR h IS NULL THEN 'insufficient' WHEN m + h < 0 THEN 'better' WHEN m - h > 0 THEN 'worse' ELSE 'inconclusive' END AS verdict FROM s",
)
def verdict(spark, d):
    """Verdicts by the sign of an interval, here the normal one, which SQL can check."""
    s = _pairs(spark, d).groupBy("cell").agg(F.count("difference").alias("n"), F.avg("difference").alias("m"), (F.stddev_samp("difference") * 1.96 / F.sqrt(F.count("difference"))).alias("h"))
    return s.select("cell", p.verdict(F.col("m") - F.col("h"), F.col("m") + F.col("h"), F.col("n")).alias("verdict"))


@query(
    "guarded_verdict",
    f"{PAIRS}, s AS (SELECT cell, count(d) AS n, avg(d) AS m, 0.2 * stddev_samp(d) / sqrt(count(d)) AS h, avg(d) FILTER (seed % 10 = 0) AS held, avg(d) FILTER (seed % 7 = 0) AS rare FROM q GROUP BY 1) SELECT cell, CASE WHEN n < 3 OR h IS NULL THEN 'insufficient' WHEN m + h < 0 AND held <= 0 AND rare <= 0 THEN 'better' WHEN m - h > 0 THEN 'worse' ELSE 'inconclusive' END AS verdict FROM s",
)
def guarded_verdict(spark, d):
    """A better interval that held-out or rare rows contradict stays inconclusive."""
    d_ = F.col("difference")
    on = lambda k: F.avg(F.when(F.col("seed") % k == 0, d_))
    s = _pairs(spark, d).groupBy("cell").agg(F.count(d_).alias("n"), F.avg(d_).alias("m"), (F.stddev_samp(d_) * 0.2 / F.sqrt(F.count(d_))).alias("h"), on(10).alias("held"), on(7).alias("rare"))
    return s.select("cell", p.verdict(F.col("m") - F.col("h"), F.col("m") + F.col("h"), F.col("n"), guards=(F.col("held"), F.col("rare"))).alias("verdict"))


@query(
    "reference_pairs",
    "SELECT a.o_orderpriority AS cell, count(*) AS pairs, round(avg(a.o_totalprice - b.o_totalprice / 2), 4) AS mean_difference FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey AND b.o_orderkey % 3 = 0 GROUP BY 1",
)
def reference_pairs(spark, d):
    """Runs beside a reference arm that lacks two of three seeds."""
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("cell"), F.col("o_orderkey").alias("seed"), "o_totalprice")
    reference = runs.where("seed % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") / 2)
    found = p.reference_pairs(runs, reference, ["cell"], "seed", "o_totalprice").groupBy("cell").agg(F.count("*").alias("pairs"), F.avg("difference").alias("mean_difference"))
    return rounded(found, 4)


@query("bootstrap_interval")
def bootstrap_interval(spark, d):
    """Bootstrap intervals by hashed draws; tests hold them against a loop."""
    return p.bootstrap_interval(_pairs(spark, d), ["cell"], 500)


@query("arm_means", "SELECT o_orderpriority AS arm, count(*) AS runs, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM orders GROUP BY 1")
def arm_means(spark, d):
    """Means by arm."""
    return rounded(p.arm_means(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "arm"), ["arm"], ["o_totalprice"]), 4)


STRATA = "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), s AS (SELECT l_tax, CAST(CASE WHEN (l_quantity - lo) / (hi - lo) * 12 <= 0 THEN 0 ELSE least(floor((l_quantity - lo) / (hi - lo) * 12), 11) END AS INTEGER) AS stratum FROM lineitem, e)"


@query("stratum_assign", f"{STRATA} SELECT stratum, count(*) AS n FROM s GROUP BY 1")
def stratum_assign(spark, d):
    """Equal-width strata."""
    return p.strata(table(spark, d, "lineitem"), "l_quantity", 12).groupBy("stratum").agg(F.count("*").alias("n"))


@query("rare_strata_mse", f"{STRATA} SELECT stratum, count(*) AS n, round(avg(l_tax * l_tax), 6) AS mse, count(*) / (SELECT count(*) FROM s) < 0.083 AS rare FROM s GROUP BY 1")
def rare_strata_mse(spark, d):
    """Error by stratum and which are rare."""
    return rounded(p.rare_strata(p.strata(table(spark, d, "lineitem"), "l_quantity", 12), "l_tax", 0.083))


@query("stratum_means", "SELECT label, CAST(position AS INTEGER) AS stratum, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings) GROUP BY 1, 2")
def stratum_means(spark, d):
    """Means of a per-stratum array."""
    return rounded(p.stratum_means(table(spark, d, "embeddings"), ["label"], "embedding"))


@query(
    "easy_skip_select",
    "WITH n AS (SELECT count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS g FROM events), s AS (SELECT greatest(n - round(n * 0.4) - g, 0) AS slots FROM n), r AS (SELECT event_id, event_id % 50 = 0 AS protected, row_number() OVER (PARTITION BY event_id % 50 = 0 ORDER BY value DESC, event_id) AS k FROM events) SELECT event_id FROM r, s WHERE protected OR k <= slots",
)
def easy_skip_select(spark, d):
    """Protected and hardest records; without revisits the choice has no draw."""
    rows = table(spark, d, "events").withColumn("protected", F.col("event_id") % 50 == 0)
    return p.easy_skip(rows, "event_id", "value", 0.4, 0.0).where("keep").select("event_id")


@query(
    "axis_shapes",
    """WITH x AS (SELECT p_partkey, 1.0 AS base, 1 + (p_size - 25) * 1e-3 AS a, 1 - (p_size - 25) * 1e-3 + (p_partkey % 7) * 1e-3 AS b, 1 + (p_size - 25) * 5e-4 AS ah, 1 - (p_size - 25) * 5e-4 + (p_partkey % 7) * 2.5e-4 AS bh FROM part),
c AS (SELECT CASE WHEN abs(a - base) <= 1e-6 AND abs(b - base) <= 1e-6 THEN 'flat' WHEN abs(a - base) <= 1e-6 OR abs(b - base) <= 1e-6 THEN 'edge' WHEN abs(a + b - 2 * base) <= 1e-9 THEN 'indeterminate' WHEN ah + bh - 2 * base = 0 OR sign(ah + bh - 2 * base) <> sign(a + b - 2 * base) THEN 'kinked' WHEN abs((a + b - 2 * base) / (ah + bh - 2 * base) / 4 - 1) > 0.25 THEN 'kinked' ELSE 'smooth' END AS shape FROM x)
SELECT shape, count(*) AS n FROM c GROUP BY 1""",
)
def axis_shapes(spark, d):
    """Shapes of loss along axes."""
    t, m = (F.col("p_size") - 25) * 1e-3, F.col("p_partkey") % 7
    rows = table(spark, d, "part").select(F.lit(1.0).alias("base"), (F.lit(1) + t).alias("plus"), (F.lit(1) - t + m * 1e-3).alias("minus"), (F.lit(1) + (F.col("p_size") - 25) * 5e-4).alias("plus_half"), (F.lit(1) - (F.col("p_size") - 25) * 5e-4 + m * 2.5e-4).alias("minus_half"))
    return p.axis_shapes(rows).groupBy("shape").agg(F.count("*").alias("n"))


@query(
    "landscape_cells",
    "SELECT p_brand AS family, count(*) AS runs, sum(p_size % 2) AS flat, sum(p_size % 3) AS edge, sum(p_size % 4) AS kinked, sum(p_size % 5) AS smooth, sum(p_size % 6) AS indeterminate, count(*) FILTER (p_size = 13) AS failures FROM part GROUP BY 1",
)
def landscape_cells(spark, d):
    """Shape totals by cell."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("family"), *[(F.col("p_size") % k).alias(n) for k, n in ((2, "flat"), (3, "edge"), (4, "kinked"), (5, "smooth"), (6, "indeterminate"))], F.when(F.col("p_size") == 13, "failed").alias("error"))
    return p.landscape_cells(rows, ["family"])


@query(
    "influential_axes",
    "WITH r AS (SELECT p_brand, p_partkey AS axis, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, axis, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY axis) AS INTEGER) AS place FROM r WHERE k <= 10",
)
def influential_axes(spark, d):
    """The axes that change most, in index order."""
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("axis"), F.col("p_retailprice").alias("change"))
    return p.influential_axes(rows, ["p_brand"], 10).select("p_brand", "axis", "place")


@query("plateau_axes", "SELECT p_brand, count(*) FILTER (p_size % 9 = 0) AS plateau_axes, count(*) AS axes FROM part GROUP BY 1")
def plateau_axes(spark, d):
    """Axes that change nothing."""
    return p.plateau_axes(table(spark, d, "part").select("p_brand", (F.col("p_size") % 9).alias("change")), ["p_brand"])


@query("corpus_totals", "SELECT source, count(*) AS files, sum(n_chars) AS chars FROM documents GROUP BY 1")
def corpus_totals(spark, d):
    """Files and sizes."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("tolerance_pairs", "SELECT count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= 0.05 * greatest(abs(b.o_totalprice), 1)")
def tolerance_pairs(spark, d):
    """Agreement within relative bounds, inside a key."""
    from quarry.functions.scalars import parity_agrees

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    a, b = o.alias("a"), o.alias("b")
    near = parity_agrees(F.col("a.o_totalprice"), F.col("b.o_totalprice"), 0.0, 0.05)
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & near).agg(F.count("*").alias("pairs"))
