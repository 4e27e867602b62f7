"""Where two ways of a graph meet again, for all pairs of all graphs at once: searches from both ends that stop pair by pair."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from weirflow.operators.dominance import SMALL
from weirflow.operators.joins import as_of
from weirflow.plans.fixpoint import discard, settled
from weirflow.plans.scan import running, total

_PAIR = ["g", "a", "b"]


def merge_point(
    edges: DataFrame, branches: DataFrame, returns: DataFrame | None = None, back: DataFrame | None = None, dom: DataFrame | None = None, small: int = SMALL
) -> DataFrame:
    """branches(g, a, b) with merge, the node where the two ways meet again.

    a if both are one; null if both are returns(g, node), the other one if one is; b if a reaches it; else the first
    node that a breadth-first search from b meets, successors in order of names, of those that a reaches; null if there
    is none. Edges in back(g, src, dst), those of loops, are not followed.

    Graphs of up to small nodes are searched within one row each, by bits. In larger ones both ends search in turn. With
    dom, the tree whose loops back holds, they end where what they look for can't lie ahead, so a pair costs what lies
    between its ends and where they meet, not all behind them. Their rounds are as many as the longer way to the meeting
    point has steps.
    """
    pairs = settled(branches.select(*_PAIR).distinct())
    links = edges.select("g", F.col("src").alias("node"), "dst").where("src <> dst").distinct()
    if back is not None:
        links = links.join(back.select("g", F.col("src").alias("node"), "dst").distinct(), ["g", "node", "dst"], "left_anti")
    links = settled(links)
    rows, ends = pairs, [F.lit(False), F.lit(False)]
    if returns is not None:
        for i, side in enumerate("ab"):
            rows = rows.join(returns.select("g", F.col("node").alias(side)).distinct().withColumn(f"_{side}", F.lit(True)), ["g", side], "left")
            ends[i] = F.coalesce(f"_{side}", F.lit(False))
    asked = settled(rows.where((F.col("a") != F.col("b")) & ~ends[0] & ~ends[1]).select(*_PAIR))
    sizes = links.select("g", "node").union(links.select("g", "dst")).distinct().groupBy("g").count()
    large = settled(sizes.where(F.col("count") > small).select("g"))
    if large.isEmpty():
        met = _met_in_rows(asked, links)
    else:
        of = lambda df, how: settled(df.join(large, "g", how))
        places = None if dom is None else topological_places(links, dom, small)
        met = _met_in_rows(of(asked, "left_anti"), of(links, "left_anti")).unionByName(_met(of(asked, "left_semi"), of(links, "left_semi"), places))
    merge = F.when(F.col("a") == F.col("b"), F.col("a")).when(ends[0] & ends[1], None).when(ends[0], F.col("b")).when(ends[1], F.col("a")).otherwise(F.col("_met"))
    return rows.join(met, _PAIR, "left").select(*_PAIR, merge.alias("merge"))


def _met_in_rows(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(g, a, b, _met) for small graphs, whose nodes are bits: a graph is one row, and its pairs search in it without rounds.

    A breadth-first search takes the nodes of its queue in turn and adds their successors that it doesn't hold yet, in
    order of names.
    """
    rows = links.groupBy("g").agg(F.collect_list(F.struct("node", "dst")).alias("e"))
    rows = rows.withColumn("names", F.array_sort(F.array_union(F.transform("e", lambda x: x["node"]), F.transform("e", lambda x: x["dst"]))))
    place = lambda name: (F.array_position(F.col("names"), name) - 1).cast("int")
    rows = rows.withColumn("ids", F.sequence(F.lit(0), F.size("names") - 1)).withColumn("ways", F.transform("e", lambda x: F.struct(place(x["node"]).alias("s"), place(x["dst"]).alias("d"))))
    to = F.transform("ids", lambda v: F.array_sort(F.transform(F.filter("ways", lambda x: x["s"] == v), lambda x: x["d"])))
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v)
    # Settled, as the optimizer would work out again, node by node, what is asked within a node's own step.
    rows = settled(settled(rows.select("g", "names", "ids", "ways")).select("g", "names", "ids", to.alias("to")))
    own = F.transform("ids", lambda v: F.aggregate(F.get("to", v), bit(v), lambda m, d: m.bitwiseOR(bit(d))))
    over = lambda sets, k: F.transform(sets, lambda m: F.when(m.bitwiseAND(bit(k)) != 0, m.bitwiseOR(F.get(sets, k))).otherwise(m))
    graphs = settled(rows.withColumn("reach", F.aggregate("ids", own, over)))
    both = pairs.join(graphs, "g").withColumn("_a", place(F.col("a"))).withColumn("_b", place(F.col("b"))).where("_a >= 0 and _b >= 0")
    both = both.withColumn("_from_a", F.get("reach", F.col("_a"))).where(F.col("_from_a").bitwiseAND(F.get("reach", F.col("_b"))) != 0)
    queue = F.aggregate("ids", F.array("_b"), lambda q, i: F.when(i < F.size(q), F.concat(q, F.array_except(F.get("to", F.get(q, i)), q))).otherwise(q))
    first = F.get(F.filter(queue, lambda v: F.col("_from_a").bitwiseAND(bit(v)) != 0), F.lit(0))
    return both.select(*_PAIR, F.get("names", first).alias("_met"))


def topological_places(links: DataFrame, tree: DataFrame, small: int = SMALL) -> DataFrame | None:
    """(g, node, place) of reached nodes of graphs of more than small: along all links(g, node, dst), places grow. None if there is no such graph.

    links are without those of loops. The places are a pre-order of the dominator tree in which a node comes behind
    its siblings from whose subtrees links lead to it; so rounds follow the longest chain of siblings, not the depth of
    the graph. A graph in which links run in a circle all the same, as a loop with two ways in, has no rows.
    """
    large = settled(tree.groupBy("g").count().where(F.col("count") > small).select("g"))
    if large.isEmpty():
        return None
    tree = settled(tree.join(large, "g", "left_semi"))
    source = tree.select("g", "node", "pre")
    target = tree.select("g", F.col("node").alias("dst"), F.col("idom").alias("_up"))
    crossing = links.join(target, ["g", "dst"]).join(source, ["g", "node"]).where("_up is null or _up <> node").select("g", "_up", "pre", "dst")
    children = tree.select("g", F.col("idom").alias("_up"), "pre", F.col("node").alias("_side"))
    beside = as_of(crossing, children, ["g", "_up"], "pre", "_side", None, True)  # the child whose subtree holds the source
    rest = settled(beside.where("_side <> dst").select("g", F.col("_side").alias("node"), "dst").distinct())
    behind, left = [], rest.count()
    while left:
        targets = settled(rest.select("g", F.col("dst").alias("node")).distinct())
        behind.append(targets)
        rest = settled(rest.join(targets, ["g", "node"], "left_semi"))
        before, left = left, rest.count()
        if left == before:
            break
    stuck = rest.select("g").distinct()  # without rows if all settled
    steps = tree.select("g", "node").where("false").withColumn("_level", F.lit(0).cast("long"))
    if behind:
        every = behind[0]
        for more in behind[1:]:
            every = every.unionByName(more)
        steps = settled(every.groupBy("g", "node").agg(F.count("*").alias("_level")))
    known = tree.join(stuck, "g", "left_anti").join(steps, ["g", "node"], "left")
    sized = known.select("g", "node", "idom", "pre", "last", F.coalesce("_level", F.lit(0).cast("long")).alias("_level"), (F.col("last") - F.col("pre") + 1).alias("_size"))
    shifted = running(sized, ["g", "idom"], ["_level", "pre"], _before=total(F.col("_size"), own=False))
    by = F.coalesce("_before", F.lit(0)) + 1
    begun = shifted.select("g", "node", F.col("pre").alias("_at"), F.lit(1).alias("_turn"), by.alias("_by"))
    over = shifted.select("g", "node", (F.col("last") + 1).alias("_at"), F.lit(0).alias("_turn"), (-by).alias("_by"))
    summed = running(settled(begun.unionByName(over)), ["g"], ["_at", "_turn"], place=total(F.col("_by")))
    return settled(summed.where("_turn = 1").select("g", "node", "place"))


def _met(pairs: DataFrame, links: DataFrame, places: DataFrame | None) -> DataFrame:
    """(g, a, b, _met) of pairs with a node that both ends reach: the first in the order of the search from b.

    A row of the state is a pair's node: s tells that a reaches it, d and o are the step and the order in which the
    search from b met it, _a and _b that a search goes on from it. A node that both searches know is a candidate; with
    one, the search from b ends, and that from a goes on only as long as an earlier node of b's may lie ahead.
    """
    none = F.lit(None).cast("long")
    if places is None:
        links, place_of = links.withColumn("r", none), lambda rows: rows.withColumn("r", none)
    else:
        links = settled(links.join(places.select("g", F.col("node").alias("dst"), F.col("place").alias("r")), ["g", "dst"], "left"))
        place_of = lambda rows: rows.join(places.withColumnRenamed("place", "r"), ["g", "node"], "left")
    yes, no = F.lit(True), F.lit(False)
    from_a = pairs.select(*_PAIR, F.col("a").alias("node"), yes.alias("s"), none.alias("d"), none.alias("o"), yes.alias("_a"), no.alias("_b"))
    from_b = pairs.select(*_PAIR, F.col("b").alias("node"), no.alias("s"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("o"), no.alias("_a"), yes.alias("_b"))
    columns = [*_PAIR, "node", "s", "d", "o", "r", "_a", "_b"]
    state = settled(place_of(from_a.unionByName(from_b)).select(*columns))
    results = []
    for done in itertools.count(1):
        judged = settled(_judged(state))
        discard(state)
        live = settled(judged.where("_a or _b").select(*_PAIR).distinct())
        results.append(settled(judged.join(live, _PAIR, "left_anti").where("_best is not null").groupBy(*_PAIR).agg(F.first("_best.node").alias("_met"))))
        if live.isEmpty():
            break
        kept = judged.join(live, _PAIR, "left_semi")
        ahead = kept.where("_a or _b").join(links.withColumnRenamed("r", "_r"), ["g", "node"])
        ahead = ahead.select(*_PAIR, F.col("dst").alias("node"), no.alias("s"), none.alias("d"), none.alias("o"), F.col("_r").alias("r"), F.col("_a").alias("_hit"), F.when(F.col("_b"), F.col("o")).alias("_by"))
        both = kept.select(*_PAIR, "node", "s", "d", "o", "r", no.alias("_hit"), none.alias("_by")).unionByName(ahead)
        grown = both.groupBy(*_PAIR, "node").agg(F.bool_or("s").alias("s"), F.min("d").alias("d"), F.min("o").alias("o"), F.max("r").alias("r"), F.bool_or("_hit").alias("_hit"), F.min("_by").alias("_by"))
        grown = grown.select(*_PAIR, "node", (F.col("s") | F.col("_hit")).alias("s"), "d", "o", "r", (F.col("_hit") & ~F.col("s")).alias("_a"), (F.col("_by").isNotNull() & F.col("d").isNull()).alias("_b"), "_by")
        grown = settled(grown)
        new = running(grown.where("_b").drop("o"), _PAIR, ["_by", "node"], o=total(F.lit(1).cast("long"))).withColumn("d", F.lit(done).cast("long"))
        state = settled(grown.where("not _b").select(*columns).unionByName(new.select(*columns)))
        discard(judged, grown, live)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    out = settled(out)
    discard(*results)
    return out


def _judged(state: DataFrame) -> DataFrame:
    """state with _best, a pair's candidate (d, o, node), null without one; _a and _b only where the searches have to go on."""
    place = lambda at: F.struct(F.col(f"{at}d").alias("d"), F.col(f"{at}o").alias("o"))
    best = state.where("s and d is not null").groupBy(*_PAIR).agg(F.min(F.struct("d", "o", "node")).alias("_best"))
    rows = state.join(best, _PAIR, "left")
    without = F.col("_best").isNull()
    wanted = F.col("d").isNotNull() & ~F.col("s") & (without | (place("") < place("_best.")))
    bounds = rows.groupBy(*_PAIR).agg(
        F.max(F.when(wanted, F.col("r"))).alias("_upto"), F.bool_or(wanted).alias("_some"), F.max(F.when(F.col("s"), F.col("r"))).alias("_far"), F.bool_or("_a").alias("_any_a"), F.bool_or("_b").alias("_any_b")
    )
    beyond: Column = F.coalesce(F.col("r") >= F.col("_upto"), F.lit(False))
    past: Column = F.coalesce(F.col("r") > F.col("_far"), F.lit(False))
    goes_a = F.when(without & F.col("_any_b"), True).otherwise(F.col("_some") & ~beyond)
    goes_b = without & (F.col("_any_a") | ~past)
    return rows.join(bounds, _PAIR).select(*_PAIR, "node", "s", "d", "o", "r", (F.col("_a") & goes_a).alias("_a"), (F.col("_b") & goes_b).alias("_b"), "_best")
