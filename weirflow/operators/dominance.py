"""Dominator trees of all graphs at once, as intervals: what dominates a node is an interval that holds its place.

A tree has one row per reached node: (g, node, idom, depth, pre, last). pre is the place in pre-order, siblings in order
of names, and last that of the last node below, so d dominates n where d.pre <= n.pre <= d.last. No table of pairs is
made on the way.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from weirflow.plans.fixpoint import discard, grow, jump, settled, shuffled, together
from weirflow.plans.scan import HOT_ROWS, latest, previous, running, total

#: Graphs of so many nodes at most are solved within one row each: sets of their nodes are bits of a long, whose sign bit is left.
SMALL = 63


def shortest_paths(links: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, path): each node that starts(keys, node) reach over links(g, node, dst), with the first of its shortest paths in order of names.

    Nodes of a level are in the order in which a breadth-first search meets them if they are in order of their paths.
    A round a level; only the newest level is joined.
    """
    links = settled(links.select("g", "node", "dst").where("node <> dst").distinct())
    level = settled(starts.select(*keys, "node").distinct().withColumn("path", F.array("node")))
    known, parts = level, [level]
    for done in itertools.count(1):
        ahead = level.join(links, ["g", "node"]).select(*keys, F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        level = settled(ahead.groupBy(*keys, "node").agg(F.min("path").alias("path")).join(known.select(*keys, "node"), [*keys, "node"], "left_anti"))
        if level.isEmpty():
            return known
        known = together(known, level)
        parts.append(level)
        if not done % 16:
            known = settled(known)
            discard(*parts[:-1])
            parts = [level, known]
    raise AssertionError


def dominators(edges: DataFrame, entries: DataFrame, small: int = SMALL) -> DataFrame:
    """The dominator tree (g, node, idom, depth, pre, last) of edges(g, src, dst) from entries(g, node).

    d dominates n if every way from an entry to n leads over d. idom is the nearest other one, null where there is none,
    as for an entry. Nodes that are not reached are absent.

    Graphs of up to small nodes are solved in a row each, by bits. Of larger ones, nodes with one predecessor are drawn
    into it, all at once and as long as that makes the graphs smaller: straight runs, branches that meet again and
    loops fold up in rounds that follow their nesting, not their length. What can't be folded, a loop with two ways
    in, goes to a fixpoint over shortest paths, whose straight runs are drawn together before.
    """
    plain = settled(edges.select("g", "src", "dst").where("src <> dst").distinct())
    starts = settled(entries.select("g", "node").distinct())
    ends = plain.select("g", F.col("src").alias("node")).union(plain.select("g", F.col("dst").alias("node"))).union(starts).distinct()
    sizes = settled(ends.groupBy("g").agg(F.count("*").alias("_n")))
    large = settled(sizes.where(F.col("_n") > small).select("g"))
    if large.isEmpty():
        return settled(_small_trees(plain, ends, starts))
    rest = sizes.where(F.col("_n") <= small).select("g")
    of = lambda df, graphs: df.join(graphs, "g", "left_semi")
    trees = settled(_small_trees(of(plain, rest), of(ends, rest), of(starts, rest)))
    return together(trees, settled(labelled(_large_idoms(settled(of(plain, large)), settled(of(starts, large))))))


def _small_trees(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Trees of graphs whose nodes are bits: a node's dominators are itself and what all its predecessors have in common.

    That holds after as many steps as there are nodes, as a way around a node has fewer. Everything of a graph is in
    its row, so there are no rounds.
    """
    members = nodes.join(starts.withColumn("_start", F.lit(True)), ["g", "node"], "left").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("node", F.col("_start").isNotNull().alias("start")))).alias("m"))
    ways = edges.groupBy("g").agg(F.collect_list(F.struct("src", "dst")).alias("e"))
    rows = members.join(ways, "g", "left").where(F.exists("m", lambda x: x["start"]))
    place = lambda name: (F.array_position(F.col("names"), name) - 1).cast("int")
    rows = rows.withColumn("names", F.transform("m", lambda x: x["node"])).withColumn("pairs", F.coalesce(F.transform("e", lambda x: F.struct(place(x["src"]).alias("s"), place(x["dst"]).alias("d"))), F.array().cast("array<struct<s:int,d:int>>")))
    ids = F.sequence(F.lit(0), F.size("names") - 1)
    into = F.transform(ids, lambda v: F.transform(F.filter("pairs", lambda x: x["d"] == v), lambda x: x["s"]))
    rows = rows.select("g", "names", F.transform("m", lambda x: x["start"]).alias("start"), ids.alias("ids"), into.alias("into"))
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v)
    every = F.lit(-1).cast("long")

    def step(sets: Column, _: Column) -> Column:
        common = lambda v: F.aggregate(F.get("into", v), every, lambda m, p: m.bitwiseAND(F.get(sets, p)))
        return F.transform("ids", lambda v: bit(v).bitwiseOR(F.when(F.get("start", v), F.lit(0).cast("long")).otherwise(common(v))))

    first = F.transform("ids", lambda v: F.when(F.get("start", v), bit(v)).otherwise(every))
    rows = rows.select("g", "names", "ids", F.aggregate("ids", first, step).alias("sets"))
    has = lambda sets, v: F.get("sets", sets).bitwiseAND(bit(v)) != 0
    deep = lambda v: F.bit_count(F.get("sets", v))
    path = lambda v: F.transform(F.array_sort(F.transform(F.filter("ids", lambda d: has(v, d)), lambda d: F.struct(deep(d).alias("n"), d.alias("d")))), lambda x: F.get("names", x["d"]))
    below = lambda v: F.size(F.filter("ids", lambda u: (F.get("sets", u) != every) & has(u, v)))
    reached = F.filter("ids", lambda v: F.get("sets", v) != every)
    each = rows.select("g", F.explode(F.transform(reached, lambda v: F.struct(F.get("names", v).alias("node"), path(v).alias("path"), below(v).alias("below")))).alias("x")).select("g", "x.*")
    pre = (F.row_number().over(Window.partitionBy("g").orderBy("path")) - 1).cast("long")
    placed = each.withColumn("pre", pre)
    return placed.select("g", "node", F.get("path", F.size("path") - 2).alias("idom"), (F.size("path") - 1).cast("long").alias("depth"), "pre", (F.col("pre") + F.col("below") - 1).alias("last"))


def _large_idoms(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(g, node, idom) of graphs of any size: folded as far as that goes, the others by the fixpoint."""
    found, left = _folded(edges, starts)
    if left.isEmpty():
        return found
    of = lambda df, how: df.join(left, "g", how)
    return of(found, "left_anti").unionByName(_by_paths(settled(of(edges, "left_semi")), settled(of(starts, "left_semi"))))


def _folded(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, node, idom) by folding, and the graphs (g) for which that isn't all.

    A node that only one other leads to is dominated by it. Drawn into it with all that was drawn in before, the pair
    makes a region, whose tree is known; a node that one region leads to, by whatever exits, has as idom the exits'
    lowest common ancestor in the region's tree.
    """
    several = starts.groupBy("g").count().where("count > 1").select("g")  # no tree with one root
    heads = starts.join(several, "g", "left_anti")
    ways = edges.join(several, "g", "left_anti").join(heads.withColumnRenamed("node", "dst"), ["g", "dst"], "left_anti")
    ways = settled(ways.select("g", F.col("src").alias("exit"), "src", "dst"))
    parents = settled(heads.select("g", "node", F.col("node").alias("idom")).where("false"))
    while True:
        into = ways.groupBy("g", "dst").agg(F.min("src").alias("src"), F.max("src").alias("_other"), F.min("exit").alias("exit"), F.max("exit").alias("_last"))
        single = settled(into.where(F.col("src") == F.col("_other")).select("g", F.col("dst").alias("node"), "src", "exit", "_last"))
        drawn, open_ = single.count(), ways.select("g", "dst").distinct().count()
        if not drawn:
            break
        tops = settled(jump(single.select("g", "node", F.col("src").alias("next"))))
        sound = tops.where("steps is not null").select("g", "node", "top")  # a circle that nothing leads into is not reached
        known = single.where(F.col("exit") == F.col("_last")).select("g", "node", F.col("exit").alias("idom"))
        many = ways.join(single.where("exit <> _last").select("g", F.col("node").alias("dst")), ["g", "dst"], "left_semi").select("g", F.col("dst").alias("key"), F.col("exit").alias("node"))
        met = common_ancestors(many, parents).select("g", F.col("key").alias("node"), F.col("node").alias("idom"))
        parents = settled(parents.unionByName(known.unionByName(met).join(sound.select("g", "node"), ["g", "node"], "left_semi")))
        circles = tops.where("steps is null").select("g", F.col("node").alias("src"))
        outer = ways.join(single.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti").join(circles, ["g", "src"], "left_anti")
        moved = outer.join(sound.withColumnRenamed("node", "src"), ["g", "src"], "left").select("g", "exit", F.coalesce("top", "src").alias("src"), "dst").where("src <> dst")
        ways = settled(moved)
        entered = ways.select("g", F.col("dst").alias("src")).union(heads.select("g", F.col("node").alias("src"))).distinct()
        ways = settled(ways.join(entered, ["g", "src"], "left_semi"))
        if drawn * 8 < open_:
            break
    left = ways.select("g").union(several).distinct()
    # a node that hangs on one that isn't reached is not reached
    hung = settled(jump(parents.select("g", "node", F.col("idom").alias("next"))))
    rooted = hung.join(heads.select("g", F.col("node").alias("top")), ["g", "top"], "left_semi").select("g", "node")
    return settled(parents.join(rooted, ["g", "node"], "left_semi").unionByName(heads.select("g", "node", F.lit(None).cast(parents.schema["idom"].dataType).alias("idom")))), settled(left)


def _ancestors(parents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """parents(g, node, up) at distances 1, 2, 4, ... as far as there are any, and (g, node, depth) of all that have one."""
    steps = settled(jump(parents.select("g", "node", F.col("up").alias("next"))).select("g", "node", F.col("steps").alias("depth")))
    deepest = steps.agg(F.max("depth")).first()[0] or 0
    levels = [parents]
    while 1 << len(levels) <= deepest:
        last = levels[-1]
        levels.append(settled(last.join(last.select("g", F.col("node").alias("up"), F.col("up").alias("_up")), ["g", "up"]).select("g", "node", F.col("_up").alias("up"))))
    return levels, steps


def common_ancestors(sets: DataFrame, parents: DataFrame) -> DataFrame:
    """(g, key, node): the lowest common ancestor of each key's nodes of sets(g, key, node), by parents(g, node, idom).

    All nodes of a key are in one tree; a node counts as its own ancestor. They are lifted to one depth, and then by
    falling powers of two as long as they don't meet.
    """
    now = settled(sets.select("g", "key", "node").distinct())
    if now.isEmpty():
        return now
    levels, depth = _ancestors(settled(parents.select("g", "node", F.col("idom").alias("up"))))
    now = now.join(depth, ["g", "node"], "left").select("g", "key", "node", F.coalesce("depth", F.lit(0)).alias("depth"))
    now = now.join(now.groupBy("g", "key").agg(F.min("depth").alias("_least")), ["g", "key"]).select("g", "key", "node", (F.col("depth") - F.col("_least")).alias("_by"))
    for k, level in enumerate(levels):
        lifted = now.join(level, ["g", "node"], "left")
        now = settled(lifted.select("g", "key", F.when(F.col("_by").bitwiseAND(1 << k) != 0, F.col("up")).otherwise(F.col("node")).alias("node"), "_by").distinct())
    now = now.select("g", "key", "node").distinct()
    apart = lambda rows, c: rows.groupBy("g", "key").agg((F.min(c) != F.max(c)).alias("_apart"))
    for level in reversed(levels):
        lifted = settled(now.join(level, ["g", "node"], "left"))
        now = settled(lifted.join(apart(lifted, "up"), ["g", "key"]).select("g", "key", F.when(F.col("_apart"), F.col("up")).otherwise(F.col("node")).alias("node")).distinct())
    lifted = now.join(apart(now, "node"), ["g", "key"]).join(levels[0], ["g", "node"], "left")
    return settled(lifted.select("g", "key", F.when(F.col("_apart"), F.col("up")).otherwise(F.col("node")).alias("node")).distinct())


def straight_runs(edges: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (g, node, next) from a node back to the only one before it, which leads nowhere else, and (g, node, head, place) of such runs.

    edges(g, src, dst) are distinct. heads(g, node) begin runs of their own, and so does every node of a circle that is
    all one run. Runs of one node have no row. Log rounds, whatever the length of the runs.
    """
    out = edges.groupBy("g", "src").agg(F.count("*").alias("_out"))
    into = edges.groupBy("g", "dst").agg(F.count("*").alias("_in"))
    found = edges.where("src <> dst").join(out.where("_out = 1"), ["g", "src"]).join(into.where("_in = 1"), ["g", "dst"])
    if heads is not None:
        found = found.join(heads.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti")
    found = settled(found.select("g", F.col("dst").alias("node"), F.col("src").alias("next")))
    runs = settled(jump(found).where("steps is not null").select("g", "node", F.col("top").alias("head"), F.col("steps").alias("place")))
    return settled(found.join(runs.select("g", "node"), ["g", "node"], "left_semi")), runs


def _by_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(g, node, idom) by a fixpoint over shortest paths of what is left when straight runs are drawn together.

    The nodes on one shortest path are all that can dominate a node. Those are taken away that do not dominate a
    predecessor, and the edges followed from each that goes. Rows are as many as the paths of the drawn graphs are long,
    rounds as many as the longest is.
    """
    straight, runs = straight_runs(edges, starts)
    head = runs.select("g", F.col("node").alias("src"), F.col("head").alias("_head"))
    drawn = edges.join(straight.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti").join(head, ["g", "src"], "left")
    drawn = settled(drawn.select("g", F.coalesce("_head", "src").alias("src"), "dst").where("src <> dst").distinct())
    paths = settled(shortest_paths(drawn.withColumnRenamed("src", "node"), starts, ["g"]))
    above = settled(paths.select("g", F.col("node").alias("n"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("d")))
    reached = paths.select("g", "node")
    links = drawn.join(reached.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").select("g", F.col("src").alias("n"), "dst")
    links = settled(links)
    seed = links.join(above.withColumnRenamed("n", "dst"), ["g", "dst"]).where("d <> n").join(above, ["g", "n", "d"], "left_anti").select("g", "d", F.col("dst").alias("n"))
    lost = grow(seed, lambda new, _: new.join(links, ["g", "n"]).where("dst <> d").select("g", "d", F.col("dst").alias("n")).join(above, ["g", "d", "n"], "left_semi"))
    kept = settled(above.select("g", "d", "n").join(lost, ["g", "d", "n"], "left_anti"))
    deep = kept.groupBy("g", F.col("n").alias("d")).agg(F.count("*").alias("_own"))
    nearest = kept.join(deep, ["g", "d"], "left").groupBy("g", F.col("n").alias("node")).agg(F.max_by("d", F.coalesce("_own", F.lit(0))).alias("idom"))
    tails = runs.groupBy("g", F.col("head").alias("idom")).agg(F.max_by("node", "place").alias("_tail"))
    heads = reached.join(nearest, ["g", "node"], "left").join(tails, ["g", "idom"], "left").select("g", "node", F.coalesce("_tail", "idom").alias("idom"))
    within = straight.join(runs.select("g", "node", "head"), ["g", "node"]).join(reached.withColumnRenamed("node", "head"), ["g", "head"], "left_semi")
    return settled(heads.unionByName(within.select("g", "node", F.col("next").alias("idom"))))


def labelled(idoms: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(g, node, idom, depth, pre, last) of trees (g, node, idom), by a walk around each tree and list ranking.

    The walk enters and leaves each node once; a node's place is what pointer jumping finds to lie behind it. Roots of one
    graph follow one another. Log rounds, whatever the shape of the trees; a node of more than hot children has them cut
    into stretches.
    """
    idoms = settled(idoms.select("g", "node", "idom"))
    stop = lambda node, side: F.struct(node.alias("node"), F.lit(side).alias("side"))
    ends = idoms.where("idom is not null").groupBy("g", F.col("idom").alias("node")).agg(F.min("node").alias("_child"), F.max("node").alias("_last"))
    at = idoms.join(ends.select("g", "node", "_child"), ["g", "node"], "left")
    enter = at.select("g", stop(F.col("node"), 0).alias("node"), F.when(F.col("_child").isNotNull(), stop(F.col("_child"), 0)).otherwise(stop(F.col("node"), 1)).alias("next"))
    # a sibling, or a root, is entered from the one before it; the last child leads back to its parent
    beside = running(idoms, ["g", "idom"], ["node"], hot, _before=previous(F.col("node"))).where("_before is not null")
    leave = beside.select("g", stop(F.col("_before.v"), 1).alias("node"), stop(F.col("node"), 0).alias("next")).unionByName(
        ends.select("g", stop(F.col("_last"), 1).alias("node"), stop(F.col("node"), 1).alias("next"))
    )
    up = idoms.where("idom is not null").select("g", stop(F.col("node"), 2).alias("node"), stop(F.col("idom"), 2).alias("next"))
    ranked = settled(jump(enter.unionByName(leave).unionByName(up)).select("g", "node.node", "node.side", "steps"))
    places = ranked.groupBy("g", "node").agg(*(F.max(F.when(F.col("side") == i, F.col("steps"))).alias(c) for i, c in enumerate(("_enter", "_leave", "depth"))))
    length = ranked.where("side = 0").groupBy("g").agg(F.max("steps").alias("_all"))
    rows = idoms.join(places, ["g", "node"]).join(length, "g").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    pre = F.floor((F.col("_all") - F.col("_enter") + F.col("depth")) / 2)
    return rows.select("g", "node", "idom", "depth", pre.alias("pre"), (pre + F.floor((F.col("_enter") - F.coalesce("_leave", F.lit(0)) + 1) / 2) - 1).alias("last"))


def immediate_dominators(tree: DataFrame) -> DataFrame:
    """(g, node, idom, depth): the strict dominator that has most dominators itself; null for the entry, whose depth is 0."""
    return tree.select("g", "node", "idom", "depth")


def dominance_pairs(tree: DataFrame) -> DataFrame:
    """(g, d, n): d dominates n, each node itself included. As many rows as depths add up to: for reports on small graphs."""
    own = settled(tree.select("g", F.col("node").alias("d"), F.col("node").alias("n")))
    return _climbed(own, tree, lambda rows: rows)


def _climbed(rows: DataFrame, tree: DataFrame, within) -> DataFrame:
    """rows(g, d, ...) with d's ancestors in place of d too, as far as within(rows) leaves them: by doubled steps, in log rounds."""
    up = settled(tree.where("idom is not null").select("g", F.col("node").alias("d"), F.col("idom").alias("_up")))
    while True:
        higher = rows.join(up, ["g", "d"]).withColumn("d", F.col("_up")).drop("_up")
        higher = settled(within(higher).distinct().join(rows, rows.columns, "left_anti").select(*rows.columns))
        if higher.isEmpty():
            return rows
        rows = settled(rows.unionByName(higher))
        up = settled(up.join(up.select("g", F.col("d").alias("_up"), F.col("_up").alias("_far")), ["g", "_up"]).select("g", "d", F.col("_far").alias("_up")))


def with_dominance(rows: DataFrame, tree: DataFrame, d: str, n: str, name: str = "_over") -> DataFrame:
    """rows(g, ...) with name: whether the node in column d dominates that in column n; false where either is not reached."""
    upper = tree.select("g", F.col("node").alias(d), F.col("pre").alias("_from"), F.col("last").alias("_to"))
    lower = tree.select("g", F.col("node").alias(n), F.col("pre").alias("_at"))
    held = F.coalesce(F.col("_at").between(F.col("_from"), F.col("_to")), F.lit(False))
    return rows.join(upper, ["g", d], "left").join(lower, ["g", n], "left").withColumn(name, held).drop("_from", "_to", "_at")


def nearest_above(probes: DataFrame, marks: DataFrame, tree: DataFrame, keys: list[str], value: str, strict: bool = False) -> DataFrame:
    """probes(g, keys, node) with value: that of the nearest of marks(g, keys, node, value) which dominates the node, and how many do.

    With strict, a mark at the node itself doesn't count. marks have one row per g, keys and node. Of intervals that lie
    within one another, the innermost around a place is the last one begun of those as deep as the place. So there is
    one order of intervals' ends and probes, a running count of what is open, and a last value per count.
    """
    group = ["g", *keys]
    place = tree.select("g", "node", "pre", "last")
    kind = marks.schema[value].dataType
    opened = marks.select(*group, "node", value).join(place, ["g", "node"])
    none = F.lit(None).cast(kind)
    node = F.lit(None).cast(probes.schema["node"].dataType)
    turn = {"end": 0, "probe": 1 if strict else 2, "start": 2 if strict else 1}
    events = [
        opened.select(*group, node.alias("node"), F.col("pre").alias("_at"), F.lit(turn["start"]).alias("_turn"), F.lit(1).alias("_step"), F.col(value).alias("_value"), F.lit(True).alias("_mark")),
        opened.select(*group, node.alias("node"), (F.col("last") + 1).alias("_at"), F.lit(turn["end"]).alias("_turn"), F.lit(-1).alias("_step"), none.alias("_value"), F.lit(True).alias("_mark")),
        probes.select(*group, "node").distinct().join(place, ["g", "node"]).select(*group, "node", F.col("pre").alias("_at"), F.lit(turn["probe"]).alias("_turn"), F.lit(0).alias("_step"), none.alias("_value"), F.lit(False).alias("_mark")),
    ]
    order = ("_at", "_turn")
    counted = running(functools.reduce(DataFrame.unionByName, events), group, list(order), _open=total(F.col("_step")))
    begun = F.when(F.col("_step") == 1, F.struct(F.col("_value").alias("v")))
    seen = running(counted, [*group, "_open"], list(order), _inner=latest(begun)).where(~F.col("_mark") & (F.col("_open") > 0)).select(*group, "node", F.col("_inner.v").alias(value), F.col("_open").alias("n_above"))
    return probes.join(shuffled(seen), [*group, "node"], "left")


def dominance_frontier(edges: DataFrame, tree: DataFrame, min_preds: int = 2) -> DataFrame:
    """(g, d, n): d dominates a predecessor of n but not n strictly; n has min_preds edges in or more.

    From each predecessor upwards all are in it that are no higher than n itself in the tree.
    """
    depth = tree.select("g", F.col("node").alias("n"), F.col("depth").alias("_n_depth"))
    joins = edges.groupBy("g", F.col("dst").alias("n")).agg(F.count("*").alias("_in")).where(F.col("_in") >= min_preds).select("g", "n").join(depth, ["g", "n"])
    own = tree.select("g", F.col("node").alias("d"), "depth")
    within = lambda rows: rows.join(own, ["g", "d"]).where(F.col("depth") >= F.col("_n_depth")).drop("depth")
    seed = edges.select("g", F.col("src").alias("d"), F.col("dst").alias("n")).distinct().join(joins, ["g", "n"]).select("g", "d", "n", "_n_depth")
    return _climbed(settled(within(seed).select("g", "d", "n", "_n_depth")), tree, within).select("g", "d", "n")


def back_edges(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(g, src, dst) whose target dominates their source, edges to itself included."""
    return with_dominance(edges.select("g", "src", "dst").distinct(), tree, "dst", "src").where("_over").drop("_over").select("g", "src", "dst")
