"""Graphs edges(g, src, dst): links, reach, dominators, loops and merge points, for all graphs at once."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from weirflow.operators.dataflow import first_access, liveness, span_access  # noqa: F401
from weirflow.operators.dominance import (  # noqa: F401 - the graph operators that callers know by this module
    back_edges, dominance_frontier, dominance_pairs, dominators, immediate_dominators, nearest_above, with_dominance,
)
from weirflow.operators.merging import merge_point  # noqa: F401
from weirflow.operators.segment import fallthrough
from weirflow.plans.fixpoint import discard, grow, jump, settled, shuffled
from weirflow.plans.scan import HOT_ROWS, running, total


def link_blocks(blocks: DataFrame, jumps: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """(g, src, dst, role): each block to the next one, unless it returns, and jumps(g, b, target_pc, conditional) to the block of their target.

    A conditional jump's target is the true side and its next block the false side; a plain jump has no next. A graph of
    more than hot blocks is cut into stretches.
    """
    j = jumps.select("g", "b", "target_pc", "conditional")
    heads = blocks.select("g", F.col("head_pc").alias("target_pc"), F.col("b").alias("dst"))
    taken = j.join(heads, ["g", "target_pc"]).select("g", F.col("b").alias("src"), "dst", F.when(F.col("conditional"), "true").otherwise("jump").alias("role"))
    following = fallthrough(blocks, hot).withColumnRenamed("next_b", "dst").where("dst is not null")
    next_ = following.join(j, ["g", "b"], "left").where("conditional is null or conditional")
    return taken.unionByName(next_.select("g", F.col("b").alias("src"), "dst", F.when(F.col("conditional"), "false").otherwise("next").alias("role")))


def number_links(links: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """links(g, src, dst, role) with ord, from 0 per src: a jump's side first, then the next block's; parallel edges each have their own.

    A node of more than hot links is cut into stretches.
    """
    sided = links.select("g", "src", "dst", "role", F.when(F.col("role").isin("true", "jump"), 0).otherwise(1).alias("_side"))
    rows = running(sided, ["g", "src"], ["_side", "dst", "role"], hot, _place=total(F.lit(1).cast("long")))
    return rows.select("g", "src", "dst", "role", (F.col("_place") - 1).alias("ord"))


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(g, node) reached from entries(g, node)."""
    pairs = settled(edges.select("g", F.col("src").alias("node"), "dst").distinct())
    return grow(entries.select("g", "node"), lambda new, _: new.join(pairs, ["g", "node"]).select("g", F.col("dst").alias("node")))


def prune(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges between reached nodes."""
    r = reached.select("g", "node")
    return edges.join(r.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(r.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi").select(*edges.columns)


def can_reach(edges: DataFrame, pairs: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """pairs(g, a, b) with reaches: whether b is reached from a over one edge or more, not going on behind stops(g, node)."""
    links = edges.select("g", F.col("src").alias("node"), "dst").distinct()
    if stops is not None:
        links = links.join(stops.select("g", "node").distinct(), ["g", "node"], "left_anti")
    links = settled(links)
    starts = pairs.select("g", "a").distinct()
    seed = starts.join(edges.select("g", F.col("src").alias("a"), F.col("dst").alias("node")), ["g", "a"]).select("g", "a", "node")
    reach = grow(seed, lambda new, _: new.join(links, ["g", "node"]).select("g", "a", F.col("dst").alias("node")))
    return pairs.join(reach.withColumnRenamed("node", "b").withColumn("_r", F.lit(True)), ["g", "a", "b"], "left").select("g", "a", "b", F.coalesce("_r", F.lit(False)).alias("reaches"))


def dominator_tree(tree: DataFrame) -> DataFrame:
    """(g, node, depth, rank, n_children, children): rank is the place in pre-order, children are names in order, comma-joined."""
    names = F.array_join(F.array_sort(F.collect_list("node")), ",")
    below = tree.where("idom is not null").groupBy("g", F.col("idom").alias("node")).agg(F.count("*").alias("n_children"), names.alias("children"))
    ranked = tree.select("g", "node", "depth", F.col("pre").alias("rank")).join(below, ["g", "node"], "left")
    return ranked.select("g", "node", "depth", "rank", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("children", F.lit("")).alias("children"))


def loops(edges: DataFrame, dom: DataFrame, records: DataFrame | None = None, for_kinds: dict[str, str] | None = None) -> DataFrame:
    """(g, header, latch, kind, exit), one row per header, that is per target of a back edge.

    kind: what for_kinds makes of the record that records(g, node, op) gives for the header - numeric, general, pairs
    or indexed; else repeat if the latch decides, or if the header decides and leads straight to the latch; else
    while. Of several latches one that makes a repeat holds before others, then the last by name.

    exit is the first by name of: the other successors of a latch that decides; the other successors of a header that
    leads straight to its latch; for while, the header's successors that don't dominate the latch; for the others,
    those of the latch's successors that it dominates. It is null where there is none.
    """
    plain = edges.select("g", "src", "dst").distinct()
    back = back_edges(plain, dom).select("g", F.col("dst").alias("header"), F.col("src").alias("latch"))
    width = plain.groupBy("g", F.col("src").alias("node")).agg(F.count("*").alias("_out"))
    out = lambda end: width.select("g", F.col("node").alias(end), F.col("_out").alias(f"_{end}_out"))
    straight = plain.select("g", F.col("src").alias("header"), F.col("dst").alias("latch"), F.lit(True).alias("_straight"))
    rows = back.join(out("latch"), ["g", "latch"]).join(out("header"), ["g", "header"]).join(straight, ["g", "header", "latch"], "left")
    named = F.lit(None).cast("string")
    if records is not None and for_kinds:
        rows = rows.join(shuffled(records.select("g", F.col("node").alias("header"), F.col("op").alias("_op"))), ["g", "header"], "left")
        for op, kind in for_kinds.items():
            named = F.when(F.col("_op") == op, kind).otherwise(named)
    decides = (F.col("_latch_out") > 1) & (F.col("latch") != F.col("header"))
    tested = (F.col("_header_out") > 1) & F.coalesce("_straight", F.lit(False)) & (F.col("latch") != F.col("header"))
    rows = rows.select("g", "header", "latch", F.coalesce(named, F.when(decides | tested, "repeat").otherwise("while")).alias("kind"), decides.alias("_decides"))
    best = F.max_by(F.struct("latch", "kind", "_decides"), F.struct((F.col("kind") == "repeat").alias("r"), "latch"))
    one = settled(rows.groupBy("g", "header").agg(best.alias("b")).select("g", "header", "b.*"))
    at_latch = (F.col("kind") != "while") & ((F.col("kind") != "repeat") | F.col("_decides"))
    ends = one.withColumn("src", F.when(at_latch, F.col("latch")).otherwise(F.col("header")))
    leaving = ends.join(plain, ["g", "src"]).where("dst <> header and dst <> latch")
    leaving = leaving.withColumn("d", F.when(F.col("kind") == "while", F.col("dst")).otherwise(F.col("latch"))).withColumn("n", F.when(F.col("kind") == "while", F.col("latch")).otherwise(F.col("dst")))
    leaving = with_dominance(leaving, dom, "d", "n").where("kind = 'repeat' or (kind = 'while') <> _over")
    return one.join(leaving.groupBy("g", "header").agg(F.min("dst").alias("exit")), ["g", "header"], "left").select("g", "header", "latch", "kind", "exit")


def innermost_loop(dom: DataFrame, headers: DataFrame) -> DataFrame:
    """(g, node, header, nesting): the deepest of headers(g, header) that dominates a node, and how many do."""
    marks = headers.select("g", F.col("header").alias("node")).distinct().withColumn("header", F.col("node"))
    return nearest_above(dom.select("g", "node"), marks, dom, [], "header").where("header is not null").select("g", "node", "header", F.col("n_above").alias("nesting"))


def classify_exits(edges: DataFrame, inner: DataFrame, looped: DataFrame, dom: DataFrame) -> DataFrame:
    """(g, src, dst, role) of edges in a loop, seen from the source's innermost header: break to its exit, continue to the header, inside or leave."""
    exits = looped.where("exit is not null").select("g", "header", F.col("exit").alias("dst")).distinct().withColumn("_exit", F.lit(True))
    rows = edges.select("g", "src", "dst").distinct().join(inner.select("g", F.col("node").alias("src"), "header"), ["g", "src"])
    rows = with_dominance(rows.join(exits, ["g", "header", "dst"], "left"), dom, "header", "dst", "_in")
    role = F.when(F.col("dst") == F.col("header"), "continue").when(F.col("_exit"), "break").when(F.col("_in"), "inside").otherwise("leave")
    return rows.select("g", "src", "dst", role.alias("role"))


def jump_roles(jumps: DataFrame, inner: DataFrame, looped: DataFrame, dom: DataFrame) -> DataFrame:
    """(g, src, dst, header, role) of forward plain jumps(g, src, dst) in a loop, by their source's innermost header.

    A jump to the loop's exit is a break, one to a node that the header dominates a continue, any other leaves.
    """
    exits = looped.where("exit is not null").select("g", "header", F.col("exit").alias("dst")).distinct().withColumn("_exit", F.lit(True))
    rows = jumps.select("g", "src", "dst").join(inner.select("g", F.col("node").alias("src"), "header"), ["g", "src"]).join(exits, ["g", "header", "dst"], "left")
    role = F.when(F.col("_exit"), "break").when(F.col("_in"), "continue").otherwise("leave")
    return with_dominance(rows, dom, "header", "dst", "_in").select("g", "src", "dst", "header", role.alias("role"))


def endless_loops(edges: DataFrame, dom: DataFrame, looped: DataFrame) -> DataFrame:
    """(g, node, latch) of loops without a test: nodes whose only edge leads to themselves, and headers of looped(g, header, latch) with a second latch that leads nowhere else.

    Of several such latches the first by name counts.
    """
    plain = edges.select("g", "src", "dst").distinct()
    alone = plain.groupBy("g", "src").agg(F.count("*").alias("_out"), F.min("dst").alias("dst")).where("_out = 1").select("g", "src", "dst")
    fused = alone.where("src = dst").select("g", F.col("src").alias("node"), F.col("src").alias("latch"))
    back = back_edges(alone.where("src <> dst"), dom)
    second = back.join(looped.select("g", F.col("header").alias("dst"), F.col("latch").alias("_known")), ["g", "dst"]).where("src <> _known")
    return fused.unionByName(second.groupBy("g", F.col("dst").alias("node")).agg(F.min("src").alias("latch")))


def _ways(links: DataFrame) -> DataFrame:
    """(g, node, way): the nodes from each node of links(g, node, next) to its end, both included, by doubling; there is no circle."""
    state = settled(links.select("g", "node", F.col("next").alias("end"), F.array("node").alias("way")))
    while True:
        ahead = state.select("g", F.col("node").alias("end"), F.col("end").alias("_end"), F.col("way").alias("_way"))
        following = state.join(ahead, ["g", "end"], "left")
        if state.join(ahead, ["g", "end"], "left_semi").isEmpty():
            return state.select("g", "node", F.array_append("way", F.col("end")).alias("way"))
        after = settled(following.select("g", "node", F.coalesce("_end", "end").alias("end"), F.when(F.col("_way").isNull(), F.col("way")).otherwise(F.concat("way", "_way")).alias("way")))
        discard(state)
        state = after


def shared_target_chains(decisions: DataFrame) -> DataFrame:
    """(g, head, target, n, links, otherwise) of chains of two or more decisions(g, node, on_true, on_false, comparison).

    All but the last of a chain lead to one target if true and to the next if false; the last leads to it if false, and
    otherwise is where it leads if true. All are comparisons. A chain that ends another way, or in a circle, is none.
    Found by pointer jumping, in log rounds; only chains that count get a list of their nodes.
    """
    known = settled(decisions.where("comparison and on_true is not null and on_false is not null").select("g", "node", "on_true", "on_false"))
    ahead = known.select("g", F.col("node").alias("on_false"), F.col("on_true").alias("_true"), F.col("on_false").alias("_false"))
    both = settled(known.join(ahead, ["g", "on_false"]))
    tops = settled(resolve_aliases(both.where("_true = on_true").select("g", "node", F.col("on_false").alias("next")), known).where("steps is not null"))
    # a link to itself is a circle of one
    last = both.where("_true <> on_true and _false = on_true and node <> on_false").select("g", F.col("node").alias("top"), F.col("on_false").alias("_end"), F.col("_true").alias("otherwise"))
    ended = tops.join(last, ["g", "top"])
    ended = settled(ended)
    inner = both.where("_true = on_true").select("g", "node", F.col("on_false").alias("next")).join(ended.select("g", "node"), ["g", "node"], "left_semi")
    rows = ended.join(_ways(inner), ["g", "node"], "left").join(known.select("g", "node", F.col("on_true").alias("target")), ["g", "node"])
    path = F.array_append(F.coalesce("way", F.array("node")), F.col("_end"))
    return rows.select("g", F.col("node").alias("head"), "target", F.size(path).cast("long").alias("n"), F.array_join(path, ",").alias("links"), "otherwise")


def dispatch_depth(decisions: DataFrame, merges: DataFrame, deep: int = 64) -> DataFrame:
    """(g, node, merge, depth, is_deep) of decisions(g, node, on_true, on_false) that merge(g, node, merge) where they lead if true.

    depth is how many decisions with the same merge, where they lead if true, follow one another if false; null where
    they run in a circle. Found by pointer jumping, so long chains take few rounds.
    """
    rows = settled(decisions.select("g", "node", "on_true", "on_false").join(merges.select("g", "node", "merge"), ["g", "node"]).where("merge = on_true"))
    ahead = rows.select("g", F.col("node").alias("on_false"), "merge")
    links = rows.join(ahead, ["g", "on_false", "merge"]).select("g", "node", F.col("on_false").alias("next"))
    own = links.where("node = next").select("g", F.col("node").alias("top"), F.lit(True).alias("_own"))  # a circle of one
    steps = settled(resolve_aliases(links, rows)).join(own, ["g", "top"], "left").select("g", "node", F.when(F.col("_own").isNull(), F.col("steps")).alias("depth"))
    return rows.join(steps, ["g", "node"]).select("g", "node", "merge", "depth", (F.col("depth") >= deep).alias("is_deep"))


def member_paths(reads: DataFrame) -> DataFrame:
    """(g, node, root, path, n_hops) of reads(g, node, base, hop, keyed): each node is the field hop of its base.

    A base that is no read itself is the root. Hops are in order from the root: .name, or [key] where keyed. Pointer
    jumping carries the hops, so a chain of n reads takes log n rounds. Reads that lead into a circle have no root and
    are left out.
    """
    piece = F.when(F.col("keyed"), F.concat(F.lit("["), F.col("hop"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("hop")))
    state = settled(reads.select("g", "node", F.col("base").alias("top"), F.array(piece).alias("hops")))
    rounds = (state.groupBy("g").count().agg(F.max("count")).first()[0] or 1).bit_length() + 1
    for _ in range(rounds):
        ahead = state.select("g", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("hops").alias("_hops"))
        if state.join(ahead, ["g", "top"], "left_semi").isEmpty():
            break
        following = settled(state.join(ahead, ["g", "top"], "left").select("g", "node", F.coalesce("_top", "top").alias("top"), F.when(F.col("_hops").isNotNull(), F.concat("_hops", "hops")).otherwise(F.col("hops")).alias("hops")))
        discard(state)
        state = following
    rooted = state.join(reads.select("g", F.col("node").alias("top")), ["g", "top"], "left_anti")
    return rooted.select("g", "node", F.col("top").alias("root"), F.array_join("hops", "").alias("path"), F.size("hops").cast("long").alias("n_hops"))


def expand_spans(records: DataFrame, base: Column, count: Column) -> DataFrame:
    """(g, pc, reg) for each register that a record mentions by a span: count of them from base on; none for a count of 0 or null."""
    return span_access(records, "", base, count).drop("mode")


def contract_passthrough(edges: DataFrame, removable: DataFrame) -> DataFrame:
    """The distinct edges when removable(g, node), each with one successor, give way to what they lead to.

    A chain of removable nodes leads to its end. On a cycle of removable nodes alone the largest one stays, with an
    edge to itself.
    """
    plain = edges.select("g", "src", "dst").distinct()
    links = settled(plain.join(removable.select("g", F.col("node").alias("src")).distinct(), ["g", "src"], "left_semi").where("src <> dst").select("g", F.col("src").alias("node"), F.col("dst").alias("next")))
    tops = settled(jump(links, F.greatest))
    turned = settled(tops.join(links.select("g", "node"), ["g", "node"], "left_semi").select("g", "node", "top").where("node <> top"))
    moved = plain.join(turned.select("g", F.col("node").alias("src")), ["g", "src"], "left_anti").join(turned.select("g", F.col("node").alias("dst"), "top"), ["g", "dst"], "left")
    return moved.select("g", "src", F.coalesce("top", "dst").alias("dst")).distinct()


def boolean_diamonds(edges: DataFrame, loads: DataFrame | None = None) -> DataFrame:
    """(g, header, mid, target): header leads to mid and target, mid to target only, and mid is entered from header only.

    With loads(g, node, n_records, reg, value), a node's records and the truth value that its first one puts into a
    register, also reg and value, target's: then mid has only that one record, both put different values into the same
    register, and target is entered from these two only.
    """
    plain = edges.select("g", "src", "dst").distinct().where("src <> dst")
    out = plain.groupBy("g", F.col("src").alias("mid")).agg(F.count("*").alias("_o")).where("_o = 1")
    entered = plain.groupBy("g", F.col("dst").alias("mid")).agg(F.count("*").alias("_i"))
    first = plain.select("g", F.col("src").alias("header"), F.col("dst").alias("mid")).join(out, ["g", "mid"], "left_semi").join(entered.where("_i = 1"), ["g", "mid"], "left_semi")
    second = first.join(plain.select("g", F.col("src").alias("mid"), F.col("dst").alias("target")), ["g", "mid"])
    found = second.join(plain.select("g", F.col("src").alias("header"), F.col("dst").alias("target")), ["g", "header", "target"], "left_semi").select("g", "header", "mid", "target")
    if loads is None:
        return found
    one = loads.where("n_records = 1").select("g", F.col("node").alias("mid"), "reg", F.col("value").alias("_other"))
    end = loads.select("g", F.col("node").alias("target"), "reg", "value")
    twice = entered.where("_i = 2").select("g", F.col("mid").alias("target"))
    return found.join(one, ["g", "mid"]).join(end, ["g", "target", "reg"]).join(twice, ["g", "target"], "left_semi").where("value <> _other").select("g", "header", "mid", "target", "reg", "value")


def place_merges(frontier: DataFrame, writes: DataFrame, live: DataFrame, edges: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(g, node, reg, n_operands): iterated frontier of each register's writing nodes, kept where the register is live in.

    params(g, node, reg) are written at the entry node too. A merge has an operand for each edge into its node.
    """
    df = settled(frontier.select("g", F.col("d").alias("node"), F.col("n").alias("at")).distinct())
    alive = settled(live.select("g", F.col("node").alias("at"), "reg").distinct())
    over = lambda rows: rows.join(df, ["g", "node"]).join(alive, ["g", "at", "reg"], "left_semi").select("g", F.col("at").alias("node"), "reg")
    written = writes.select("g", "node", "reg")
    if params is not None:
        written = written.union(params.select("g", "node", "reg"))
    placed = grow(over(written), lambda new, _: over(new))
    return placed.join(edges.groupBy("g", F.col("dst").alias("node")).agg(F.count("*").alias("n_operands")), ["g", "node"])


def unit_paths(children: DataFrame, roots: DataFrame, separator: str = "_SUB_") -> DataFrame:
    """(id, path, depth) of every unit under roots(id, name), over children(parent, id, name)."""
    kids = settled(children.select("parent", F.col("id").alias("child"), F.col("name").alias("child_name")))
    level = settled(roots.select("id", F.col("name").alias("path"), F.lit(0).cast("long").alias("depth")))
    known = level
    while True:
        below = level.join(kids, level["id"] == kids["parent"]).select(F.col("child").alias("id"), F.concat("path", F.lit(separator), "child_name").alias("path"), (F.col("depth") + 1).alias("depth"))
        level = settled(below.join(known, "id", "left_anti"))
        if level.isEmpty():
            return known
        known = known.unionByName(level)


def check_graph(nodes: DataFrame, edges: DataFrame, entries: DataFrame, returns: Column | None = None, reverse: DataFrame | None = None, looped: DataFrame | None = None) -> DataFrame:
    """(g, rule, node): a row per violation. Rules whose columns or tables are not given are not asked.

    An edge's ends are nodes (edge_end_unknown), a node is reached (unreached), a graph has one entry (several_entries).
    Of nodes' columns: id is the place in the graph from 0 on (id_not_place); head_pc is no larger than tail_pc
    (head_behind_tail); on_true and on_false of a node of type IF are its successors (target_no_successor). A node for
    which returns holds has no successor (return_goes_on). edges and reverse(g, src, dst), kept from the other end, have
    the same pairs (edge_not_symmetric). looped(g, node, header, latch): a header's latch and a latch's header point at
    each other (loop_not_paired).
    """
    known = nodes.select("g", "node").distinct()
    told = lambda df, rule: df.select("g", F.lit(rule).alias("rule"), "node")
    ends = edges.select("g", F.col("src").alias("node")).union(edges.select("g", F.col("dst").alias("node"))).distinct()
    found = [
        told(ends.join(known, ["g", "node"], "left_anti"), "edge_end_unknown"),
        told(known.join(reachable(edges, entries), ["g", "node"], "left_anti"), "unreached"),
        told(entries.groupBy("g").agg(F.count("*").alias("_n"), F.max("node").alias("node")).where("_n > 1"), "several_entries"),
    ]
    if "id" in nodes.columns:
        placed = running(nodes, ["g"], ["id"], _place=total(F.lit(1).cast("long")))
        found.append(told(placed.where("id is null or id <> _place - 1"), "id_not_place"))
    if "head_pc" in nodes.columns:
        found.append(told(nodes.where("head_pc is null or tail_pc is null or head_pc > tail_pc"), "head_behind_tail"))
    if "on_true" in nodes.columns:
        targets = nodes.where("type = 'IF'").select("g", "node", F.explode(F.array("on_true", "on_false")).alias("dst"))
        pairs = edges.select("g", F.col("src").alias("node"), "dst").distinct().withColumn("_known", F.lit(True))
        found.append(told(targets.join(pairs, ["g", "node", "dst"], "left").where("_known is null").select("g", "node").distinct(), "target_no_successor"))
    if returns is not None:
        found.append(told(nodes.where(returns).select("g", "node").join(edges.select("g", F.col("src").alias("node")), ["g", "node"], "left_semi"), "return_goes_on"))
    if reverse is not None:
        one, other = (df.select("g", "src", "dst").distinct() for df in (edges, reverse))
        uneven = one.join(other, ["g", "src", "dst"], "left_anti").unionByName(other.join(one, ["g", "src", "dst"], "left_anti"))
        found.append(told(uneven.select("g", F.col("src").alias("node")).distinct(), "edge_not_symmetric"))
    if looped is not None:
        of = looped.select("g", F.col("node").alias("latch"), F.col("header").alias("_back"))
        to = looped.select("g", F.col("node").alias("header"), F.col("latch").alias("_back"))
        heads = looped.where("latch is not null").join(of, ["g", "latch"], "left").where("_back is null or _back <> node")
        tails = looped.where("header is not null").join(to, ["g", "header"], "left").where("_back is null or _back <> node")
        found.append(told(heads.select("g", "node").union(tails.select("g", "node")).distinct(), "loop_not_paired"))
    return functools.reduce(DataFrame.unionByName, found)


def resolve_aliases(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(g, node, top, steps): the source behind each copy of links(g, node, next); those of nodes(g, node) in no link are their own."""
    found = jump(links)
    if nodes is None:
        return found
    found = settled(found)
    alone = nodes.select("g", "node").distinct().join(found, ["g", "node"], "left_anti")
    return found.unionByName(alone.select("g", "node", F.col("node").alias("top"), F.lit(0).cast("long").alias("steps")))


def chain_terms(links: DataFrame, terms: DataFrame, alone: bool = False) -> DataFrame:
    """(g, top, n, terms): each chain of links(g, node, next) as one row of its nodes' terms(g, node, term), the end last.

    With alone, a term in no link is a chain of one.
    """
    placed = resolve_aliases(links, terms if alone else None).join(terms, ["g", "node"])
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("place"), "node", "term")))
    return placed.groupBy("g", "top").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda e: e["term"]), ",").alias("terms"))


def _left_above(wanted: DataFrame, exits: DataFrame, merges: DataFrame, dom: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For wanted(g, node, reg): the merges, as text, what nodes leave, and what the nearest strict dominator leaves, as _above."""
    merged = merges.select("g", "node", "reg", F.concat(F.lit("p"), F.col("node").cast("string")).alias("_merge"))
    left = shuffled(exits.select("g", "node", "reg", F.col("version").alias("_exit")).join(merged, ["g", "node", "reg"], "full_outer").select("g", "node", "reg", F.coalesce("_exit", "_merge").alias("_leaves")))
    above = nearest_above(wanted.select("g", "node", "reg").distinct(), left.withColumnRenamed("_leaves", "_above"), dom, ["reg"], "_above", strict=True)
    return merged, left, shuffled(above.select("g", "node", "reg", "_above"))


def reaching_versions(uses: DataFrame, exits: DataFrame, merges: DataFrame, dom: DataFrame, inside: DataFrame) -> DataFrame:
    """(g, pc, reg, version) seen by each of uses(g, node, pc, reg), as text.

    inside(g, pc, reg, version) is the last write before a use in its own node. Without one it is the node's merge, pN;
    or else what the nearest strict dominator leaves: its last write exits(g, node, reg, version), or its merge; or 0.
    """
    merged, _, nearest = _left_above(uses, exits, merges, dom)
    rows = uses.join(inside.select("g", "pc", "reg", F.col("version").alias("_own")), ["g", "pc", "reg"], "left").join(merged, ["g", "node", "reg"], "left").join(nearest, ["g", "node", "reg"], "left")
    return rows.select("g", "pc", "reg", F.coalesce("_own", "_merge", "_above", F.lit("0")).alias("version"))


def merge_operands(edges: DataFrame, exits: DataFrame, merges: DataFrame, dom: DataFrame) -> DataFrame:
    """(g, node, reg, pred, version): for each of merges(g, node, reg) and each node before it, the version at that node's end."""
    into = merges.select("g", "node", "reg").join(edges.select("g", F.col("src").alias("pred"), F.col("dst").alias("node")).distinct(), ["g", "node"])
    ends = into.select("g", F.col("pred").alias("node"), "reg").distinct()
    _, left, nearest = _left_above(ends, exits, merges, dom)
    known = ends.join(left, ["g", "node", "reg"], "left").join(nearest, ["g", "node", "reg"], "left").select("g", F.col("node").alias("pred"), "reg", F.coalesce("_leaves", "_above", F.lit("0")).alias("version"))
    return into.join(shuffled(known), ["g", "pred", "reg"]).select("g", "node", "reg", "pred", "version")
