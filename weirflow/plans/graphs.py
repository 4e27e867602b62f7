"""Queries over graphs and dataflow, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from weirflow.operators import graph, joins, segment
from weirflow.plans import fixtures as fx
from weirflow.plans.fixpoint import settled, shuffled



def _error() -> Column:
    return F.expr("op = 'error'")


def _edges(s, d):
    return settled(fx.fe(s, d).select("g", "src", "dst"))


def _dom(s, d):
    return graph.dominators(_edges(s, d), fx.ent(s, d))


def _cut(s, d):
    return fx.fe(s, d).where("not (src like 'error%')").select("g", "src", "dst")


def g1(s, d):
    rows = fx.ir(s, d)
    jumps = segment.with_blocks(rows, _error()).groupBy("g", "b").agg(F.max_by("op", "pc").alias("op"), F.max_by("k", "pc").alias("k")).where("op = 'error'")
    blocks = segment.assign_blocks(rows, _error())
    heads = blocks.select("g", F.col("b").alias("_t"), F.col("head_pc").alias("target_pc"))
    # an error block jumps back by k % 3 blocks; an even k makes it conditional
    aimed = jumps.select("g", "b", F.greatest(F.col("b") - F.col("k") % 3, F.lit(0)).alias("_t"), (F.col("k") % 2 == 0).alias("conditional"))
    return graph.link_blocks(blocks, aimed.join(heads, ["g", "_t"]).drop("_t"))


def g1_ordered(s, d):
    return graph.number_links(g1(s, d))


def g2(s, d):
    edges = _edges(s, d)
    out = edges.groupBy("g", F.col("src").alias("node")).agg(F.count("*").alias("o")).where("o = 1")
    into = edges.groupBy("g", F.col("dst").alias("node")).agg(F.count("*").alias("i")).where("i = 1")
    removable = out.join(into, ["g", "node"]).join(fx.ent(s, d), ["g", "node"], "left_anti").select("g", "node")
    return graph.contract_passthrough(edges, removable)


def g3(s, d):
    return graph.reachable(_cut(s, d), fx.ent(s, d))


def g3_pruned(s, d):
    return graph.prune(_cut(s, d), graph.reachable(_cut(s, d), fx.ent(s, d)))


def g4(s, d):
    return graph.immediate_dominators(_dom(s, d))


def g5(s, d):
    return graph.dominator_tree(_dom(s, d))


def g6(s, d):
    edges = _edges(s, d)
    return graph.dominance_frontier(edges, graph.dominators(edges, fx.ent(s, d)))


def _call_spans(s, d):
    """A purchase is a call that reads the k % 4 registers behind its own."""
    return graph.expand_spans(fx.ir(s, d).where("op = 'purchase'"), F.col("reg") + 1, F.col("k") % 4)


def _block_access(s, d):
    rows = shuffled(segment.with_blocks(fx.ir(s, d), _error()).select("g", "pc", F.col("b").alias("node")))
    return settled(rows.join(fx.du(s, d).unionByName(_call_spans(s, d).withColumn("mode", F.lit("R"))), ["g", "pc"]))


def _block_edges(s, d):
    following = segment.fallthrough(segment.assign_blocks(fx.ir(s, d), _error())).where("next_b is not null").select("g", F.col("b").alias("src"), F.col("next_b").alias("dst"))
    blocks = segment.assign_blocks(fx.ir(s, d), _error())
    back = blocks.where("b >= 2 and b % 2 = 0").select("g", F.col("b").alias("src"), (F.col("b") - 2).alias("dst"))
    return following.unionByName(back)


def _live(s, d, access, edges):
    firsts = access.groupBy("g", "node", "reg").agg(F.min_by("mode", "pc").alias("mode")).where("mode = 'R'").select("g", "node", "reg")
    return graph.liveness(edges, firsts, access.where("mode = 'W'").select("g", "node", "reg"))


def g7(s, d):
    return _live(s, d, _block_access(s, d), _block_edges(s, d))


def g7_spans(s, d):
    """A signup is a call whose results are written to the k % 3 registers from its own on; a record reads before it writes."""
    results = graph.span_access(fx.ir(s, d).where("op = 'signup'"), "W", F.col("reg"), F.col("k") % 3)
    rows = shuffled(segment.with_blocks(fx.ir(s, d), _error()).select("g", "pc", F.col("b").alias("node")))
    plain = fx.du(s, d).where("mode = 'R'").unionByName(_call_spans(s, d).withColumn("mode", F.lit("R")))
    return graph.liveness(_block_edges(s, d), *graph.first_access(settled(rows.join(plain.unionByName(results), ["g", "pc"]))))


def _first_blocks(s, d):
    return segment.assign_blocks(fx.ir(s, d), _error()).where("b = 0").select("g", F.col("b").alias("node"))


def _merges(s, d, access, edges, dom):
    writes = access.where("mode = 'W'").select("g", "node", "reg").distinct()
    params = _first_blocks(s, d).select("g", "node", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("reg"))  # registers 0 and 1 are given
    return graph.place_merges(graph.dominance_frontier(edges, dom), writes, _live(s, d, access, edges), edges, params)


def g8(s, d):
    edges = settled(_block_edges(s, d))
    return _merges(s, d, _block_access(s, d), edges, graph.dominators(edges, _first_blocks(s, d)))


def _versions(s, d):
    access, edges = _block_access(s, d), settled(_block_edges(s, d))
    shown = F.concat(F.lit("d"), F.col("pc").cast("string"))
    writes = access.where("mode = 'W'")
    exits = writes.groupBy("g", "node", "reg").agg(F.max("pc").alias("pc")).select("g", "node", "reg", shown.alias("version"))
    dom = graph.dominators(edges, _first_blocks(s, d))
    inside = joins.as_of(access.where("mode = 'R'").select("g", "node", "reg", "pc"), writes.select("g", "node", "reg", "pc", shown.alias("version")), ["g", "node", "reg"], "pc", "version", None)
    return access, edges, exits, dom, inside.where("version is not null"), settled(_merges(s, d, access, edges, dom))


def g9(s, d):
    access, _, exits, dom, inside, merges = _versions(s, d)
    return graph.reaching_versions(access.where("mode = 'R'").select("g", "node", "pc", "reg"), exits, merges, dom, inside)


def g9_operands(s, d):
    _, edges, exits, dom, _, merges = _versions(s, d)
    return graph.merge_operands(edges, exits, merges, dom)


def _all_order_links(s, d):
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return fx.table(s, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("node"), following.alias("next")).where("next is not null")


def _order_links(s, d):
    """Links of orders that are not pinned: an urgent one is its own source."""
    urgent = fx.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("node"))
    return _all_order_links(s, d).join(urgent, ["g", "node"], "left_anti")


def _order_terms(s, d):
    return fx.table(s, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("node"), F.substring("o_orderpriority", 1, 1).alias("term"))


def g21(s, d):
    return graph.resolve_aliases(_order_links(s, d), _order_terms(s, d))


def g21_all(s, d):
    return graph.resolve_aliases(_all_order_links(s, d), _order_terms(s, d))


def g23(s, d):
    return graph.chain_terms(_order_links(s, d), _order_terms(s, d), alone=True)


def g23_all(s, d):
    return graph.chain_terms(_all_order_links(s, d), _order_terms(s, d), alone=True)


def _capture_links(s, d):
    # a capture of a customer is its nation's if the key is odd, and that its region's if the nation's key is odd
    up = lambda t, key, parent, own, above: fx.table(s, d, t).where(F.col(key) % 2 == 1).select(F.lit(0).cast("long").alias("g"), (F.col(key) + own).cast("long").alias("node"), (F.col(parent) + above).cast("long").alias("next"))
    return up("customer", "c_custkey", "c_nationkey", 100000, 1000).unionByName(up("nation", "n_nationkey", "n_regionkey", 1000, 0))


def _all_customers(s, d):
    return fx.table(s, d, "customer").select(F.lit(0).cast("long").alias("g"), (F.col("c_custkey") + 100000).cast("long").alias("node"))


def g24(s, d):
    # a capture of a customer in debt is its nation's, and that always its region's
    links = lambda rows, key, parent, own, above: rows.select(F.lit(0).cast("long").alias("g"), (F.col(key) + own).cast("long").alias("node"), (F.col(parent) + above).cast("long").alias("next"))
    both = links(fx.table(s, d, "customer").where("c_acctbal < 0"), "c_custkey", "c_nationkey", 100000, 1000).unionByName(links(fx.table(s, d, "nation"), "n_nationkey", "n_regionkey", 1000, 0))
    return graph.resolve_aliases(both, _all_customers(s, d)).where("node >= 100000").select("node", F.col("top").alias("origin"), "steps")


def g24_all(s, d):
    return graph.resolve_aliases(_capture_links(s, d), _all_customers(s, d)).where("node >= 100000").select("node", F.col("top").alias("origin"), "steps")


def g10(s, d):
    return graph.expand_spans(fx.ir(s, d).where("op = 'purchase'"), F.col("reg"), F.col("k") % 4 + 1).withColumnRenamed("reg", "span_reg")


def _edges_dom(s, d):
    edges = _edges(s, d)
    return edges, graph.dominators(edges, fx.ent(s, d))


FOR_KINDS = {"signup": "numeric", "purchase": "general"}


def _node_ops(s, d):
    return fx.nodes(s, d).select("g", "node", F.element_at(F.split("node", ":"), 1).alias("op"))


def _loops(s, d, edges, dom):
    return settled(graph.loops(edges, dom, _node_ops(s, d), FOR_KINDS))


def g11(s, d):
    return graph.back_edges(*_edges_dom(s, d))


def g12(s, d):
    edges, dom = _edges_dom(s, d)
    return graph.loops(edges, dom, _node_ops(s, d), FOR_KINDS)


def g13(s, d):
    edges, dom = _edges_dom(s, d)
    return graph.innermost_loop(dom, graph.back_edges(edges, dom).select("g", F.col("dst").alias("header")))


def g14(s, d):
    edges, dom = _edges_dom(s, d)
    looped = _loops(s, d, edges, dom)
    return graph.classify_exits(edges, graph.innermost_loop(dom, looped.select("g", "header")), looped, dom)


def g14_jumps(s, d):
    """Forward plain jumps: the only way on from a node, to one behind it in order of names."""
    edges, dom = _edges_dom(s, d)
    looped = _loops(s, d, edges, dom)
    jumps = edges.groupBy("g", "src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1 and dst > src")
    return graph.jump_roles(jumps, graph.innermost_loop(dom, looped.select("g", "header")), looped, dom)


def _returns(s, d):
    return fx.nodes(s, d).where("node like 'error%'")


def g15(s, d):
    edges, dom = _edges_dom(s, d)
    pairs = edges.groupBy("g", "src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    return graph.merge_point(edges, pairs, _returns(s, d), graph.back_edges(edges, dom), dom)


def _decisions(s, d):
    """A node with two ways on or more decides between the two most frequent; all but views compare."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "dst")))  # a node has as many ways on as there are node names
    rows = fx.fe(s, d).groupBy("g", F.col("src").alias("node")).agg(ordered.alias("o")).where("size(o) > 1")
    return settled(rows.select("g", "node", F.get("o", F.lit(0))["dst"].alias("on_true"), F.get("o", F.lit(1))["dst"].alias("on_false"), (~F.col("node").startswith("view")).alias("comparison")))


def g18(s, d):
    return graph.shared_target_chains(_decisions(s, d))


def g20(s, d):
    edges, dom = _edges_dom(s, d)
    decisions = _decisions(s, d)
    pairs = decisions.select("g", "node", F.col("on_true").alias("a"), F.col("on_false").alias("b"))
    merges = pairs.join(graph.merge_point(edges, pairs, _returns(s, d), graph.back_edges(edges, dom), dom), ["g", "a", "b"])
    return graph.dispatch_depth(decisions, merges.select("g", "node", "merge"), deep=1)


def g22(s, d):
    orders = fx.table(s, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("node"), F.substring("o_orderpriority", 1, 1).alias("hop"), (F.col("o_orderstatus") == "F").alias("keyed"))
    return graph.member_paths(_all_order_links(s, d).withColumnRenamed("next", "base").join(orders, ["g", "node"]))


def g16(s, d):
    pairs = fx.ent(s, d).withColumnRenamed("node", "a").join(fx.nodes(s, d).withColumnRenamed("node", "b"), "g")
    return graph.can_reach(_edges(s, d), pairs, fx.nodes(s, d).where("node like 'error%'"))


def g17(s, d):
    edges, dom = _edges_dom(s, d)
    return graph.endless_loops(edges, dom, _loops(s, d, edges, dom))


def g19(s, d):
    return graph.boolean_diamonds(_edges(s, d))


def g19_values(s, d):
    loads = fx.ir(s, d).groupBy("g", "node").agg(F.count("*").alias("n_records"), F.min_by("k", "pc").alias("k")).select("g", "node", "n_records", F.floor(F.col("k") / 50).alias("reg"), F.col("node").endswith(":1").alias("value"))
    return graph.boolean_diamonds(_edges(s, d), settled(loads))


def g25(s, d):
    region, nation = fx.table(s, d, "region"), fx.table(s, d, "nation")
    roots = region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    first = nation.select(F.col("n_regionkey").cast("long").alias("parent"), (F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_name").alias("name"))
    second = fx.table(s, d, "customer").select((F.col("c_nationkey") + 1000).cast("long").alias("parent"), (F.col("c_custkey") + 100000).alias("id"), F.col("c_name").alias("name"))
    return graph.unit_paths(first.unionByName(second), roots)


def g26(s, d):
    """The blocks of ir with damage that follows from the events: an id is missing where a block ends in an even k, and so on."""
    rows = segment.with_blocks(fx.ir(s, d), _error()).groupBy("g", "b").agg(F.min("pc").alias("head_pc"), F.max("pc").alias("tail_pc"), F.max_by("k", "pc").alias("k"), F.max("reg").alias("high"))
    flags = F.when(F.lead("b").over(Window.partitionBy("g").orderBy("b")).isNull(), "RETURN").when(F.col("high") > 5, "IF").otherwise("STANDARD")
    nodes = settled(rows.select(
        "g", F.col("b").alias("node"), F.when(F.col("k") % 16 != 3, F.col("b")).alias("id"), "head_pc", F.when(F.col("k") % 8 == 5, F.col("head_pc") - 1).otherwise(F.col("tail_pc")).alias("tail_pc"),
        flags.alias("type"), (F.col("b") + 1).alias("on_true"), F.greatest(F.col("b") - 2, F.lit(0)).alias("on_false"), "k",
    ))
    edges = settled(_block_edges(s, d))
    reverse = edges.where("(src + dst) % 7 <> 3")
    looped = nodes.where("k % 4 <> 1").select("g", "node", F.when(F.col("node") % 2 == 0, F.col("node") - 2).alias("header"), F.when(F.col("node") % 4 == 0, F.col("node") + 2).alias("latch")).where("header >= 0 or latch is not null")
    return graph.check_graph(nodes, edges, _first_blocks(s, d), nodes["type"] == "RETURN", reverse, looped)


def g26_edges(s, d):
    edges = fx.fe(s, d).select("g", "src", "dst").where("not (src like 'error%' and dst like 'view%')").unionByName(
        fx.ent(s, d).where("g % 10 = 0").select("g", F.col("node").alias("src"), F.lit("nowhere").alias("dst"))
    )
    return graph.check_graph(fx.nodes(s, d), settled(edges), fx.ent(s, d))


def j10(s, d):
    pairs = fx.fe(s, d).select("g", F.col("src").alias("d"), F.col("dst").alias("n"))
    return joins.dominates(pairs, _dom(s, d))


def flagship(s, d):
    """(g, node, idom, is_loop_header): what each step must come after, and where users loop back."""
    edges = _edges(s, d)
    dom = graph.dominators(edges, fx.ent(s, d))
    headers = graph.back_edges(edges, dom).select("g", F.col("dst").alias("node")).distinct().withColumn("_h", F.lit(True))
    return graph.immediate_dominators(dom).join(headers, ["g", "node"], "left").select("g", "node", "idom", F.coalesce("_h", F.lit(False)).alias("is_loop_header"))


_BACK = "SELECT fe.g, src, dst FROM fe JOIN dom ON dom.g = fe.g AND dom.d = fe.dst AND dom.n = fe.src"
_FRONTIER = """SELECT DISTINCT e.g, a.d, e.dst AS n FROM {e} e JOIN {dom} a ON a.g = e.g AND a.n = e.src
  WHERE (SELECT count(*) FROM {e} i WHERE i.g = e.g AND i.dst = e.dst) >= 2 AND NOT EXISTS (SELECT 1 FROM {dom} x WHERE x.g = e.g AND x.d = a.d AND x.n = e.dst AND x.d <> x.n)"""
_LOOPS = f""", back AS ({_BACK}), width AS (SELECT g, src, count(*) AS w FROM fe GROUP BY g, src),
  cand AS (SELECT b.g, b.dst AS header, b.src AS latch, CASE WHEN b.dst LIKE 'signup%' THEN 'numeric' WHEN b.dst LIKE 'purchase%' THEN 'general'
    WHEN b.src <> b.dst AND (l.w > 1 OR h.w > 1 AND (b.g, b.dst, b.src) IN (SELECT g, src, dst FROM fe)) THEN 'repeat' ELSE 'while' END AS kind, l.w > 1 AND b.src <> b.dst AS decides
    FROM back b JOIN width l ON l.g = b.g AND l.src = b.src JOIN width h ON h.g = b.g AND h.src = b.dst),
  kinds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, header ORDER BY kind = 'repeat' DESC, latch DESC) AS r FROM cand) WHERE r = 1),
  loops AS (SELECT g, header, latch, kind, CASE
    WHEN kind = 'while' THEN (SELECT min(fe.dst) FROM fe WHERE fe.g = k.g AND fe.src = header AND fe.dst <> header AND fe.dst <> latch AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.g = k.g AND dom.d = fe.dst AND dom.n = k.latch))
    WHEN kind = 'repeat' THEN (SELECT min(fe.dst) FROM fe WHERE fe.g = k.g AND fe.src = CASE WHEN decides THEN latch ELSE header END AND fe.dst <> header AND fe.dst <> latch)
    ELSE (SELECT min(fe.dst) FROM fe WHERE fe.g = k.g AND fe.src = latch AND fe.dst <> header AND fe.dst <> latch AND EXISTS (SELECT 1 FROM dom WHERE dom.g = k.g AND dom.d = k.latch AND dom.n = fe.dst)) END AS exit FROM kinds k)"""
_INNER = """inner_ AS (SELECT dom.g, n AS node, max_by(d, depth.depth) AS header, count(*) AS nesting FROM dom JOIN depth ON depth.g = dom.g AND depth.node = d
  WHERE (dom.g, d) IN (SELECT g, dst FROM back) GROUP BY dom.g, n)"""
_BLOCKS = """, bedge AS (SELECT g, b AS src, b + 1 AS dst FROM blk WHERE (g, b + 1) IN (SELECT g, b FROM blk) UNION ALL SELECT g, b, b - 2 FROM blk WHERE b >= 2 AND b % 2 = 0),
  acc AS (SELECT a.g, b AS node, reg, a.pc, mode FROM (SELECT g, pc, reg, mode FROM du UNION ALL SELECT g, pc, unnest(range(reg + 1, reg + 1 + k % 4)), 'R' FROM ir WHERE op = 'purchase') a
    JOIN blkrow ON blkrow.g = a.g AND blkrow.pc = a.pc),
  firsts AS (SELECT g, node, reg FROM acc GROUP BY g, node, reg HAVING arg_min(mode, pc) = 'R'), wr AS (SELECT DISTINCT g, node, reg FROM acc WHERE mode = 'W'),
  live AS (SELECT g, node, reg FROM firsts UNION SELECT l.g, e.src, l.reg FROM live l JOIN bedge e ON e.g = l.g AND e.dst = l.node
    WHERE NOT EXISTS (SELECT 1 FROM wr WHERE wr.g = l.g AND wr.node = e.src AND wr.reg = l.reg))"""
_MERGES = f"""{_BLOCKS}, bn AS (SELECT g, b AS node FROM blk),
      bavoid AS (SELECT g, node AS d, CAST(0 AS BIGINT) AS n FROM bn WHERE node <> 0 UNION SELECT a.g, a.d, e.dst FROM bavoid a JOIN bedge e ON e.g = a.g AND e.src = a.n WHERE e.dst <> a.d),
      bdom AS (SELECT a.g, a.node AS d, b.node AS n FROM bn a JOIN bn b ON a.g = b.g WHERE NOT EXISTS (SELECT 1 FROM bavoid x WHERE x.g = a.g AND x.d = a.node AND x.n = b.node)),
      bdf AS ({_FRONTIER.format(e="bedge", dom="bdom")}),
      pw AS (SELECT * FROM wr UNION SELECT g, b, unnest([0, 1]) FROM blk WHERE b = 0),
      phi AS (SELECT f.g, f.n AS node, w.reg FROM bdf f JOIN pw w ON w.g = f.g AND w.node = f.d JOIN live l ON l.g = f.g AND l.node = f.n AND l.reg = w.reg
        UNION SELECT f.g, f.n, p.reg FROM phi p JOIN bdf f ON f.g = p.g AND f.d = p.node JOIN live l ON l.g = f.g AND l.node = f.n AND l.reg = p.reg)"""
_LEFT = """, lv AS (SELECT g, node, reg, 'd' || max(pc) AS v FROM acc WHERE mode = 'W' GROUP BY g, node, reg
        UNION ALL SELECT g, node, reg, 'p' || node FROM phi WHERE (g, node, reg) NOT IN (SELECT g, node, reg FROM wr)),
      dep AS (SELECT g, n, count(*) AS depth FROM bdom GROUP BY g, n),
      near AS (SELECT d.g, d.n AS node, lv.reg, max_by(lv.v, dep.depth) AS v FROM bdom d JOIN lv ON lv.g = d.g AND lv.node = d.d JOIN dep ON dep.g = d.g AND dep.n = d.d WHERE d.d <> d.n GROUP BY d.g, d.n, lv.reg)"""
_CHAINS = """WITH RECURSIVE o AS (SELECT o_custkey AS g, o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next, substr(o_orderpriority, 1, 1) AS term FROM orders),
  l AS (SELECT g, node, next FROM o WHERE next IS NOT NULL AND term <> '1'), n AS (SELECT g, node FROM o),
  w AS (SELECT g, node, node AS ahead, 0 AS steps FROM n UNION ALL SELECT w.g, w.node, l.next, steps + 1 FROM w JOIN l ON l.g = w.g AND l.node = w.ahead),
  t AS (SELECT g, node, max_by(ahead, steps) AS top, max(steps) AS steps FROM w GROUP BY g, node)"""
#: A breadth-first search from st(g, s) over be(g, src, dst), a level each; there are ten node names, so ten levels are all.
_SEARCH = ", l0 AS MATERIALIZED (SELECT g, s, s AS node, s AS path, 0 AS dist FROM st), k0 AS MATERIALIZED (SELECT g, s, node FROM l0)" + "".join(
    f""", l{i} AS MATERIALIZED (SELECT l.g, l.s, e.dst AS node, min(l.path || ',' || e.dst) AS path, {i} AS dist FROM l{i - 1} l JOIN be e ON e.g = l.g AND e.src = l.node
    WHERE (l.g, l.s, e.dst) NOT IN (SELECT g, s, node FROM k{i - 1}) GROUP BY l.g, l.s, e.dst), k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} UNION ALL SELECT g, s, node FROM l{i})"""
    for i in range(1, 11)
) + ", r AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(11)) + ")"
_MEET = f""", be AS MATERIALIZED (SELECT g, src, dst FROM fe WHERE (g, src, dst) NOT IN ({_BACK.replace("fe.g, src", "fe.g, fe.src")})), st AS (SELECT g, a AS s FROM pr UNION SELECT g, b FROM pr){_SEARCH},
  met AS (SELECT pr.g, a, b, min_by(y.node, (y.dist, y.path)) AS node FROM pr JOIN r x ON x.g = pr.g AND x.s = a JOIN r y ON y.g = pr.g AND y.s = b AND y.node = x.node GROUP BY ALL),
  mp AS (SELECT pr.g, pr.a, pr.b, CASE WHEN pr.a = pr.b THEN pr.a WHEN pr.a LIKE 'error%' AND pr.b LIKE 'error%' THEN NULL WHEN pr.a LIKE 'error%' THEN pr.b WHEN pr.b LIKE 'error%' THEN pr.a ELSE met.node END AS merge
    FROM pr LEFT JOIN met ON met.g = pr.g AND met.a = pr.a AND met.b = pr.b)"""
_DECISIONS = """, dec AS MATERIALIZED (SELECT g, src AS node, max(dst) FILTER (WHERE r = 1) AS on_true, max(dst) FILTER (WHERE r = 2) AS on_false, src NOT LIKE 'view%' AS comparison
  FROM (SELECT *, row_number() OVER (PARTITION BY g, src ORDER BY n DESC, dst) AS r FROM fe) GROUP BY g, src HAVING count(*) > 1)"""
_ORDERS = "SELECT o_custkey AS g, o_orderkey AS node, substr(o_orderpriority, 1, 1) AS term FROM orders"
_DOM = ("dom", "fe")
QUERIES = {
    "flagship_idoms": (flagship, f", back AS ({_BACK}) SELECT g, node, idom, (g, node) IN (SELECT g, dst FROM back) AS is_loop_header FROM idom", ("idom", "fe")),
    "g1_link_blocks": (g1, """, last AS (SELECT r.g, r.b, max_by(r.op, r.pc) AS op, max_by(ir.k, r.pc) AS k FROM blkrow r JOIN ir ON ir.g = r.g AND ir.pc = r.pc GROUP BY r.g, r.b),
      j AS (SELECT g, b, greatest(b - k % 3, 0) AS t, k % 2 = 0 AS c FROM last WHERE op = 'error')
      SELECT g, b AS src, t AS dst, CASE WHEN c THEN 'true' ELSE 'jump' END AS role FROM j
      UNION ALL SELECT n.g, n.b, n.b + 1, CASE WHEN c THEN 'false' ELSE 'next' END FROM blk n LEFT JOIN j ON j.g = n.g AND j.b = n.b
      WHERE (n.g, n.b + 1) IN (SELECT g, b FROM blk) AND (c IS NULL OR c)""", ("ir", "blk")),
    "g1_ordered_links": (g1_ordered, """, last AS (SELECT r.g, r.b, max_by(r.op, r.pc) AS op, max_by(ir.k, r.pc) AS k FROM blkrow r JOIN ir ON ir.g = r.g AND ir.pc = r.pc GROUP BY r.g, r.b),
      j AS (SELECT g, b, greatest(b - k % 3, 0) AS t, k % 2 = 0 AS c FROM last WHERE op = 'error'),
      l AS (SELECT g, b AS src, t AS dst, CASE WHEN c THEN 'true' ELSE 'jump' END AS role FROM j
      UNION ALL SELECT n.g, n.b, n.b + 1, CASE WHEN c THEN 'false' ELSE 'next' END FROM blk n LEFT JOIN j ON j.g = n.g AND j.b = n.b WHERE (n.g, n.b + 1) IN (SELECT g, b FROM blk) AND (c IS NULL OR c))
      SELECT *, row_number() OVER (PARTITION BY g, src ORDER BY role IN ('false', 'next'), dst) - 1 AS ord FROM l""", ("ir", "blk")),
    "g2_contract_passthrough": (g2, """, rem AS (SELECT g, node FROM nodes n WHERE (SELECT count(*) FROM fe WHERE fe.g = n.g AND src = node) = 1 AND (SELECT count(*) FROM fe WHERE fe.g = n.g AND dst = node) = 1
        AND (g, node) NOT IN (SELECT g, node FROM ent)),
      nxt AS (SELECT r.g, r.node, fe.dst AS next FROM rem r JOIN fe ON fe.g = r.g AND fe.src = r.node WHERE fe.dst <> r.node),
      walk AS (SELECT g, node, next AS ahead FROM nxt UNION SELECT w.g, w.node, nxt.next FROM walk w JOIN nxt ON nxt.g = w.g AND nxt.node = w.ahead),
      cyc AS (SELECT g, node, max(ahead) AS top FROM walk w WHERE (g, node, node) IN (SELECT g, node, ahead FROM walk) GROUP BY g, node),
      tops AS (SELECT w.g, w.node, w.ahead AS top FROM walk w WHERE (w.g, w.ahead) NOT IN (SELECT g, node FROM nxt)
        UNION SELECT w.g, w.node, c.top FROM walk w JOIN cyc c ON c.g = w.g AND c.node = w.ahead),
      turned AS (SELECT * FROM tops WHERE node <> top)
      SELECT DISTINCT fe.g, fe.src, coalesce(t.top, fe.dst) AS dst FROM fe LEFT JOIN turned t ON t.g = fe.g AND t.node = fe.dst WHERE (fe.g, fe.src) NOT IN (SELECT g, node FROM turned)""", ("nodes", "fe", "ent")),
    "g3_reachable": (g3, ", r AS (SELECT g, node FROM ent UNION SELECT fe.g, fe.dst FROM r JOIN fe ON fe.g = r.g AND fe.src = r.node WHERE NOT src LIKE 'error%') SELECT * FROM r", ("fe", "ent")),
    "g3_pruned_edges": (g3_pruned, """, r AS (SELECT g, node FROM ent UNION SELECT fe.g, fe.dst FROM r JOIN fe ON fe.g = r.g AND fe.src = r.node WHERE NOT src LIKE 'error%')
      SELECT g, src, dst FROM fe WHERE NOT src LIKE 'error%' AND (g, src) IN (SELECT g, node FROM r) AND (g, dst) IN (SELECT g, node FROM r)""", ("fe", "ent")),
    "g4_dominators": (g4, "SELECT idom.g, idom.node, idom, depth FROM idom JOIN depth ON depth.g = idom.g AND depth.node = idom.node", ("idom",)),
    "g5_dom_tree": (g5, """, p AS (SELECT dom.g, n AS node, list(d ORDER BY depth.depth) AS path FROM dom JOIN depth ON depth.g = dom.g AND depth.node = d GROUP BY dom.g, n),
      kids AS (SELECT g, path[-2] AS node, count(*) AS n_children, string_agg(node, ',' ORDER BY node) AS children FROM p WHERE len(path) > 1 GROUP BY ALL)
      SELECT p.g, p.node, len(path) - 1 AS depth, row_number() OVER (PARTITION BY p.g ORDER BY path) - 1 AS rank, coalesce(n_children, 0) AS n_children, coalesce(children, '') AS children
      FROM p LEFT JOIN kids ON kids.g = p.g AND kids.node = p.node""", ("dom", "depth")),
    "g6_dominance_frontier": (g6, _FRONTIER.format(e="fe", dom="dom"), _DOM),
    "g7_liveness": (g7, _BLOCKS + " SELECT * FROM live", ("blk", "du")),
    "g7_span_results": (g7_spans, """, bedge AS (SELECT g, b AS src, b + 1 AS dst FROM blk WHERE (g, b + 1) IN (SELECT g, b FROM blk) UNION ALL SELECT g, b, b - 2 FROM blk WHERE b >= 2 AND b % 2 = 0),
      acc AS (SELECT a.g, b AS node, reg, a.pc, mode FROM (SELECT g, pc, reg, mode FROM du WHERE mode = 'R' UNION ALL SELECT g, pc, unnest(range(reg + 1, reg + 1 + k % 4)), 'R' FROM ir WHERE op = 'purchase'
        UNION ALL SELECT g, pc, unnest(range(reg, reg + k % 3)), 'W' FROM ir WHERE op = 'signup') a JOIN blkrow ON blkrow.g = a.g AND blkrow.pc = a.pc),
      firsts AS (SELECT g, node, reg FROM acc GROUP BY g, node, reg HAVING arg_min(mode, pc * 2 + CASE WHEN mode = 'W' THEN 1 ELSE 0 END) = 'R'), wr AS (SELECT DISTINCT g, node, reg FROM acc WHERE mode = 'W'),
      live AS (SELECT g, node, reg FROM firsts UNION SELECT l.g, e.src, l.reg FROM live l JOIN bedge e ON e.g = l.g AND e.dst = l.node
        WHERE NOT EXISTS (SELECT 1 FROM wr WHERE wr.g = l.g AND wr.node = e.src AND wr.reg = l.reg))
      SELECT * FROM live""", ("blk", "du")),
    "g8_place_merges": (g8, _MERGES + " SELECT phi.*, (SELECT count(*) FROM bedge e WHERE e.g = phi.g AND e.dst = phi.node) AS n_operands FROM phi", ("blk", "du")),
    "g9_reaching_versions": (g9, _MERGES + _LEFT + """ SELECT a.g, a.pc, a.reg, coalesce((SELECT 'd' || max(w.pc) FROM acc w WHERE w.g = a.g AND w.node = a.node AND w.reg = a.reg AND w.mode = 'W' AND w.pc < a.pc),
        (SELECT 'p' || p.node FROM phi p WHERE p.g = a.g AND p.node = a.node AND p.reg = a.reg), near.v, '0') AS version
      FROM acc a LEFT JOIN near ON near.g = a.g AND near.node = a.node AND near.reg = a.reg WHERE a.mode = 'R'""", ("blk", "du")),
    "g9_merge_operands": (g9_operands, _MERGES + _LEFT + """ SELECT DISTINCT phi.g, phi.node, phi.reg, e.src AS pred, coalesce(lv.v, near.v, '0') AS version FROM phi JOIN bedge e ON e.g = phi.g AND e.dst = phi.node
      LEFT JOIN lv ON lv.g = phi.g AND lv.node = e.src AND lv.reg = phi.reg LEFT JOIN near ON near.g = phi.g AND near.node = e.src AND near.reg = phi.reg""", ("blk", "du")),
    "g21_resolve_aliases": (g21, _CHAINS + " SELECT * FROM t", None),
    "g23_chain_terms": (g23, _CHAINS + " SELECT t.g, top, count(*) AS n, string_agg(term, ',' ORDER BY steps DESC) AS terms FROM t JOIN o ON o.g = t.g AND o.node = t.node GROUP BY t.g, top", None),
    "g24_resolve_captures": (g24, "SELECT c_custkey + 100000 AS node, CASE WHEN c_acctbal < 0 THEN n_regionkey ELSE c_custkey + 100000 END AS origin, CASE WHEN c_acctbal < 0 THEN 2 ELSE 0 END AS steps FROM customer JOIN nation ON n_nationkey = c_nationkey", None),
    "g21_all_aliases": (g21_all, f"SELECT g, node, max(node) OVER (PARTITION BY g) AS top, count(*) OVER (PARTITION BY g ORDER BY node DESC) - 1 AS steps FROM ({_ORDERS})", None),
    "g23_all_terms": (g23_all, f"SELECT g, max(node) AS top, count(*) AS n, string_agg(term, ',' ORDER BY node) AS terms FROM ({_ORDERS}) GROUP BY g", None),
    "g24_all_captures": (g24_all, """SELECT c_custkey + 100000 AS node, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 100000 WHEN c_nationkey % 2 = 0 THEN c_nationkey + 1000 ELSE n_regionkey END AS origin,
      CASE WHEN c_custkey % 2 = 0 THEN 0 WHEN c_nationkey % 2 = 0 THEN 1 ELSE 2 END AS steps FROM customer JOIN nation ON n_nationkey = c_nationkey""", None),
    "g10_expand_spans": (g10, "SELECT g, pc, unnest(range(reg, reg + k % 4 + 1)) AS span_reg FROM ir WHERE op = 'purchase'", ("ir",)),
    "g11_back_edges": (g11, _BACK, _DOM),
    "g12_loops": (g12, _LOOPS + " SELECT * FROM loops", _DOM),
    "g13_innermost_loop": (g13, f", back AS ({_BACK}), {_INNER} SELECT * FROM inner_", ("dom", "fe", "depth")),
    "g14_classify_exits": (g14, _LOOPS + f""", {_INNER} SELECT fe.g, fe.src, fe.dst, CASE WHEN fe.dst = header THEN 'continue' WHEN (fe.g, header, fe.dst) IN (SELECT g, header, exit FROM loops WHERE exit IS NOT NULL) THEN 'break'
      WHEN EXISTS (SELECT 1 FROM dom WHERE dom.g = fe.g AND d = header AND n = fe.dst) THEN 'inside' ELSE 'leave' END AS role FROM fe JOIN inner_ i ON i.g = fe.g AND i.node = fe.src""", ("dom", "fe", "depth")),
    "g14_jump_roles": (g14_jumps, _LOOPS + f""", {_INNER}, one AS (SELECT g, src, min(dst) AS dst FROM fe GROUP BY g, src HAVING count(*) = 1)
      SELECT o.g, o.src, o.dst, header, CASE WHEN (o.g, header, o.dst) IN (SELECT g, header, exit FROM loops WHERE exit IS NOT NULL) THEN 'break'
      WHEN EXISTS (SELECT 1 FROM dom WHERE dom.g = o.g AND d = header AND n = o.dst) THEN 'continue' ELSE 'leave' END AS role FROM one o JOIN inner_ i ON i.g = o.g AND i.node = o.src WHERE o.dst > o.src""", ("dom", "fe", "depth")),
    "g15_merge_point": (g15, f", pr AS (SELECT DISTINCT g, min(dst) AS a, max(dst) AS b FROM fe GROUP BY g, src){_MEET} SELECT * FROM mp", _DOM),
    "g16_can_reach": (g16, """, rr AS (SELECT ent.g, ent.node AS a, fe.dst AS node FROM ent JOIN fe ON fe.g = ent.g AND fe.src = ent.node
        UNION SELECT rr.g, a, fe.dst FROM rr JOIN fe ON fe.g = rr.g AND fe.src = rr.node WHERE NOT rr.node LIKE 'error%')
      SELECT n.g, ent.node AS a, n.node AS b, (n.g, ent.node, n.node) IN (SELECT g, a, node FROM rr) AS reaches FROM nodes n JOIN ent ON ent.g = n.g""", ("fe", "ent", "nodes")),
    "g17_endless_loops": (g17, _LOOPS + """, one AS (SELECT g, src, min(dst) AS dst FROM fe GROUP BY g, src HAVING count(*) = 1)
      SELECT g, src AS node, src AS latch FROM one WHERE src = dst
      UNION ALL SELECT o.g, o.dst, min(o.src) FROM one o JOIN loops l ON l.g = o.g AND l.header = o.dst WHERE o.src <> o.dst AND o.src <> l.latch AND (o.g, o.src, o.dst) IN (SELECT g, src, dst FROM back) GROUP BY o.g, o.dst""", _DOM),
    "g18_shared_target_chains": (g18, _DECISIONS + """, w AS (SELECT g, node AS head, on_true AS target, node, [node] AS path FROM dec WHERE comparison
        UNION ALL SELECT w.g, head, target, x.node, list_append(path, x.node) FROM w JOIN dec d ON d.g = w.g AND d.node = w.node JOIN dec x ON x.g = w.g AND x.node = d.on_false
        WHERE d.comparison AND d.on_true = target AND NOT list_contains(path, x.node) AND (x.on_true = target OR x.on_false = target))
      SELECT w.g, head, target, len(path) AS n, array_to_string(path, ',') AS links, d.on_true AS otherwise FROM w JOIN dec d ON d.g = w.g AND d.node = w.node
      WHERE d.comparison AND d.on_true <> target AND d.on_false = target AND len(path) > 1""", ("fe",)),
    "g20_dispatch_depth": (g20, _DECISIONS + f", pr AS (SELECT DISTINCT g, on_true AS a, on_false AS b FROM dec){_MEET}" + """,
      sh AS MATERIALIZED (SELECT dec.g, dec.node, on_false, merge FROM dec JOIN mp ON mp.g = dec.g AND mp.a = on_true AND mp.b = on_false WHERE merge = on_true),
      w AS (SELECT g, node AS head, node, merge, on_false, [node] AS path FROM sh UNION ALL SELECT w.g, head, x.node, w.merge, x.on_false, list_append(path, x.node) FROM w JOIN sh x ON x.g = w.g AND x.node = w.on_false AND x.merge = w.merge
        WHERE NOT list_contains(path, x.node)),
      ring AS (SELECT DISTINCT w.g, head FROM w JOIN sh x ON x.g = w.g AND x.node = w.on_false AND x.merge = w.merge WHERE list_contains(path, x.node))
      SELECT w.g, head AS node, merge, CASE WHEN (w.g, head) NOT IN (SELECT g, head FROM ring) THEN max(len(path)) - 1 END AS depth,
        CASE WHEN (w.g, head) NOT IN (SELECT g, head FROM ring) THEN max(len(path)) - 1 >= 1 END AS is_deep FROM w GROUP BY w.g, head, merge""", _DOM),
    "g22_member_paths": (g22, """WITH o AS (SELECT o_custkey AS g, o_orderkey AS node, CASE WHEN o_orderstatus = 'F' THEN '[' || substr(o_orderpriority, 1, 1) || ']' ELSE '.' || substr(o_orderpriority, 1, 1) END AS piece,
        max(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders)
      SELECT g, node, root, string_agg(piece, '') OVER w AS path, count(*) OVER w AS n_hops FROM o WHERE node <> root WINDOW w AS (PARTITION BY g ORDER BY node DESC)""", None),
    "g19_boolean_diamonds": (g19, """, p AS (SELECT g, src, dst FROM fe WHERE src <> dst)
      SELECT a.g, a.src AS header, a.dst AS mid, b.dst AS target FROM p a JOIN p b ON b.g = a.g AND b.src = a.dst JOIN p c ON c.g = a.g AND c.src = a.src AND c.dst = b.dst
      WHERE (SELECT count(*) FROM p x WHERE x.g = a.g AND x.src = a.dst) = 1 AND (SELECT count(*) FROM p x WHERE x.g = a.g AND x.dst = a.dst) = 1""", ("fe",)),
    "g19_boolean_values": (g19_values, """, p AS (SELECT g, src, dst FROM fe WHERE src <> dst), ld AS (SELECT g, node, count(*) AS n, min_by(k, pc) // 50 AS reg, node LIKE '%:1' AS value FROM ir GROUP BY g, node)
      SELECT a.g, a.src AS header, a.dst AS mid, b.dst AS target, t.reg, t.value FROM p a JOIN p b ON b.g = a.g AND b.src = a.dst JOIN p c ON c.g = a.g AND c.src = a.src AND c.dst = b.dst
      JOIN ld m ON m.g = a.g AND m.node = a.dst JOIN ld t ON t.g = a.g AND t.node = b.dst
      WHERE (SELECT count(*) FROM p x WHERE x.g = a.g AND x.src = a.dst) = 1 AND (SELECT count(*) FROM p x WHERE x.g = a.g AND x.dst = a.dst) = 1
        AND (SELECT count(*) FROM p x WHERE x.g = a.g AND x.dst = b.dst) = 2 AND m.n = 1 AND m.reg = t.reg AND m.value <> t.value""", ("ir", "fe")),
    "g25_unit_paths": (g25, """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS path, CAST(0 AS BIGINT) AS depth FROM region
      UNION ALL SELECT CAST(n_nationkey + 1000 AS BIGINT), r_name || '_SUB_' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
      UNION ALL SELECT c_custkey + 100000, r_name || '_SUB_' || n_name || '_SUB_' || c_name, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""", None),
    "g26_check_graph": (g26, """, bl AS (SELECT r.g, r.b AS node, min(r.pc) AS head_pc, max(r.pc) AS last_pc, max_by(ir.k, r.pc) AS k, max(ir.reg) AS high FROM blkrow r JOIN ir ON ir.g = r.g AND ir.pc = r.pc GROUP BY r.g, r.b),
      n AS MATERIALIZED (SELECT *, CASE WHEN k % 16 <> 3 THEN node END AS id, CASE WHEN k % 8 = 5 THEN head_pc - 1 ELSE last_pc END AS tail_pc,
        CASE WHEN node = max(node) OVER (PARTITION BY g) THEN 'RETURN' WHEN high > 5 THEN 'IF' ELSE 'STANDARD' END AS type FROM bl),
      e AS MATERIALIZED (SELECT DISTINCT g, b AS src, b + 1 AS dst FROM blk WHERE (g, b + 1) IN (SELECT g, b FROM blk) UNION SELECT g, b, b - 2 FROM blk WHERE b >= 2 AND b % 2 = 0),
      lp AS (SELECT g, node, CASE WHEN node % 2 = 0 AND node >= 2 THEN node - 2 WHEN node % 2 = 0 THEN -2 END AS header, CASE WHEN node % 4 = 0 THEN node + 2 END AS latch FROM n WHERE k % 4 <> 1),
      lo AS MATERIALIZED (SELECT * FROM lp WHERE header >= 0 OR latch IS NOT NULL)
      SELECT g, 'id_not_place' AS rule, node FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id NULLS FIRST) - 1 AS place FROM n) WHERE id IS NULL OR id <> place
      UNION ALL SELECT g, 'head_behind_tail', node FROM n WHERE head_pc > tail_pc
      UNION ALL SELECT g, 'target_no_successor', node FROM n WHERE type = 'IF' AND ((g, node, node + 1) NOT IN (SELECT g, src, dst FROM e) OR (g, node, greatest(node - 2, 0)) NOT IN (SELECT g, src, dst FROM e))
      UNION ALL SELECT g, 'return_goes_on', node FROM n WHERE type = 'RETURN' AND (g, node) IN (SELECT g, src FROM e)
      UNION ALL SELECT DISTINCT g, 'edge_not_symmetric', src FROM e WHERE (src + dst) % 7 = 3
      UNION ALL SELECT g, 'loop_not_paired', node FROM lo a WHERE latch IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lo b WHERE b.g = a.g AND b.node = a.latch AND b.header = a.node)
        OR header IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lo b WHERE b.g = a.g AND b.node = a.header AND b.latch = a.node)""", ("ir", "blk")),
    "g26_check_edges": (g26_edges, """, e AS (SELECT g, src, dst FROM fe WHERE NOT (src LIKE 'error%' AND dst LIKE 'view%') UNION ALL SELECT g, node, 'nowhere' FROM ent WHERE g % 10 = 0),
      r AS (SELECT g, node FROM ent UNION SELECT e.g, e.dst FROM r JOIN e ON e.g = r.g AND e.src = r.node)
      SELECT g, 'edge_end_unknown' AS rule, node FROM (SELECT g, src AS node FROM e UNION SELECT g, dst FROM e) WHERE (g, node) NOT IN (SELECT g, node FROM nodes)
      UNION ALL SELECT g, 'unreached', node FROM nodes WHERE (g, node) NOT IN (SELECT g, node FROM r)""", ("fe", "ent", "nodes")),
    "j10_dominates": (j10, "SELECT fe.g, src AS d, dst AS n FROM fe JOIN dom ON dom.g = fe.g AND dom.d = src AND dom.n = dst", _DOM),
}
