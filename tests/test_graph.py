import random

import pytest

from weirflow.operators import graph, merging
from weirflow.plans import fixpoint


def random_graphs(seed, count=40):
    draw = random.Random(seed)
    edges, entries, nodes = [], [], []
    for g in range(count):
        size = draw.randint(1, 8)
        names = [f"n{i}" for i in range(size)]
        nodes += [(g, n) for n in names]
        entries.append((g, "n0"))
        edges += [(g, draw.choice(names), draw.choice(names)) for _ in range(draw.randint(0, 14))]
    return edges, entries, nodes


def frames(spark, edges, entries):
    return spark.createDataFrame(edges, "g long, src string, dst string"), spark.createDataFrame(entries, "g long, node string")


def reach(edges, g, start, without=None):
    seen, queue = set(), [start] if start != without else []
    while queue:
        n = queue.pop()
        if n not in seen:
            seen.add(n)
            queue += [b for h, a, b in edges if h == g and a == n and b != without]
    return seen


def test_dominators_frontiers_and_back_edges_on_random_graphs(spark):
    edges, entries, nodes = random_graphs(3)
    e, start = frames(spark, edges, entries)
    expected = set()
    for g, n in nodes:
        if n in reach(edges, g, "n0"):
            expected |= {(g, d, n) for _, d in [x for x in nodes if x[0] == g] if d in reach(edges, g, "n0") and n not in reach(edges, g, "n0", d)}
    dom = graph.dominators(e, start)
    assert {tuple(r) for r in graph.dominance_pairs(dom).collect()} == expected
    other = graph.dominators(e, start, small=0)  # by folding, and by paths where that ends
    assert {tuple(r) for r in other.collect()} == {tuple(r) for r in dom.collect()}
    live = {(g, n) for g, _, n in expected}
    frontier = {
        (g, d, b) for g, a, b in edges if (g, a) in live for _, d in [x for x in nodes if x[0] == g]
        if (g, d, a) in expected and not ((g, d, b) in expected and d != b) and sum(h == g and y == b for h, _, y in edges) >= 2
    }
    assert {tuple(r) for r in graph.dominance_frontier(e, dom).collect()} == frontier
    assert {tuple(r) for r in graph.back_edges(e, dom).collect()} == {(g, a, b) for g, a, b in edges if (g, b, a) in expected}


def plain_idoms(size, edges):
    """Immediate dominators of one graph from node 0, by repeated intersection in reverse post-order."""
    out, into = {}, {}
    for x, y in edges:
        out.setdefault(x, []).append(y)
        into.setdefault(y, []).append(x)
    order, seen, stack = [], {0}, [(0, iter(out.get(0, [])))]
    while stack:
        node, ways = stack[-1]
        for y in ways:
            if y not in seen:
                seen.add(y)
                stack.append((y, iter(out.get(y, []))))
                break
        else:
            order.append(node)
            stack.pop()
    place = {n: i for i, n in enumerate(order)}
    idom, changed = {0: 0}, True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            new = None
            for p in into[n]:
                if p in idom:
                    if new is None:
                        new = p
                    x = p
                    while x != new:
                        while place[x] < place[new]:
                            x = idom[x]
                        while place[new] < place[x]:
                            new = idom[new]
            if idom.get(n) != new:
                idom[n], changed = new, True
    return {n: None if n == 0 else d for n, d in idom.items()}


def test_dominators_of_one_large_graph(spark):
    size, draw = 50_000, random.Random(4)
    edges = [(i // 3, i) for i in range(1, size)] + [(i, draw.randrange(size)) for i in range(0, size, 7)] + [(i, max(0, i - draw.randint(1, 50))) for i in range(0, size, 5)]
    edges += [(size + i, size + i + 1) for i in range(50)] + [(size, 3)]  # not reached from 0
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "g long, src long, dst long")
    dom = graph.dominators(e, spark.createDataFrame([(1, 0)], "g long, node long"))
    found = {r.node: r.idom for r in graph.immediate_dominators(dom).collect()}
    assert found == plain_idoms(size, edges)


def test_ranks_are_in_pre_order(spark):
    e, start = frames(spark, [(1, "r", "b"), (1, "r", "a"), (1, "b", "d"), (1, "a", "c"), (1, "c", "e"), (1, "b", "e")], [(1, "r")])
    told = {r.node: (r.depth, r["rank"], r.n_children, r.children) for r in graph.dominator_tree(graph.dominators(e, start)).collect()}
    assert told == {"r": (0, 0, 3, "a,b,e"), "a": (1, 1, 1, "c"), "c": (2, 2, 0, ""), "b": (1, 3, 1, "d"), "d": (2, 4, 0, ""), "e": (1, 5, 0, "")}


def test_loop_kinds_latches_and_exits(spark):
    edges = [
        (1, "h", "b"), (1, "b", "l"), (1, "l", "h"), (1, "h", "x"),  # while
        (2, "h", "b"), (2, "b", "h"), (2, "b", "x"),  # repeat, the latch decides
        (3, "h", "l"), (3, "h", "x"), (3, "l", "h"), (3, "h", "m"), (3, "m", "l"),  # repeat, the header leads straight to the latch
        (4, "p", "l"), (4, "l", "b"), (4, "b", "p"), (4, "b", "x"),  # for
        (5, "s", "s"),  # endless
        (6, "h", "a"), (6, "h", "x"), (6, "a", "h"), (6, "a", "z"), (6, "z", "h"),  # two latches
    ]
    e, start = frames(spark, edges, [(1, "h"), (2, "h"), (3, "h"), (4, "p"), (5, "s"), (6, "h")])
    dom = graph.dominators(e, start)
    ops = spark.createDataFrame([(4, "p", "PREP")], "g long, node string, op string")
    looped = graph.loops(e, dom, ops, {"PREP": "pairs"})
    told = {r.g: (r.header, r.latch, r.kind, r.exit) for r in looped.collect()}
    assert told[1] == ("h", "l", "while", "x") and told[2] == ("h", "b", "repeat", "x") and told[5] == ("s", "s", "while", None)
    assert told[3][:3] == ("h", "l", "repeat") and told[3][3] == "m" and told[4] == ("p", "b", "pairs", "x")
    assert told[6] == ("h", "a", "repeat", "z")
    endless = {tuple(r) for r in graph.endless_loops(e, dom, looped).collect()}
    assert endless == {(5, "s", "s"), (6, "h", "z")}


def test_merge_point_rules(spark):
    edges = [(1, "a", "m"), (1, "b", "k"), (1, "k", "m"), (1, "b", "m2"), (1, "a", "m2"), (1, "m", "b"), (2, "a", "b"), (3, "a", "x"), (3, "b", "y")]
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (2, "b", "b"), (3, "a", "b"), (3, "x", "b"), (3, "x", "y"), (3, "b", "y")], "g long, a string, b string")
    e, gone = frames(spark, edges, [(3, "x"), (3, "y")])
    back = spark.createDataFrame([(1, "m", "b")], "g long, src string, dst string")
    found = {(r.g, r.a, r.b): r.merge for r in graph.merge_point(e, pairs, gone, back).collect()}
    assert found == {(1, "a", "b"): "m2", (2, "a", "b"): "b", (2, "b", "b"): "b", (3, "a", "b"): None, (3, "x", "b"): "b", (3, "x", "y"): None, (3, "b", "y"): "b"}


def plain_merge(edges, back, a, b):
    """The rules by two plain searches in one graph."""
    out = {}
    for x, y in sorted(set(edges) - set(back)):
        out.setdefault(x, []).append(y)

    def search(start):
        order, queue = [start], [start]
        while queue:
            for y in out.get(queue.pop(0), []):
                if y not in order:
                    order.append(y)
                    queue.append(y)
        return order

    behind = set(search(a))
    return a if a == b else next((n for n in search(b) if n in behind), None)


def test_merge_points_of_random_graphs(spark):
    draw = random.Random(8)
    edges, entries, pairs = [], [], []
    for g in range(80):
        size = draw.randint(2, 12)
        names = [f"n{i:02d}" for i in range(size)]
        draw.shuffle(names)  # so names don't follow the order of the graph
        entries.append((g, names[0]))
        for i in range(1, size):
            edges.append((g, names[max(0, i - draw.randint(1, 4))], names[i]))
        for _ in range(draw.randint(0, 12)):
            x, y = sorted(draw.sample(range(size), 2), reverse=draw.random() < 0.15)  # loops too, some of them with two ways in
            edges.append((g, names[x], names[y]))
        pairs += [(g, draw.choice(names), draw.choice(names)) for _ in range(8)]
    e, start = frames(spark, edges, entries)
    wanted = spark.createDataFrame(pairs, "g long, a string, b string")
    dom = graph.dominators(e, start)
    back = graph.back_edges(e, dom)
    left = {}
    for g, x, y in {tuple(r) for r in back.collect()}:
        left.setdefault(g, []).append((x, y))
    expected = {(g, a, b, plain_merge([(x, y) for h, x, y in edges if h == g], left.get(g, []), a, b)) for g, a, b in pairs}
    for tree, small in ((None, 0), (dom, 0), (dom, 8)):  # searched without and with places, the last both ways
        found = {tuple(r) for r in graph.merge_point(e, wanted, None, back, tree, small).collect()}
        assert found == expected, sorted(map(repr, found ^ expected))[:6]
    links = e.join(back, ["g", "src", "dst"], "left_anti").where("src <> dst").withColumnRenamed("src", "node").distinct()
    places = {(r.g, r.node): r.place for r in merging.topological_places(links, dom, 0).collect()}
    ordered = {g for g, _ in places}
    assert len(places) == len(set((g, p) for (g, _), p in places.items())) and 40 < len(ordered) < 80
    assert all(places[r.g, r.node] < places[r.g, r.dst] for r in links.collect() if r.g in ordered and (r.g, r.node) in places)


def test_small_graphs_meet_without_rounds(spark, monkeypatch):
    """Two runs of 25 nodes that meet at their end: as many tables are written as for runs of one node."""
    written = []
    monkeypatch.setattr(merging, "settled", lambda df, name="round": written.append(name) or fixpoint.settled(df, name))
    monkeypatch.setattr("weirflow.operators.dominance.settled", lambda df, name="round": written.append(name) or fixpoint.settled(df, name))
    ways = [[f"{side}{i:02}" for i in range(25)] + ["z"] for side in "ab"]
    edges = [(0, s, d) for way in ways for s, d in zip(way, way[1:])] + [(1, "a00", "z"), (1, "b00", "z"), (2, "a00", "b00"), (2, "b00", "x")]
    e = spark.createDataFrame(edges, "g long, src string, dst string")
    pairs = spark.createDataFrame([(g, "a00", "b00") for g in (0, 1, 2, 3)], "g long, a string, b string")
    assert {r.g: r.merge for r in graph.merge_point(e, pairs).collect()} == {0: "z", 1: "z", 2: "b00", 3: None}
    assert len(written) < 12


def test_merge_points_of_one_large_graph(spark, monkeypatch):
    size = 2_000  # decisions in a row, each with a shorter and a longer side
    h = lambda i, side: f"{i:05d}{side}"
    edges = [(1, h(i, x), y) for i in range(size) for x, y in (("a", h(i, "b")), ("a", h(i, "c")), ("b", h(i + 1, "a")), ("c", h(i, "d")), ("d", h(i + 1, "a")))]
    e, start = frames(spark, edges, [(1, h(0, "a"))])
    dom = graph.dominators(e, start)
    pairs = spark.createDataFrame([(1, *sorted([h(i, "b"), h(i, "c")], reverse=bool(i % 2))) for i in range(size)], "g long, a string, b string")
    most = []
    judged = merging._judged
    monkeypatch.setattr(merging, "_judged", lambda state: (most.append(state.count()), judged(state))[1])
    found = {(r.a[:5], r.merge) for r in graph.merge_point(e, pairs, None, None, dom).collect()}
    assert found == {(f"{i:05d}", h(i + 1, "a")) for i in range(size)}
    assert len(most) <= 5 and max(most) <= 8 * size, most


def test_chains_of_decisions_and_member_paths(spark):
    rows = [(1, "a", "t", "b", True), (1, "b", "t", "c", True), (1, "c", "e", "t", True), (2, "a", "t", "b", True), (2, "b", "t", "x", True), (3, "a", "t", "b", True), (3, "b", "e", "t", False), (4, "a", "t", "b", True), (4, "b", "t", "a", True)]
    decisions = spark.createDataFrame(rows, "g long, node string, on_true string, on_false string, comparison boolean")
    found = {tuple(r) for r in graph.shared_target_chains(decisions).collect()}
    assert found == {(1, "a", "t", 3, "a,b,c", "e"), (1, "b", "t", 2, "b,c", "e")}
    size = 70
    ladder = [(9, f"{i:02d}", "m", f"{i + 1:02d}", True) for i in range(size)]
    merges = spark.createDataFrame([(9, r[1], "m") for r in ladder] + [(1, "a", "t"), (4, "a", "t"), (4, "b", "t")], "g long, node string, merge string")
    depth = {(r.g, r.node): (r.depth, r.is_deep) for r in graph.dispatch_depth(decisions.unionByName(spark.createDataFrame(ladder, decisions.schema)), merges).collect()}
    assert depth[(9, "00")] == (69, True) and depth[(9, "69")] == (0, False) and depth[(1, "a")] == (0, False) and depth[(4, "a")] == (None, None)
    reads = spark.createDataFrame([(1, "z", "y", "c", False), (1, "y", "x", "k", True), (1, "x", "root", "a", False), (2, "p", "q", "h", False), (2, "q", "p", "h", False)], "g long, node string, base string, hop string, keyed boolean")
    assert {tuple(r) for r in graph.member_paths(reads).collect()} == {(1, "z", "root", ".a[k].c", 3), (1, "y", "root", ".a[k]", 2), (1, "x", "root", ".a", 1)}


def test_contraction_of_chains_and_of_a_cycle(spark):
    edges = [(1, "a", "x"), (1, "x", "y"), (1, "y", "b"), (1, "a", "b"), (2, "a", "p"), (2, "p", "q"), (2, "q", "r"), (2, "r", "p")]
    removable = [(1, "x"), (1, "y"), (2, "p"), (2, "q"), (2, "r")]
    e, gone = frames(spark, edges, removable)
    assert {tuple(r) for r in graph.contract_passthrough(e, gone).collect()} == {(1, "a", "b"), (2, "a", "r"), (2, "r", "r")}


def test_damaged_graphs_are_told(spark):
    nodes = spark.createDataFrame([(1, "a", "S"), (1, "b", "RETURN"), (2, "a", "S"), (2, "c", "S")], "g long, node string, type string")
    good, start = frames(spark, [(1, "a", "b"), (2, "a", "c")], [(1, "a"), (2, "a")])
    assert graph.check_graph(nodes, good, start, nodes["type"] == "RETURN").count() == 0
    bad, twice = frames(spark, [(1, "b", "a"), (1, "a", "b"), (2, "a", "z")], [(1, "a"), (2, "a"), (2, "c")])
    found = {tuple(r) for r in graph.check_graph(nodes, bad, twice, nodes["type"] == "RETURN").collect()}
    assert found == {(1, "return_goes_on", "b"), (2, "edge_end_unknown", "z"), (2, "several_entries", "c")}
    lost, one = frames(spark, [(1, "a", "b")], [(1, "a"), (2, "a")])
    assert {tuple(r) for r in graph.check_graph(nodes, lost, one).collect()} == {(2, "unreached", "c")}


def test_a_fixpoint_that_does_not_settle_raises(spark):
    seed = spark.createDataFrame([(0,)], "n long")
    with pytest.raises(RuntimeError, match="still grows"):
        fixpoint.grow(seed, lambda new, _: new.selectExpr("n + 1 as n"), most_rounds=3)


def test_empty_tables(spark):
    e, start = frames(spark, [], [])
    assert graph.reachable(e, start).count() == graph.dominators(e, start).count() == 0
    assert graph.contract_passthrough(e, start).count() == 0


def test_chains_keep_nodes_without_links(spark):
    links = spark.createDataFrame([(1, 3, 5), (1, 5, 6)], "g long, node long, next long")
    terms = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 6, "c"), (2, 9, "d")], "g long, node long, term string")
    assert {tuple(r) for r in graph.resolve_aliases(links, terms).collect()} == {(1, 3, 6, 2), (1, 5, 6, 1), (1, 6, 6, 0), (2, 9, 9, 0)}
    assert {tuple(r) for r in graph.chain_terms(links, terms, alone=True).collect()} == {(1, 6, 3, "a,b,c"), (2, 9, 1, "d")}


def test_diamonds_of_truth_values(spark):
    edges = [(g, *e) for g in range(1, 7) for e in [("h", "f"), ("h", "t"), ("f", "t"), ("t", "x")]] + [(6, "z", "t")]
    loads = [(g, "f", 1, 0, False) for g in (1, 2, 4, 5, 6)] + [(3, "f", 2, 0, False)] + [(g, "t", 3, 0, True) for g in (1, 3, 5, 6)] + [(2, "t", 1, 0, False), (4, "t", 1, 1, True)]
    e, _ = frames(spark, edges, [(1, "h")])
    found = graph.boolean_diamonds(e, spark.createDataFrame(loads, "g long, node string, n_records long, reg long, value boolean")).collect()
    assert {tuple(r) for r in found} == {(1, "h", "f", "t", 0, True), (5, "h", "f", "t", 0, True)}


def test_breaks_and_continues_of_forward_jumps(spark):
    # h: header, b decides between c (continues at l) and d (breaks to x), l: latch
    edges = [(1, "a", "h"), (1, "h", "b"), (1, "h", "x"), (1, "b", "c"), (1, "b", "d"), (1, "c", "l"), (1, "d", "x"), (1, "l", "h"), (1, "x", "y")]
    e, start = frames(spark, edges, [(1, "a")])
    dom = graph.dominators(e, start)
    looped = graph.loops(e, dom)
    jumps = e.where("src in ('a', 'c', 'd', 'x')")
    found = {tuple(r) for r in graph.jump_roles(jumps, graph.innermost_loop(dom, looped.select("g", "header")), looped, dom).collect()}
    assert found == {(1, "c", "l", "h", "continue"), (1, "d", "x", "h", "break"), (1, "x", "y", "h", "continue")}


def test_long_chains_of_decisions(spark):
    size = 600
    rows = [(1, f"{i:04d}", "t", f"{i + 1:04d}", True) for i in range(size)] + [(1, f"{size:04d}", "e", "t", True)]
    found = {r.head: (r.n, r.otherwise) for r in graph.shared_target_chains(spark.createDataFrame(rows, "g long, node string, on_true string, on_false string, comparison boolean")).collect()}
    assert found == {f"{i:04d}": (size + 1 - i, "e") for i in range(size)}


def test_folding_takes_rounds_by_nesting(spark):
    """A chain of 50,000 nodes, and one of diamonds of which an arm leads back: the idoms follow from the shape."""
    chain = [(1, i, i + 1) for i in range(50_000)]
    diamonds = [(2, k + a, k + b) for k in range(0, 6_000, 3) for a, b in [(0, 1), (0, 2), (1, 3), (2, 3), (1, 0)]]
    e = spark.createDataFrame(chain + diamonds, "g long, src long, dst long")
    tree = graph.dominators(e, spark.createDataFrame([(1, 0), (2, 0)], "g long, node long"))
    one = tree.where("g = 1 and node > 0").where("idom <> node - 1 or depth <> node or pre <> node or last <> 50000")
    assert one.isEmpty() and tree.where("g = 1").count() == 50_001
    two = tree.where("g = 2 and node > 0").where("idom <> node - (node - 1) % 3 - 1 or depth <> floor((node - 1) / 3) + 1")
    assert two.isEmpty() and tree.where("g = 2").count() == 6_001
    assert graph.back_edges(e, tree).count() == 2_000
