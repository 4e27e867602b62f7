"""Queries over windows, joins, aggregations, order and sets, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weirflow.operators import aggregates, joins, ordering, segment
from weirflow.plans import fixtures as fx
from weirflow.plans.fixpoint import settled
from weirflow.plans.scan import running, total


def _error() -> Column:
    return F.expr("op = 'error'")


def _defs(spark: SparkSession, d: str) -> DataFrame:
    return segment.number_versions(fx.du(spark, d).where("mode = 'W'").select("g", "pc", "reg"))


def _uses(spark: SparkSession, d: str) -> DataFrame:
    reads = fx.du(spark, d).where("mode = 'R'").select("g", "pc", "reg")
    return joins.as_of(reads, _defs(spark, d), ["g", "reg"], "pc", "version", 0)


def _blk(spark: SparkSession, d: str) -> DataFrame:
    return segment.assign_blocks(fx.ir(spark, d), _error())


def w1(s, d):
    return _blk(s, d)


#: Rows above which a graph is cut into stretches in the queries on all events as one graph.
HOT_HERE = 500


def _one_graph(s, d):
    events = fx.table(s, d, "events").select(F.lit(0).alias("g"), "ts", "event_id", F.col("event_type").alias("op"), (F.get_json_object("props", "$.k").cast("long") % 8).alias("reg"))
    placed = running(events, ["g"], ["ts", "event_id"], HOT_HERE, n=total(F.lit(1).cast("long")))
    return settled(placed.select("g", (F.col("n") - 1).alias("pc"), "event_id", "op", "reg"))


def w1_one(s, d):
    return segment.assign_blocks(_one_graph(s, d), _error(), hot=HOT_HERE)


def j6_one(s, d):
    rows = _one_graph(s, d)
    defs = segment.number_versions(rows.where("op in ('signup', 'purchase')").select("g", "pc", "reg"), hot=HOT_HERE)
    return joins.as_of(rows.where("op in ('click', 'view')").select("g", "pc", "reg"), defs, ["g", "reg"], "pc", "version", 0, hot=HOT_HERE)


def w1_targets(s, d):
    # each purchase leads k records back, so a block begins there too
    aimed = fx.ir(s, d).where("op = 'purchase'").select("g", F.greatest(F.col("pc") - F.col("k") % 10, F.lit(0)).alias("pc"))
    return segment.assign_blocks(fx.ir(s, d), _error(), aimed)


def _plain_blocks(s, d):
    return segment.classify_blocks(segment.with_blocks(fx.ir(s, d), _error()), {"error": "ERROR"})


def w2(s, d):
    rows = fx.ir(s, d).withColumn("off", F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(-F.col("k")))
    return segment.classify_blocks(segment.with_blocks(rows, _error()), {"error": "ERROR"}, offset="off", loop_ops=["signup", "click"])


def w3(s, d):
    return segment.decode_line_deltas(fx.ir(s, d), "k", 2)


def w4(s, d):
    return _defs(s, d)


def w5(s, d):
    return segment.high_water(fx.ir(s, d), F.expr("op = 'purchase'"))


def w6(s, d):
    return segment.pair_with_previous(fx.ir(s, d), 2)


def w7(s, d):
    return segment.trailing_run(fx.ir(s, d), "signup", "click")


def w8(s, d):
    return segment.collect_until_barrier(fx.ir(s, d), F.expr("op = 'signup'"), F.expr("op = 'purchase'"), _error())


def w8_folded(s, d):
    rows = fx.ir(s, d)
    return segment.collect_until_barrier(rows, F.expr("op = 'signup'"), F.expr("op = 'purchase'"), _error(), 20, redefines=F.expr("op in ('signup', 'purchase')"), foldable=F.expr("k < 70"))


def w9(s, d):
    return segment.fallthrough(_blk(s, d))


def w10(s, d):
    given = fx.ir(s, d).select("g", F.lit(3).cast("long").alias("reg")).distinct()  # register 3 is a parameter of each graph
    return segment.first_write(fx.du(s, d).where("mode = 'W'"), given)


def j1(s, d):
    rows = fx.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, 0).when(F.col("o_orderkey") % 10 == 1, -1).otherwise(F.col("o_custkey")).alias("sid"))
    return joins.lookup(rows, "sid", fx.table(s, d, "customer"), "c_custkey", "c_name")


def j2(s, d):
    rows = fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"))
    return joins.lookup(rows, "k", fx.table(s, d, "part"), "p_partkey", "p_name").select("l_orderkey", "l_linenumber", "p_name", "status")


def j3(s, d):
    # the parts of all lines of an order, zipped with the suppliers of those that were not returned
    rows = fx.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("g"), "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.max("l_returnflag").alias("f"))
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p", "s", "f"))).alias("e"))
    kept = F.filter("e", lambda e: e["f"] != "R")
    template = lists.select("g", F.transform("e", lambda e: e["p"]).alias("ks"), F.transform(kept, lambda e: F.when(e["s"] % 7 == 0, -1).otherwise(e["s"])).alias("vs"))
    return joins.zip_template(template, "ks", "vs", fx.table(s, d, "supplier"), "s_suppkey", "s_name")


def j3_all(s, d):
    # all lines of an order are keys; in one order of seven the last has no value
    rows = fx.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("g"), "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p", "s"))).alias("e"))
    template = lists.select("g", F.transform("e", lambda e: e["p"]).alias("ks"), F.slice(F.transform("e", lambda e: F.when(e["s"] % 7 == 0, -1).otherwise(e["s"])), F.lit(1), F.greatest(F.size("e") - (F.col("g") % 7 == 0).cast("int"), F.lit(0))).alias("vs"))
    return joins.zip_template(template, "ks", "vs", fx.table(s, d, "supplier"), "s_suppkey", "s_name")


def j4(s, d):
    return joins.def_use(_defs(s, d), _uses(s, d))


def j5(s, d):
    blocks = _blk(s, d).where("b % 3 <> 2")
    return joins.block_of(fx.ir(s, d), blocks)


def j6(s, d):
    return _uses(s, d)


def j7(s, d):
    scopes = _defs(s, d).select("g", "reg", F.concat(F.lit("v"), F.col("version").cast("string")).alias("name"), F.col("pc").alias("start_pc"), (F.col("pc") + 5).alias("end_pc"))
    return joins.in_scope(fx.du(s, d).where("mode = 'R'").select("g", "pc", "reg"), scopes)


def j8(s, d):
    orders = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("unit"), "o_custkey")
    items = fx.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.count("*").alias("n_children"))
    return joins.links(items, orders, ["unit"])


def j9(s, d):
    stem = lambda t, key, name: fx.table(s, d, t).select(F.col(key).alias("id"), F.concat(F.lit("n"), F.regexp_extract(name, "([0-9]+)$", 1).cast("long").cast("string")).alias("name"))
    return joins.name_collisions(stem("customer", "c_custkey", "c_name"), stem("supplier", "s_suppkey", "s_name"))


def j11(s, d):
    return joins.same_source(fx.table(s, d, "lineitem"), "l_orderkey", "l_returnflag", 3)


def j11_all(s, d):
    return joins.same_source(fx.table(s, d, "lineitem"), "l_orderkey", "l_suppkey", 2)


def a1(s, d):
    return aggregates.use_counts(_uses(s, d))


def a2(s, d):
    return aggregates.type_union(fx.ir(s, d).select("g", F.col("pc").alias("pos"), F.when(F.col("op") == "error", "nil").otherwise(F.col("op")).alias("type")))


def a3(s, d):
    stem = F.element_at(F.split("p_name", " "), 1)
    return aggregates.unique_owner(fx.table(s, d, "part").select(F.concat(stem, F.lit("_"), F.col("p_size").cast("string"), F.lit("_"), "p_brand").alias("name"), F.col("p_partkey").alias("owner")), "name", "owner")


def a4(s, d):
    return aggregates.block_stats(_plain_blocks(s, d))


def a5_facts(s, d):
    """A user's week as a unit: the registers read before they are written are its parameters, views are captures; a user's first week is the main unit."""
    rows = fx.ir(s, d)
    first = fx.du(s, d).groupBy("g", "reg").agg(F.min_by("mode", "pc").alias("mode")).groupBy("g").agg(F.count_if(F.col("mode") == "R").alias("n_params"))
    units = rows.groupBy("g").agg(
        F.count_if(F.col("op") == "view").alias("n_captured"), (F.max("reg") + 1).alias("n_registers"), F.bool_or(F.col("op") == "error").alias("variadic"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") == "signup", F.col("pc")))), lambda x: x.cast("string")), ",").alias("types"), F.max("k").alias("version"), F.min("k").alias("types_version"),
    ).join(first, "g", "left").withColumn("n_params", F.coalesce("n_params", F.lit(0).cast("long")))
    mains = units.groupBy(F.floor(F.col("g") / 100).alias("user")).agg(F.min("g").alias("g")).select("g", F.lit(True).alias("is_main"))
    return aggregates.unit_facts(units.join(mains, "g", "left"))


def a5(s, d):
    return aggregates.unit_summary(fx.ir(s, d), "error", "purchase")


def a6(s, d):
    ops = fx.ir(s, d).select("g", "pc", "op")
    return aggregates.consumed_by(_uses(s, d).join(ops, ["g", "pc"]), F.expr("op = 'view'"))


def a7(s, d):
    return aggregates.only_feeds(_uses(s, d), _blk(s, d).select("g", F.col("tail_pc").alias("pc")))


def a8(s, d):
    ops = fx.ir(s, d).select("g", "pc", "op", "k")
    return aggregates.real_uses(_uses(s, d).join(ops, ["g", "pc"]), F.expr("op = 'view'"), F.expr("k % 5 = 0"))


def a9(s, d):
    return aggregates.self_overwrites(_uses(s, d), _defs(s, d))


def o1(s, d):
    edges = fx.fe(s, d)
    return ordering.order_predecessors(edges, edges.where("src >= dst").groupBy("g", "dst").agg(F.min("src").alias("src")))


def o2(s, d):
    rules = s.createDataFrame([(1, "signup", "first"), (2, "click", "press"), (3, "click", "dead"), (0, "purchase", "buy"), (9, "signup", "never")], "priority int, method string, result string")
    return ordering.first_rule(fx.ir(s, d), ["event_id"], rules, "op")


def o3(s, d):
    return ordering.bounded_reach(settled(fx.fe(s, d).select("g", "src", "dst")), fx.ent(s, d), 3)


def x1(s, d):
    edges = fx.fe(s, d)
    return ordering.common_reach(edges.where("src like 'click%'").select("g", F.col("dst").alias("node")), edges.where("src like 'view%'").select("g", F.col("dst").alias("node")))


def x2(s, d):
    return ordering.unreached(fx.nodes(s, d), fx.fe(s, d).select("g", F.col("dst").alias("node")))


def x3(s, d):
    rows = fx.ir(s, d)
    return ordering.merge_facts(rows.where("op = 'click'").select("g", F.col("pc").alias("pos"), F.col("node").alias("type")), rows.where("reg = 3").select("g", F.col("pc").alias("pos"), F.col("op").alias("type")))


_USES_OP = "SELECT u.*, ir.op, ir.k FROM uses u JOIN ir ON ir.g = u.g AND ir.pc = u.pc"
#: name: query, SQL, the views that the SQL reads
QUERIES = {
    "w1_assign_blocks": (w1, "SELECT * FROM blk", ("blk",)),
    "w1_one_graph": (w1_one, """, e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pc, op FROM ir), l AS (SELECT pc, coalesce(sum(CASE WHEN op = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY pc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
      SELECT 0 AS g, CAST(b AS BIGINT) AS b, min(pc) AS head_pc, max(pc) AS tail_pc FROM l GROUP BY b""", ("ir",)),
    "j6_one_graph": (j6_one, """, e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pc, op, reg FROM ir)
      SELECT 0 AS g, pc, reg, version FROM (SELECT pc, reg, op, CAST(count(*) FILTER (WHERE op IN ('signup', 'purchase')) OVER (PARTITION BY reg ORDER BY pc) AS BIGINT) AS version FROM e) WHERE op IN ('click', 'view')""", ("ir",)),
    "w1_jump_targets": (w1_targets, """, aim AS (SELECT DISTINCT g, greatest(pc - k % 10, 0) AS pc FROM ir WHERE op = 'purchase'),
      l AS (SELECT g, pc, CAST(sum(CASE WHEN pc = 0 OR p = 'error' OR (g, pc) IN (SELECT g, pc FROM aim) THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY pc) - 1 AS BIGINT) AS b
        FROM (SELECT g, pc, lag(op) OVER (PARTITION BY g ORDER BY pc) AS p FROM ir))
      SELECT g, b, min(pc) AS head_pc, max(pc) AS tail_pc FROM l GROUP BY g, b""", ("ir",)),
    "w2_classify_blocks": (w2, """, t AS (SELECT r.g, r.b, max_by(r.op, r.pc) AS op, min_by(r.op, r.pc) AS first, max_by(ir.k, r.pc) AS k FROM blkrow r JOIN ir ON ir.g = r.g AND ir.pc = r.pc GROUP BY r.g, r.b)
      SELECT g, b, CASE op WHEN 'error' THEN 'ERROR' ELSE 'FALL' END AS terminator, CASE WHEN lead(b) OVER w IS NULL THEN 'RETURN' WHEN op <> 'error' THEN 'STANDARD'
        WHEN lead(first) OVER w NOT IN ('signup', 'click') THEN 'LEAP' WHEN k % 2 = 1 AND k > 0 THEN 'CONTINUE' ELSE 'BREAK' END AS type FROM t WINDOW w AS (PARTITION BY g ORDER BY b)""", ("ir", "blkrow")),
    "w3_line_deltas": (w3, """, r AS (SELECT g, pc, pc // 4 AS i, k, CAST(sum(k) OVER (PARTITION BY g ORDER BY pc) % 256 AS BIGINT) AS low FROM ir),
      s AS (SELECT g, i, coalesce(sum(max_by(k, pc)) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM r GROUP BY g, i)
      SELECT r.g, r.pc, CAST(low + base AS BIGINT) AS line FROM r JOIN s ON s.g = r.g AND s.i = r.i""", ("ir",)),
    "w4_number_versions": (w4, "SELECT * FROM defs", ("defs",)),
    "w5_high_water": (w5, "SELECT g, pc, span FROM (SELECT g, pc, op, max(reg) OVER (PARTITION BY g ORDER BY pc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - reg AS span FROM ir) WHERE op = 'purchase'", ("ir",)),
    "w6_pair_with_previous": (w6, "SELECT g, pc, q AS paired_pc FROM (SELECT g, pc, lag(pc, 2) OVER w AS q, lag(op, 2) OVER w = op AND lag(reg, 2) OVER w = reg AS same FROM ir WINDOW w AS (PARTITION BY g ORDER BY pc)) WHERE same", ("ir",)),
    "w7_trailing_run": (w7, """, l AS (SELECT g, pc, op, max(CASE WHEN op <> 'click' THEN pc END) OVER (PARTITION BY g ORDER BY pc) AS a FROM ir)
      SELECT l.g, l.a AS anchor_pc, l.pc, l.pc - l.a - 1 AS ord FROM l JOIN ir ON ir.g = l.g AND ir.pc = l.a WHERE l.op = 'click' AND ir.op = 'signup'""", ("ir",)),
    "w8_collect_until_barrier": (w8, """SELECT a.g, a.pc AS anchor_pc, count(b.pc) AS n, coalesce(string_agg(CAST(b.pc AS VARCHAR), ',' ORDER BY b.pc), '') AS pcs
      FROM ir a LEFT JOIN ir b ON b.g = a.g AND b.pc > a.pc AND b.pc <= a.pc + 100 AND b.op = 'purchase'
        AND NOT EXISTS (SELECT 1 FROM ir e WHERE e.g = a.g AND e.op = 'error' AND e.pc > a.pc AND e.pc < b.pc)
      WHERE a.op = 'signup' GROUP BY a.g, a.pc""", ("ir",)),
    "w8_collect_folded": (w8_folded, """, a AS (SELECT ir.*, (SELECT min(e.pc) FROM ir e WHERE e.g = ir.g AND e.pc > ir.pc AND (e.op = 'error' AND e.pc <= ir.pc + 20 OR e.reg = ir.reg AND e.op IN ('signup', 'purchase'))) AS stop FROM ir WHERE op = 'signup')
      SELECT a.g, a.pc AS anchor_pc, CASE WHEN bool_and(b.k < 70) THEN count(b.pc) ELSE 0 END AS n, CASE WHEN bool_and(b.k < 70) THEN string_agg(CAST(b.pc AS VARCHAR), ',' ORDER BY b.pc) ELSE '' END AS pcs
      FROM a LEFT JOIN ir b ON b.g = a.g AND b.pc > a.pc AND b.pc <= a.pc + 20 AND b.op = 'purchase' AND (stop IS NULL OR b.pc < stop) GROUP BY a.g, a.pc""", ("ir",)),
    "w9_fallthrough": (w9, "SELECT g, b, lead(b) OVER (PARTITION BY g ORDER BY b) AS next_b FROM blk", ("blk",)),
    "w10_first_write": (w10, "SELECT g, pc, reg, version = 1 AND reg <> 3 AS declares FROM defs", ("defs",)),
    "j1_lookup_string": (j1, """SELECT o_orderkey, sid, c_name, CASE WHEN c_custkey IS NOT NULL THEN 'ok' WHEN sid = 0 THEN 'null' ELSE 'missing' END AS status
      FROM (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE o_custkey END AS sid FROM orders) LEFT JOIN customer ON c_custkey = sid""", None),
    "j2_lookup_constant": (j2, "SELECT l_orderkey, l_linenumber, p_name, CASE WHEN p_partkey IS NOT NULL THEN 'ok' WHEN l_partkey = 0 THEN 'null' ELSE 'missing' END AS status FROM lineitem LEFT JOIN part ON p_partkey = l_partkey", None),
    "j3_zip_template": (j3, """WITH r AS (SELECT l_orderkey AS g, l_linenumber AS l, min(l_partkey) AS p, min(l_suppkey) AS s, max(l_returnflag) AS f FROM lineitem GROUP BY ALL),
      k AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY l) - 1 AS pos, p AS key FROM r),
      v AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY l) - 1 AS pos, CASE WHEN s % 7 = 0 THEN -1 ELSE s END AS i FROM r WHERE f <> 'R')
      SELECT k.g, k.pos, key, s_name AS value FROM k JOIN v ON v.g = k.g AND v.pos = k.pos LEFT JOIN supplier ON s_suppkey = i""", None),
    "j3_all_lines": (j3_all, """WITH r AS (SELECT l_orderkey AS g, l_linenumber AS l, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
      n AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY l) - 1 AS pos, count(*) OVER (PARTITION BY g) AS many, p AS key, CASE WHEN s % 7 = 0 THEN -1 ELSE s END AS i FROM r)
      SELECT g, pos, key, s_name AS value FROM n LEFT JOIN supplier ON s_suppkey = i WHERE pos < many - CASE WHEN g % 7 = 0 THEN 1 ELSE 0 END""", None),
    "j4_def_use": (j4, "SELECT u.g, u.reg, u.version, d.pc AS def_pc, u.pc AS use_pc FROM uses u JOIN defs d ON d.g = u.g AND d.reg = u.reg AND d.version = u.version", ("uses",)),
    "j5_block_of": (j5, "SELECT ir.g, ir.pc, coalesce(b, -1) AS b FROM ir LEFT JOIN blk ON blk.g = ir.g AND ir.pc BETWEEN head_pc AND tail_pc AND b % 3 <> 2", ("ir", "blk")),
    "j6_asof_version": (j6, "SELECT g, pc, reg, version FROM uses", ("uses",)),
    "j7_local_in_scope": (j7, "SELECT u.g, u.pc, u.reg, 'v' || d.version AS name FROM du u JOIN defs d ON d.g = u.g AND d.reg = u.reg AND d.pc <= u.pc AND u.pc < d.pc + 5 WHERE mode = 'R'", ("du", "defs")),
    "j8_closure_links": (j8, "SELECT o_orderkey AS unit, o_custkey, count(*) AS n_children FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL", None),
    "j9_name_collisions": (j9, """WITH own AS (SELECT c_custkey AS id, 'n' || CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS name FROM customer),
      cap AS (SELECT 'n' || CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS name FROM supplier)
      SELECT id, name, CASE WHEN EXISTS (SELECT 1 FROM cap WHERE cap.name = own.name) THEN name || '_' || id ELSE name END AS resolved FROM own""", None),
    "j11_same_source": (j11, "SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS source FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3 AND count(DISTINCT l_returnflag) = 1", None),
    "j11_all_lines": (j11_all, "SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS source FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND count(DISTINCT l_suppkey) = 1", None),
    "a1_use_counts": (a1, "SELECT g, reg, version, count(*) AS n, count(*) = 1 AS single FROM uses GROUP BY g, reg, version", ("uses",)),
    "a2_type_union": (a2, """, t AS (SELECT g, op, min(pc) AS p FROM ir GROUP BY g, op)
      SELECT g, CASE WHEN bool_or(op <> 'error') THEN string_agg(op, '|' ORDER BY p) FILTER (WHERE op <> 'error') || CASE WHEN bool_or(op = 'error') THEN '|nil' ELSE '' END END AS types FROM t GROUP BY g""", ("ir",)),
    "a3_unique_owner": (a3, "SELECT split_part(p_name, ' ', 1) || '_' || p_size || '_' || p_brand AS name, min(p_partkey) AS owner FROM part GROUP BY 1 HAVING count(*) = 1", None),
    "a4_block_stats": (a4, """SELECT g, CASE WHEN b = m THEN 'RETURN' WHEN t <> 'FALL' THEN 'BREAK' ELSE 'STANDARD' END AS type, count(*) AS n
      FROM (SELECT g, b, CASE max_by(op, pc) WHEN 'error' THEN 'ERROR' ELSE 'FALL' END AS t, max(b) OVER (PARTITION BY g) AS m FROM blkrow GROUP BY g, b) GROUP BY ALL""", ("blkrow",)),
    "a5_unit_summary": (a5, """SELECT g, count(*) AS n_records, count(DISTINCT op) AS n_ops, max(reg) AS max_reg, count(DISTINCT reg) AS n_regs, bool_or(op = 'error') AS has_error,
      count(*) FILTER (WHERE op = 'purchase') AS n_purchases FROM ir GROUP BY g""", ("ir",)),
    "a5_unit_facts": (a5_facts, """, f AS (SELECT g, count(*) FILTER (WHERE m = 'R') AS n_params FROM (SELECT g, reg, arg_min(mode, pc) AS m FROM du GROUP BY g, reg) GROUP BY g),
      u AS (SELECT g, count(*) FILTER (WHERE op = 'view') AS n_captured, max(reg) AS top_register, bool_or(op = 'error') AS "variadic", bool_or(op = 'signup') AS has_types, max(k) AS v, min(k) AS t FROM ir GROUP BY g)
      SELECT u.g, coalesce(n_params, 0) AS n_params, n_captured, top_register, "variadic", has_types, CASE WHEN u.g = min(u.g) OVER (PARTITION BY u.g // 100) THEN 'version ' || v || ', types version ' || t END AS banner
      FROM u LEFT JOIN f ON f.g = u.g""", ("ir", "du")),
    "a6_consumed_by": (a6, f"SELECT g, reg, version, bool_or(op = 'view') AS consumed FROM ({_USES_OP}) GROUP BY g, reg, version", ("uses",)),
    "a7_only_feeds": (a7, "SELECT u.g, reg, version, bool_and(blk.tail_pc IS NOT NULL) AS only_tail FROM uses u LEFT JOIN blk ON blk.g = u.g AND blk.tail_pc = u.pc GROUP BY u.g, reg, version", ("uses", "blk")),
    "a8_real_uses": (a8, f"SELECT g, reg, version, count(*) FILTER (WHERE op <> 'view') AS n_real, bool_or(k % 5 = 0) AS vetoed FROM ({_USES_OP}) GROUP BY g, reg, version", ("uses",)),
    "a9_self_overwrites": (a9, """SELECT g, reg, version, bool_or(EXISTS (SELECT 1 FROM defs d WHERE d.g = u.g AND d.reg = u.reg AND d.pc = u.pc + 1)) AS overwritten
      FROM uses u GROUP BY g, reg, version""", ("uses",)),
    "o1_order_predecessors": (o1, """, l AS (SELECT g, dst, min(src) AS latch FROM fe WHERE src >= dst GROUP BY g, dst)
      SELECT fe.g, fe.dst, src, row_number() OVER (PARTITION BY fe.g, fe.dst ORDER BY coalesce(src = latch, false), src) - 1 AS ord FROM fe LEFT JOIN l ON l.g = fe.g AND l.dst = fe.dst""", ("fe",)),
    "o2_first_rule": (o2, """, rules(priority, method, result) AS (VALUES (1, 'signup', 'first'), (2, 'click', 'press'), (3, 'click', 'dead'), (0, 'purchase', 'buy'), (9, 'signup', 'never'))
      SELECT event_id, arg_min(result, priority) AS result FROM ir JOIN rules ON op = method GROUP BY event_id""", ("ir",)),
    "o3_bounded_reach": (o3, """, lev AS (SELECT g, node, 0 AS d FROM ent UNION SELECT l.g, fe.dst, d + 1 FROM lev l JOIN fe ON fe.g = l.g AND fe.src = l.node WHERE d < 12),
      f AS (SELECT g, node, min(d) AS d FROM lev GROUP BY g, node), c AS (SELECT g, d, sum(count(*)) OVER (PARTITION BY g ORDER BY d) AS n FROM f GROUP BY g, d)
      SELECT g, CAST(coalesce(min(n) FILTER (WHERE n >= 3), max(n)) AS BIGINT) AS n, coalesce(min(n) FILTER (WHERE n >= 3), max(n)) < max(n) AS truncated FROM c GROUP BY g""", ("fe", "ent")),
    "x1_common_reach": (x1, "SELECT g, dst AS node FROM fe WHERE src LIKE 'click%' INTERSECT SELECT g, dst FROM fe WHERE src LIKE 'view%'", ("fe",)),
    "x2_unreached": (x2, "SELECT g, node FROM nodes EXCEPT SELECT g, dst FROM fe", ("nodes", "fe")),
    "x3_merge_facts": (x3, "SELECT g, 0 AS source, pc AS pos, node AS type FROM ir WHERE op = 'click' UNION ALL SELECT g, 1, pc, op FROM ir WHERE reg = 3", ("ir",)),
}
