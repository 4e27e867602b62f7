"""Ordered records and graphs derived from the given tables, and the same as SQL.

ir: events in order per user and ISO week, the graph g. fe: its directly-follows edges. ent: each graph's first
node. blk: blocks that begin at the start and behind an error. du: writes and reads of registers. wd: 32-bit words
made of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SQL = {
    "ir": """SELECT g, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) - 1 AS pc, event_id, ts, op, k, op || ':' || (k % 2) AS node, k % 8 AS reg, val
      FROM (SELECT user_id * 100 + week(ts) AS g, event_id, ts, event_type AS op, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS val FROM events)""",
    "fe": """SELECT g, src, dst, count(*) AS n FROM (SELECT g, node AS src, lead(node) OVER (PARTITION BY g ORDER BY pc) AS dst FROM ir) WHERE dst IS NOT NULL GROUP BY ALL""",
    "ent": "SELECT g, node FROM ir WHERE pc = 0",
    "blkrow": """SELECT g, pc, op, CAST(sum(leader) OVER (PARTITION BY g ORDER BY pc) - 1 AS BIGINT) AS b FROM (SELECT g, pc, op,
      CASE WHEN pc = 0 OR lag(op) OVER (PARTITION BY g ORDER BY pc) = 'error' THEN 1 ELSE 0 END AS leader FROM ir)""",
    "blk": "SELECT g, b, min(pc) AS head_pc, max(pc) AS tail_pc FROM blkrow GROUP BY g, b",
    "du": "SELECT g, pc, reg, CASE WHEN op IN ('signup', 'purchase') THEN 'W' ELSE 'R' END AS mode FROM ir WHERE op <> 'error'",
    "wd": "SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, (o_orderkey * 2654435761) % 4294967296 AS word FROM orders",
    "defs": "SELECT g, pc, reg, row_number() OVER (PARTITION BY g, reg ORDER BY pc) AS version FROM du WHERE mode = 'W'",
    "uses": """SELECT u.g, u.pc, u.reg, coalesce((SELECT max(d.version) FROM defs d WHERE d.g = u.g AND d.reg = u.reg AND d.pc < u.pc), 0) AS version
      FROM du u WHERE mode = 'R'""",
    "reach": "SELECT g, node FROM ent UNION SELECT fe.g, fe.dst FROM reach r JOIN fe ON fe.g = r.g AND fe.src = r.node",
    "nodes": "SELECT DISTINCT g, node FROM ir",
    "avoid": """SELECT n.g, n.node AS d, e.node AS n FROM nodes n JOIN ent e ON e.g = n.g WHERE e.node <> n.node
      UNION SELECT a.g, a.d, fe.dst FROM avoid a JOIN fe ON fe.g = a.g AND fe.src = a.n WHERE fe.dst <> a.d""",
    "dom": "SELECT a.g, a.node AS d, b.node AS n FROM nodes a JOIN nodes b ON a.g = b.g WHERE NOT EXISTS (SELECT 1 FROM avoid x WHERE x.g = a.g AND x.d = a.node AND x.n = b.node)",
    "depth": "SELECT g, n AS node, count(*) - 1 AS depth FROM dom GROUP BY g, n",
    "idom": "SELECT dom.g, n AS node, max_by(d, depth.depth) FILTER (WHERE d <> n) AS idom FROM dom JOIN depth ON depth.g = dom.g AND depth.node = dom.d GROUP BY dom.g, n",
}
#: What each view reads, in order.
_NEEDS = {
    "ir": (), "fe": ("ir",), "ent": ("ir",), "blkrow": ("ir",), "blk": ("ir", "blkrow"), "du": ("ir",), "wd": (), "defs": ("ir", "du"), "uses": ("ir", "du", "defs"),
    "reach": ("ir", "fe", "ent"), "nodes": ("ir",), "avoid": ("ir", "fe", "ent", "nodes"), "dom": ("ir", "fe", "ent", "nodes", "avoid"),
    "depth": ("ir", "fe", "ent", "nodes", "avoid", "dom"), "idom": ("ir", "fe", "ent", "nodes", "avoid", "dom", "depth"),
}


def sql(query: str, *views: str) -> str:
    """The query behind the views that it reads and those that they read."""
    wanted = {v for view in views for v in (*_NEEDS[view], view)}
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({text})" for name, text in SQL.items() if name in wanted) + " " + query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + F.weekofyear("ts")).alias("g"), "event_id", "ts", F.col("event_type").alias("op"), k.alias("k"), F.col("value").alias("val")
    )
    order = Window.partitionBy("g").orderBy("ts", "event_id")
    return rows.select(
        "g", (F.row_number().over(order) - 1).cast("long").alias("pc"), "event_id", "ts", "op", "k",
        F.concat("op", F.lit(":"), (F.col("k") % 2).cast("string")).alias("node"), (F.col("k") % 8).alias("reg"), "val",
    )


def fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("node").over(Window.partitionBy("g").orderBy("pc"))
    return ir(spark, sf_dir).select("g", F.col("node").alias("src"), following.alias("dst")).where("dst is not null").groupBy("g", "src", "dst").agg(F.count("*").alias("n"))


def ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir(spark, sf_dir).where("pc = 0").select("g", "node")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir(spark, sf_dir).select("g", "node").distinct()


def du(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("op").isin("signup", "purchase"), "W").otherwise("R")
    return ir(spark, sf_dir).where("op <> 'error'").select("g", "pc", "reg", mode.alias("mode"))


def wd(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    word = F.pmod(F.col("o_orderkey") * F.lit(2654435761), F.lit(1 << 32))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), (F.row_number().over(order) - 1).cast("long").alias("pos"), word.alias("word"))
