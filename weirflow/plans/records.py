"""Queries over decoding, ingest, export, rewrites and inference, with the SQL that gives the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from weirflow.functions import decode
from weirflow.operators import aggregates, infer, rewrite, segment
from weirflow.plans import fixtures as fx
from weirflow.plans import relational
from weirflow.plans.fixpoint import own_folder, settled
from weirflow.sources import container, export, ingest
from weirflow.streaming import ingest as continuous


def p1(s, d):
    return decode.decode_words(fx.wd(s, d))


def p1_permuted(s, d):
    return decode.decode_words(fx.wd(s, d), decoder=decode.permuted).select("g", "pos", "op")


def p2(s, d):
    return decode.split_aux(fx.wd(s, d), F.col("word") % 4 == 0)


def p3(s, d):
    part = fx.table(s, d, "part").select(F.col("p_partkey").alias("_id"), "p_brand")
    ids = fx.wd(s, d).select("g", "pos", F.posexplode(decode.unpack_path(F.col("word"))).alias("i", "id"))
    named = ids.join(part, ids["id"] == part["_id"], "left").groupBy("g", "pos").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("p_brand", F.lit("?")).alias("n")))).alias("l"))
    return named.select("g", "pos", F.array_join(F.transform("l", lambda e: e["n"]), ".").alias("path"))


def p4(s, d):
    return fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", decode.signed_magnitude(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("value"))


def p5(s, d):
    return fx.table(s, d, "documents").select("doc_id", decode.escape_non_ascii(F.col("text")).alias("shown"))


def p6(s, d):
    return fx.table(s, d, "part").select("p_partkey", decode.type_name((F.col("p_size") * 5 % 256).cast("int")).alias("type"))


def p7(s, d):
    types = F.transform("embedding", lambda x: F.when(x > 0, "up").otherwise("down"))
    return fx.table(s, d, "embeddings").select("vec_id", decode.param_type(types, (F.col("vec_id") % (F.size("embedding") + 9)).cast("int")).alias("type"))


#: What each kind of event does, in the manner of an operation catalog.
CATALOG = [
    ("error", True, False, True, False, False, "none"), ("signup", False, False, False, True, False, "write"), ("purchase", False, False, True, False, True, "read_write"),
    ("click", False, True, False, True, False, "read"), ("view", False, False, False, True, True, "deferred"),
]
_FLAGS = ["is_terminator", "is_conditional", "has_side_effect", "is_simple", "is_two_word", "access"]


def p8(s, d):
    catalog = s.createDataFrame(CATALOG, "op string, " + ", ".join(f"{f} {'string' if f == 'access' else 'boolean'}" for f in _FLAGS))
    return decode.classify(fx.ir(s, d).select("event_id", "op"), catalog)


#: The conditional record that each kind of event stands for.
CONDITIONS = {"click": "JUMPIFNOTEQ", "view": "JUMPIFLT", "purchase": "JUMPXEQK", "signup": "JUMPIFNOT", "error": "RETURN"}


def p12(s, d):
    rows = fx.ir(s, d)
    following = F.lead("reg").over(Window.partitionBy("g").orderBy("pc"))
    op = F.element_at(F.create_map(*(F.lit(x) for pair in CONDITIONS.items() for x in pair)), F.col("op"))
    asked = rows.select("event_id", op.alias("op"), F.col("reg").cast("string").alias("left"), following.cast("string").alias("right"), F.col("k").alias("_k"), (F.col("val") < 50).alias("negated"))
    pool = fx.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("_k"), F.col("n_name").alias("constant"))
    found = asked.join(pool, "_k", "left")
    return found.select("event_id", decode.condition_of(F.col("op"), F.col("left"), F.col("right"), F.col("constant"), F.col("negated")).alias("c")).select("event_id", "c.*")


def p9(s, d):
    words = decode.decode_words(fx.wd(s, d))
    target = decode.jump_target(F.col("pos"), F.when(F.col("op") % 2 == 0, F.col("d") % 8).otherwise(F.col("a") % 3), F.when(F.col("op") % 3 == 0, 1).otherwise(0))
    return words.select("g", "pos", target.alias("target"), decode.drop_noop_jumps(F.lit("JUMP"), F.col("pos"), target).alias("shown"))


def p11(s, d):
    signs = F.element_at(F.array(*map(F.lit, ["==", "<", "<=", "not x", "y", "~="])), (F.col("k") % 6 + 1).cast("int"))
    return fx.ir(s, d).select("event_id", decode.invert_condition(signs).alias("inverted"))


def p13(s, d):
    name = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_name")))
    odd = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size").cast("string"), name)).otherwise(name)
    return fx.table(s, d, "part").select("p_partkey", decode.is_identifier(odd).alias("ok"), decode.sanitize_identifier(odd).alias("clean"))


def p14(s, d):
    shown = F.concat(F.element_at(F.array(*map(F.lit, ["uv_", "arg", "anon_", "v", "va", "i_"])), (F.col("c_custkey") % 6 + 1).cast("int")), F.when(F.col("c_custkey") % 4 == 0, "x").otherwise(F.col("c_custkey").cast("string")))
    return fx.table(s, d, "customer").select("c_custkey", decode.is_generated_name(shown).alias("generated"))


def p15(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["register", "argument", "capture", "index", "function", "main"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    return fx.table(s, d, "customer").select("c_custkey", decode.default_name(kind, F.col("c_custkey")).alias("name"))


def p16(s, d):
    text = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, "true").when(F.col("event_id") % 5 == 2, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return fx.table(s, d, "events").select("event_id", decode.constant_value(text).alias("c")).select("event_id", "c.value", "c.type")


def p17(s, d):
    names = s.createDataFrame(list(enumerate(decode.BUILTINS)), "id int, name string")
    lines = fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 3).cast("int").alias("number"))
    return decode.builtin_name(lines, "number", names)


def p18(s, d):
    text = F.element_at(F.array(*map(F.lit, ["true", "not nil", "nil", "x", "not true"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return fx.table(s, d, "labels").select("doc_id", decode.const_bool(text).alias("truth"))


def p19(s, d):
    words = F.split("text", " ")
    return fx.table(s, d, "documents").select("doc_id", decode.sole_position(words, F.lit("the")).cast("long").alias("place"))


def s2(s, d):
    noised = F.regexp_replace(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "([AQg])", "$1-!"), "\r\n", "")
    rows = fx.table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "!!==").otherwise(noised).alias("sent"))
    return ingest.decode_base64(rows, "sent").select("doc_id", F.decode("content", "UTF-8").alias("text"), "status")


def s3(s, d):
    chunks = fx.table(s, d, "part").select("p_partkey", F.unhex(F.concat(F.lpad(F.hex((F.col("p_partkey") % 14).cast("long")), 2, "0"), F.lpad(F.hex((F.col("p_size") % 6).cast("long")), 2, "0"))).alias("content"))
    return ingest.gate_versions(chunks).select("p_partkey", "version", "types_version", "status")


def _containers(s, d):
    """A container for each customer: one function whose words are those of the customer's orders, in order."""
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    little = F.concat(*(byte(F.shiftrightunsigned("word", 8 * i).bitwiseAND(F.lit(255).cast("long"))) for i in range(4)))
    size = F.col("n")
    varint = F.when(size < 128, byte(size)).otherwise(F.concat(byte(size.bitwiseAND(F.lit(127).cast("long")) + 128), byte(F.shiftrightunsigned(size, 7))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", little.alias("h")))), lambda e: e["h"]), "")
    rows = fx.wd(s, d).groupBy(F.col("g").alias("chunk_id")).agg(joined.alias("body"), F.count("*").alias("n"))
    # version 3, no strings, one function of stack 2; behind its words no constants, children, line, name, lines or locals; main is 0
    return rows.select("chunk_id", F.unhex(F.concat(F.lit("03000102000000"), varint, "body", F.lit("00" * 6 + "00"))).alias("content"))


def s4(s, d):
    return container.words(container.decode_chunks(_containers(s, d)))


def s4_units(s, d):
    cut = _containers(s, d).select("chunk_id", F.when(F.col("chunk_id") % 10 == 3, F.substring(F.col("content"), 1, 9)).when(F.col("chunk_id") % 10 == 4, F.unhex(F.lit("63"))).otherwise(F.col("content")).alias("content"))
    return container.units(container.decode_chunks(cut)).select("chunk_id", "status", "version", "main_fid")


def s5(s, d):
    damaged = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = fx.table(s, d, "events").select("event_id", F.get_json_object(damaged, "$.k").alias("k"))
    good, failed = ingest.quarantine(rows, F.col("k").isNotNull())
    return good.select("event_id", F.lit("ok").alias("status"), "k").unionByName(failed.select("event_id", F.lit("failed").alias("status"), "k"))


def s6(s, d):
    """All events as a stream: encoded texts are decoded, judged and parted while they come."""
    folder = own_folder(s, "stream")
    events = fx.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "!!").otherwise(F.base64(F.encode("props", "UTF-8"))).alias("sent"))
    events.write.parquet(f"{folder}/in")
    stream = s.readStream.schema(events.schema).parquet(f"{folder}/in")
    judge = lambda rows: ingest.decode_base64(rows, "sent").select("event_id", "status", F.get_json_object(F.decode("content", "UTF-8"), "$.k").alias("k"))
    continuous.stream_ingest(stream, judge, f"{folder}/good", f"{folder}/failed", f"{folder}/checkpoint").awaitTermination()
    shape = "event_id long, status string, k string"
    return s.read.schema(shape).parquet(f"{folder}/good").unionByName(s.read.schema(shape).parquet(f"{folder}/failed")).select("event_id", "status", "k")


def s1(s, d):
    """Customers' names as text files, one a nation, read back as binary files."""
    folder = own_folder(s, "files")
    names = fx.table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("n"), "c_name")
    names.repartition("n").write.partitionBy("n").text(folder)
    files = ingest.read_chunks(s, folder).where("path not like '%SUCCESS'")
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    rows = files.select(F.regexp_extract("path", "n=([0-9]+)/", 1).cast("long").alias("nation"), "status", "length", lines.cast("long").alias("n_lines"))
    return rows.groupBy("nation", "status").agg(F.sum("length").alias("length"), F.sum("n_lines").alias("n_lines"))


def s6_once(s, d):
    """All events sent twice, in two batches of a stream: each is answered once."""
    folder = own_folder(s, "stream")
    events = fx.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 7 == 0, "damaged").otherwise(F.col("props")).alias("sent"))
    for part in ("1", "2"):
        events.coalesce(1).write.parquet(f"{folder}/in/{part}")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    judge = lambda rows: continuous.judged(continuous.once(rows, ["event_id"], "ts", "60 days"), "sent").select("event_id", "status", "k")
    continuous.stream_ingest(stream, judge, f"{folder}/good", f"{folder}/failed", f"{folder}/checkpoint").awaitTermination()
    shape = "event_id long, status string, k long"
    return s.read.schema(shape).parquet(f"{folder}/good").unionByName(s.read.schema(shape).parquet(f"{folder}/failed")).select("event_id", "status", "k")


def s7_nested(s, d):
    """Regions, their nations and these' customers, each behind what holds it."""
    part = lambda t, own, above, name: fx.table(s, d, t).select(own.cast("long").alias("id"), above.cast("long").alias("parent"), F.col(name).alias("text"))
    units = part("region", F.col("r_regionkey"), F.lit(None), "r_name").unionByName(part("nation", F.col("n_nationkey") + 1000, F.col("n_regionkey"), "n_name"))
    return export.nested_listing(units.unionByName(part("customer", F.col("c_custkey") + 100000, F.col("c_nationkey") + 1000, "c_name")), hot=200)


def s8_labels(s, d):
    """A node's two most frequent ways on; signups prepare loops, purchases test them, views decide."""
    order = Window.partitionBy("g", "src").orderBy(F.desc("n"), "dst")
    edges = fx.fe(s, d).withColumn("ord", (F.row_number().over(order) - 1).cast("long")).where("ord < 2")
    kind = F.when(F.col("node").startswith("signup"), "prepare").when(F.col("node").startswith("purchase"), "loop").when(F.col("node").startswith("view"), "decide")
    return export.edge_labels(edges, fx.nodes(s, d).select("g", "node", kind.alias("kind")))


def s9(s, d):
    stages = [("documents", fx.table(s, d, "documents")), ("errors", fx.ir(s, d).where("op = 'error'")), ("edges", fx.fe(s, d))]
    folder = own_folder(s, "stages")
    told = [export.stage_metrics(df, name, f"{folder}/{name}") for name, df in stages]
    return functools.reduce(DataFrame.unionByName, told).where("seconds > 0").select("stage", "rows")


def s7(s, d):
    rows = segment.with_blocks(fx.ir(s, d), F.expr("op = 'error'"))
    blocks = segment.assign_blocks(fx.ir(s, d), F.expr("op = 'error'"))
    return export.block_listing(blocks, segment.fallthrough(blocks).where("next_b is not null").select("g", F.col("b").alias("src"), F.col("next_b").alias("dst")), rows, F.concat(F.col("pc").cast("string"), F.lit(" "), "op", F.lit(" r"), F.col("reg").cast("string")))


def s7_plain(s, d):
    return export.listing(fx.ir(s, d), F.concat(F.col("pc").cast("string"), F.lit(" "), "op", F.lit(" r"), F.col("reg").cast("string")))


def s8(s, d):
    role = F.when(F.col("dst") <= F.col("src"), "back").when(F.col("n") > 2, "true <&>").otherwise("next")
    calls = fx.fe(s, d).where("src like 'purchase%'").select("g", "src", F.concat(F.lit("unit "), F.col("g").cast("string")).alias("dst"))
    return export.to_dot(fx.fe(s, d), role, dead=fx.nodes(s, d).where("node like 'error%'"), links=calls)


def _pure(s, d) -> DataFrame:
    rows = fx.du(s, d)
    following = F.lead("reg").over(Window.partitionBy("g").orderBy("pc"))
    return rows.select("g", F.col("pc").alias("pos"), F.col("reg").alias("target"), following.alias("reads"), (F.col("mode") == "W").alias("pure"))


def r1(s, d):
    return rewrite.collapse_update_chains(fx.ir(s, d).select("g", F.col("pc").alias("pos"), "op", "reg"), "op", F.col("reg").cast("string"))


def _parent_scope() -> Column:
    """Of the scope numbers that the queries use: those of 8 places lie in those of 32, these in 0."""
    return F.when(F.col("scope") >= 1000000, F.floor((F.col("scope") - 1000000) / 4) + 1000).when(F.col("scope") >= 1000, F.lit(0)).cast("long")


def r2(s, d):
    return rewrite.drop_noops(fx.ir(s, d).select("g", "pc", "op", "k", "reg"), F.expr("op = 'view' and k = reg"))


def r2_branches(s, d):
    # regions and nations are branches; of customers, those with money are what they hold, the others are empty branches
    region = fx.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("branch"), F.lit(True).alias("pure"))
    nation = fx.table(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.lit(True).alias("branch"), (~F.col("n_name").startswith("I")).alias("pure"))
    customer = fx.table(s, d, "customer").select((F.col("c_custkey") + 100000).cast("long").alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent"), (F.col("c_acctbal") <= 9000).alias("branch"), F.lit(True).alias("pure"))
    return rewrite.drop_empty_branches(region.unionByName(nation).unionByName(customer)).select("id")


def r3(s, d):
    # Reads stand before: the record at pos reads the register that the one before it has.
    return rewrite.eliminate_dead(_pure(s, d))


def r3_nested(s, d):
    # Of three rows one lies in the whole graph, one in a list of 8 places, one in the list of 32 around it.
    pos = F.col("pos")
    scope = F.when(pos % 3 == 0, 0).when(pos % 3 == 1, F.floor(pos / 8) + 1000000).otherwise(F.floor(pos / 32) + 1000)
    rows = settled(_pure(s, d).withColumn("scope", scope.cast("long")))
    every = rows.select("g", F.explode(F.array(F.floor(pos / 8) + 1000000, F.floor(pos / 32) + 1000, F.lit(0))).alias("scope")).distinct()
    return rewrite.eliminate_dead(rows, bodies=every.select("g", "scope", _parent_scope().alias("parent")))


def r4(s, d):
    nation = fx.table(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 2 == 0).alias("condition"), (F.col("n_nationkey") % 2 == 0).alias("side"))
    region = fx.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.when(F.col("r_regionkey") % 2 == 0, True).alias("condition"), F.lit(True).alias("side"))
    customer = fx.table(s, d, "customer").select((F.col("c_custkey") + 100000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent"), F.lit(None).cast("boolean").alias("condition"), (F.col("c_custkey") % 2 == 0).alias("side"))
    return rewrite.prune_constant_branches(region.unionByName(nation).unionByName(customer)).select("id")


def r4_loops(s, d):
    # nations are loops where their key leaves 3 of four, regions where it is above 2, branches elsewhere
    nation = fx.table(s, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 2 == 0).alias("condition"), (F.col("n_nationkey") % 2 == 0).alias("side"), (F.col("n_nationkey") % 4 == 3).alias("loop"))
    region = fx.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.when(F.col("r_regionkey") != 1, F.col("r_regionkey") != 4).alias("condition"), F.lit(True).alias("side"), (F.col("r_regionkey") > 2).alias("loop"))
    customer = fx.table(s, d, "customer").select((F.col("c_custkey") + 100000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent"), F.lit(None).cast("boolean").alias("condition"), (F.col("c_custkey") % 2 == 0).alias("side"), F.lit(None).cast("boolean").alias("loop"))
    return rewrite.prune_constant_branches(region.unionByName(nation).unionByName(customer)).select("id")


def r5(s, d):
    uses, defs = relational._uses(s, d), relational._defs(s, d)
    ops = fx.ir(s, d).select("g", "pc", "op")
    return rewrite.inline_candidates(
        defs.join(ops, ["g", "pc"]), aggregates.use_counts(uses), aggregates.consumed_by(uses.join(ops, ["g", "pc"]), F.expr("op = 'view'")), aggregates.self_overwrites(uses, defs), ["signup"], ["purchase"]
    )


def r5_sinks(s, d):
    """What a purchase gives is a call's result: it moves into a click, but for one whose k is a multiple of 4, where it is the callee."""
    uses, defs = relational._uses(s, d), relational._defs(s, d)
    ops = fx.ir(s, d).select("g", "pc", "op", "k")
    used = settled(uses.join(ops, ["g", "pc"]))
    return rewrite.inline_candidates(
        defs.join(ops, ["g", "pc"]), aggregates.use_counts(uses), aggregates.consumed_by(used, F.expr("op = 'view' and k % 2 = 0")), aggregates.self_overwrites(uses, defs), ["signup"],
        calls=["purchase"], sinks=aggregates.approved_sinks(used, F.expr("op = 'click' and k % 4 <> 0")),
    )


def r6(s, d):
    rows = fx.ir(s, d).select("g", "pc", "reg", F.lag("reg").over(Window.partitionBy("g").orderBy("pc")).alias("left"))
    return rewrite.compound_updates(rows, "reg", "left").select("g", "pc", "reg")


def t1(s, d):
    ops = F.element_at(F.array(*map(F.lit, ["+", "..", "==", "x", "x", "x"])), (F.col("event_id") % 6 + 1).cast("int"))
    literal = F.when(F.col("event_id") % 6 == 3, F.get_json_object("props", "$.k")).when(F.col("event_id") % 6 == 4, F.col("event_type"))
    return fx.table(s, d, "events").select("event_id", infer.expression_type(ops, literal, "integer").alias("type"))


def t2(s, d):
    calls = fx.table(s, d, "conversations").select(F.concat("role", (F.col("conv_id") % 40).cast("string")).alias("callee"), (F.col("turn") % 2).alias("position"), F.when(F.length("text") % 2 == 0, "even").otherwise("odd").alias("type"))
    owners = fx.table(s, d, "conversations").select(F.concat("role", (F.col("conv_id") % 40).cast("string")).alias("callee")).where("callee not like 'user1%'").distinct()
    return infer.call_site_facts(calls, owners)


def t3(s, d):
    rules = s.createDataFrame([("click", "number"), ("view", "table"), ("purchase", "other")], "op string, type string")
    rows = fx.ir(s, d)
    beside = F.lead("op").over(Window.partitionBy("g").orderBy("pc"))
    uses = rows.select("g", F.col("reg").alias("subject"), "op", F.when(beside == "signup", "string").when(beside == "error", "boolean").alias("other"), (F.col("val") > 90).alias("nested"))
    return infer.body_use_facts(uses, rules)


def t5(s, d):
    kind = F.when(F.col("op") == "error", "nil").otherwise(infer.expression_type(F.lit("x"), F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise(F.col("op"))))
    return infer.annotate_locals(fx.ir(s, d), kind)


def t4(s, d):
    rows = fx.ir(s, d)
    params = rows.select("g", F.col("reg").alias("subject")).distinct().withColumn("declared", F.when(F.col("subject") == 0, "self"))
    calls = rows.where("op = 'purchase'").select("g", F.col("reg").alias("subject"), F.lit("bought").alias("type"))
    body = rows.where("op in ('click', 'view')").select("g", F.col("reg").alias("subject"), F.col("op").alias("type"))
    return infer.resolve_types(params, calls, body)


_RULES = "key string, priority int, on string, result string, argument int"
METHOD_RULES = [("click", 2, "method", "Instance", 0), ("click", 3, "method", "dead", None), ("signup", 1, "method", "Player", None)]
RECEIVER_RULES = [("view:0", 1, "receiver", "Signal", None), ("click:1", 1, "receiver", "never", None), ("purchase:1", 5, "receiver", "Receipt", 1)]
FUNCTION_RULES = [("f2", 1, "function", "CFrame", None), ("f5", 1, "function", "Enum", 1)]


def t6(s, d):
    rows = fx.ir(s, d)
    calls = rows.select("event_id", F.col("op").alias("method"), F.col("node").alias("receiver"), F.concat(F.lit("f"), F.col("reg").cast("string")).alias("function"), F.when(F.col("val") > 30, F.concat(F.lit("C"), F.col("k").cast("string"))).alias("arg0"), F.col("op").alias("arg1"))
    return infer.call_result_type(calls, *((on, s.createDataFrame(r, _RULES)) for on, r in (("method", METHOD_RULES), ("receiver", RECEIVER_RULES), ("function", FUNCTION_RULES)))).select("event_id", "type")


def t7(s, d):
    # views happen in scopes of 8 records, others in those of 32 around them, purchases in the whole
    scope = F.when(F.col("op") == "purchase", 0).when(F.col("op") == "view", F.floor(F.col("pc") / 8) + 1000000).otherwise(F.floor(F.col("pc") / 32) + 1000)
    rows = settled(fx.ir(s, d).select("g", "pc", scope.cast("long").alias("scope"), F.col("reg").alias("name"), F.when(F.col("op").isin("signup", "purchase"), F.col("op")).when(F.col("val") > 80, F.lit("seen")).alias("type")))
    every = rows.select("g", F.explode(F.array(F.floor(F.col("pc") / 8) + 1000000, F.floor(F.col("pc") / 32) + 1000, F.lit(0))).alias("scope")).distinct()
    return infer.propagate_types(rows, every.select("g", "scope", _parent_scope().alias("parent")))


def t8(s, d):
    before = F.lag("pc").over(Window.partitionBy("g").orderBy("pc"))
    rows = fx.ir(s, d).select("g", "pc", F.col("op").alias("method"), "node", before.alias("arg_pc"))
    return infer.suggest_names(rows, ["click", "view"], decode.sanitize_identifier(F.col("node")), ["purchase"])


def t9(s, d):
    wanted = fx.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("name"))
    taken = s.createDataFrame([("building",), ("v2_building",), ("v4_machinery",), ("v5_machinery",)], "name string")
    return infer.resolve_names(wanted, taken)


def t10(s, d):
    rows = fx.ir(s, d)
    return infer.apply_renames(rows.where("op in ('click', 'view')").select("g", "pc", F.col("reg").alias("name").cast("string")), rows.where("op = 'signup'").select("g", "pc", F.col("reg").cast("string").alias("name"), F.concat(F.lit("n"), F.col("pc").cast("string")).alias("renamed")))


def u2_lists(s, d):
    """A nation's list has its customers, a customer's its orders, an order's its items: items not returned go, and then what opens an empty list, inner first."""
    nation, customer = fx.table(s, d, "nation"), fx.table(s, d, "customer")
    owner = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("g"))
    order = fx.table(s, d, "orders").join(owner, "o_custkey").select("g", "o_orderkey", "o_custkey")
    item = fx.table(s, d, "lineitem").join(order.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    rows = (
        customer.select(F.col("c_nationkey").alias("g"), F.lit("n").alias("scope"), F.col("c_custkey").alias("pos"), name("c", "c_custkey").alias("opens"), F.lit(False).alias("noop"))
        .unionByName(order.select("g", name("c", "o_custkey").alias("scope"), F.col("o_orderkey").alias("pos"), name("o", "o_orderkey").alias("opens"), F.lit(False).alias("noop")))
        .unionByName(item.select("g", name("o", "l_orderkey").alias("scope"), F.col("l_linenumber").cast("long").alias("pos"), none.alias("opens"), (F.col("l_returnflag") != "R").alias("noop")))
    )
    lists = (
        nation.select(F.col("n_nationkey").alias("g"), F.lit("n").alias("scope"), none.alias("parent"))
        .unionByName(customer.select(F.col("c_nationkey").alias("g"), name("c", "c_custkey").alias("scope"), F.lit("n").alias("parent")))
        .unionByName(order.select("g", name("o", "o_orderkey").alias("scope"), name("c", "o_custkey").alias("parent")))
    )
    steps = [lambda level, _: rewrite.drop_noops(level, F.col("noop")), lambda level, inner: rewrite.drop_empty_lists(level, inner, "opens")]
    return rewrite.rewrite_lists(settled(rows), lists, steps).select("g", "scope", "pos")


def u2(s, d):
    steps = [
        lambda df: rewrite.drop_noops(df, F.expr("op = 'error'")),
        lambda df: rewrite.collapse_update_chains(df, "op", F.col("reg").cast("string")),
    ]
    return rewrite.apply_rewrites(fx.ir(s, d).select("g", F.col("pc").alias("pos"), "op", "reg"), steps)


_ISLANDS = """, r AS (SELECT g, pc AS pos, op, reg FROM ir {where}),
  i AS (SELECT *, sum(CASE WHEN op = p THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY pos) AS run FROM (SELECT *, lag(op) OVER (PARTITION BY g ORDER BY pos) AS p FROM r))
  SELECT g, min(pos) AS pos, any_value(op) AS op, count(*) AS n, string_agg(CAST(reg AS VARCHAR), ',' ORDER BY pos) AS terms FROM i GROUP BY g, run"""
_PICK = lambda items, key: "list_extract([" + ", ".join(f"'{x}'" for x in items) + f"], CAST({key} AS INTEGER))"
_FIELDS = """, f AS (SELECT g, pos, word, word & 255 AS op, (word >> 8) & 255 AS a, (word >> 16) & 255 AS b, (word >> 24) & 255 AS c,
  CASE WHEN word >> 16 >= 32768 THEN (word >> 16) - 65536 ELSE word >> 16 END AS d, CASE WHEN word >> 8 >= 8388608 THEN (word >> 8) - 16777216 ELSE word >> 8 END AS e FROM wd)"""
_TARGET = "pos + CASE WHEN op % 2 = 0 THEN d % 8 ELSE a % 3 END + CASE WHEN op % 3 = 0 THEN 1 ELSE 0 END"
QUERIES = {
    "p1_decode_words": (p1, _FIELDS + " SELECT * FROM f", ("wd",)),
    "p1_permuted_words": (p1_permuted, "SELECT g, pos, ((word & 255) * 203) % 256 AS op FROM wd", ("wd",)),
    "p2_split_aux": (p2, """, x AS (SELECT g, pos, word, false AS is_data FROM wd WHERE pos = 0
        UNION ALL SELECT w.g, w.pos, w.word, x.word % 4 = 0 AND NOT x.is_data FROM x JOIN wd w ON w.g = x.g AND w.pos = x.pos + 1)
      SELECT x.g, x.pos, x.word, x.is_data, CASE WHEN x.word % 4 = 0 AND NOT x.is_data THEN w.word END AS aux FROM x LEFT JOIN wd w ON w.g = x.g AND w.pos = x.pos + 1""", ("wd",)),
    "p3_unpack_path": (p3, """, i AS (SELECT g, pos, n, (word >> (20 - 10 * n)) & 1023 AS id FROM wd, range(0, 3) r(n) WHERE n < word >> 30)
      SELECT g, pos, string_agg(coalesce(p_brand, '?'), '.' ORDER BY n) AS path FROM i LEFT JOIN part ON p_partkey = id GROUP BY g, pos""", ("wd",)),
    "p4_signed_magnitude": (p4, "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_partkey ELSE l_partkey END AS value FROM lineitem", None),
    "p5_escape_non_ascii": (p5, r"""SELECT doc_id, CASE WHEN length(text) = strlen(text) THEN text ELSE list_aggregate(list_transform(string_split(text, ''), lambda c: CASE WHEN strlen(c) = 1 THEN c ELSE
      list_aggregate(list_transform(range(1, strlen(c) + 1), lambda i: '\' || CAST(('0x' || substr(hex(encode(c)), CAST(2 * i - 1 AS BIGINT), 2))::INTEGER AS VARCHAR)), 'string_agg', '') END), 'string_agg', '') END AS shown FROM documents""", None),
    "p6_type_name": (p6, "WITH x AS (SELECT p_partkey, p_size * 5 % 256 AS v FROM part) SELECT p_partkey, CASE WHEN v % 128 >= 64 AND v % 128 < 96 OR v % 128 = 15 THEN 'any' WHEN v % 128 < 10 THEN "
      + _PICK(decode.TYPE_NAMES, "v % 128 + 1") + " ELSE 'unknown' END || CASE WHEN v >= 128 THEN '?' ELSE '' END AS type FROM x", None),
    "p7_param_type": (p7, "SELECT vec_id, CASE WHEN i >= len(embedding) THEN 'any' WHEN embedding[i + 1] > 0 THEN 'up' ELSE 'down' END AS type FROM (SELECT *, vec_id % (len(embedding) + 9) AS i FROM embeddings)", None),
    "p8_classify_ops": (p8, ", c(op, " + ", ".join(_FLAGS) + ") AS (VALUES " + ", ".join(str(row) for row in CATALOG) + ") SELECT event_id, c.* FROM ir JOIN c ON c.op = ir.op", ("ir",)),
    "p9_jump_target": (p9, _FIELDS + f" SELECT g, pos, {_TARGET} AS target, CASE WHEN {_TARGET} = pos + 1 THEN 'NOP' ELSE 'JUMP' END AS shown FROM f", ("wd",)),
    "p11_invert_condition": (p11, "SELECT event_id, " + _PICK(["~=", ">=", ">", "x", "not y", "=="], "k % 6 + 1") + " AS inverted FROM ir", ("ir",)),
    "p12_conditions": (p12, """, r AS (SELECT event_id, op, CAST(reg AS VARCHAR) AS l, CAST(lead(reg) OVER (PARTITION BY g ORDER BY pc) AS VARCHAR) AS r, k, val FROM ir)
      SELECT event_id, CASE op WHEN 'click' THEN '~=' WHEN 'view' THEN '<' WHEN 'purchase' THEN CASE WHEN val < 50 THEN '~=' ELSE '==' END WHEN 'signup' THEN 'not' ELSE 'false' END AS comparison,
        CASE WHEN op <> 'error' THEN l END AS "left", CASE WHEN op IN ('click', 'view') THEN r WHEN op = 'purchase' THEN coalesce(n_name, 'nil') END AS "right" FROM r LEFT JOIN nation ON n_nationkey = k""", ("ir",)),
    "p13_identifiers": (p13, r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_name END AS t FROM part)
      SELECT p_partkey, regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') AS ok, regexp_replace(regexp_replace(t, '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', '_\1') AS clean FROM n""", None),
    "p14_generated_names": (p14, "WITH n AS (SELECT c_custkey, " + _PICK(["uv_", "arg", "anon_", "v", "va", "i_"], "c_custkey % 6 + 1")
      + " || CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS t FROM customer) SELECT c_custkey, regexp_full_match(t, '(uv_|arg|anon_|i_)[0-9].*|[va][0-9]+') AS generated FROM n", None),
    "p15_default_name": (p15, "SELECT c_custkey, CASE c_custkey % 6 WHEN 5 THEN '_start' ELSE " + _PICK(["v", "arg", "uv_", "i_", "f", ""], "c_custkey % 6 + 1") + " || c_custkey END AS name FROM customer", None),
    "p16_constant_value": (p16, """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nil' WHEN 1 THEN 'true' WHEN 2 THEN event_type ELSE json_extract_string(props, '$.k') END AS value,
      CASE event_id % 5 WHEN 0 THEN 'nil' WHEN 1 THEN 'boolean' WHEN 2 THEN 'string' ELSE 'number' END AS type FROM events""", None),
    "p17_builtin_name": (p17, "WITH b AS (SELECT unnest(" + str(decode.BUILTINS) + ") AS name, unnest(range(" + str(len(decode.BUILTINS)) + """)) AS id)
      SELECT l_orderkey, l_linenumber, q AS number, coalesce(name, 'Unknown_BFID_' || q) AS builtin FROM (SELECT *, CAST(l_quantity * 3 AS INTEGER) AS q FROM lineitem) LEFT JOIN b ON id = q""", None),
    "p18_const_bool": (p18, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 3 THEN NULL ELSE false END AS truth FROM labels", None),
    "p19_sole_position": (p19, "SELECT doc_id, CASE WHEN len(list_filter(string_split(text, ' '), lambda w: w = 'the')) = 1 THEN list_position(string_split(text, ' '), 'the') END AS place FROM documents", None),
    "s2_decode_base64": (s2, "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 50 = 0 OR text = '' THEN 'empty' ELSE 'ok' END AS status FROM documents", None),
    "s3_gate_versions": (s3, """SELECT p_partkey, v AS version, CASE WHEN v >= 4 THEN t END AS types_version, CASE WHEN v = 0 THEN 'compile_error' WHEN v NOT BETWEEN 3 AND 11 THEN 'unsupported'
      WHEN v >= 4 AND t NOT BETWEEN 1 AND 3 THEN 'unsupported_types' ELSE 'ok' END AS status FROM (SELECT p_partkey, p_partkey % 14 AS v, p_size % 6 AS t FROM part)""", None),
    "s4_container_words": (s4, "SELECT g AS chunk_id, 0 AS fid, pos, word FROM wd", ("wd",)),
    "s4_container_units": (s4_units, """SELECT DISTINCT g AS chunk_id, CASE g % 10 WHEN 3 THEN 'damaged' WHEN 4 THEN 'unsupported' ELSE 'ok' END AS status, CASE g % 10 WHEN 3 THEN NULL WHEN 4 THEN 99 ELSE 3 END AS version,
      CASE WHEN g % 10 NOT IN (3, 4) THEN 0 END AS main_fid FROM wd""", ("wd",)),
    "s5_quarantine": (s5, "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events", None),
    "s6_stream_ingest": (s6, "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events", None),
    "s9_stage_metrics": (s9, "SELECT 'documents' AS stage, count(*) AS rows FROM documents UNION ALL SELECT 'errors', count(*) FROM ir WHERE op = 'error' UNION ALL SELECT 'edges', count(*) FROM fe", ("ir", "fe")),
    "s1_read_chunks": (s1, "SELECT CAST(c_nationkey AS BIGINT) AS nation, 'ok' AS status, sum(length(c_name) + 1) AS length, count(*) AS n_lines FROM customer GROUP BY c_nationkey", None),
    "s6_answered_once": (s6_once, "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'damaged' ELSE 'ok' END AS status, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events", None),
    "s7_nested_units": (s7_nested, """WITH u AS (SELECT CAST(r_regionkey AS BIGINT) AS root, CAST(r_regionkey AS BIGINT) AS id, CAST(-1 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS depth, r_name AS text FROM region
      UNION ALL SELECT n_regionkey, n_nationkey + 1000, n_nationkey, -1, 1, n_name FROM nation
      UNION ALL SELECT n_regionkey, c_custkey + 100000, n_nationkey, c_custkey, 2, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey)
      SELECT root, row_number() OVER (PARTITION BY root ORDER BY a, b) - 1 AS ord, id, depth, text FROM u""", None),
    "s8_edge_labels": (s8_labels, """, e AS (SELECT *, row_number() OVER (PARTITION BY g, src ORDER BY n DESC, dst) - 1 AS ord FROM fe)
      SELECT g, src, dst, ord, CASE WHEN src LIKE 'signup%' THEN CASE ord WHEN 0 THEN 'skip' ELSE 'enter' END WHEN src LIKE 'purchase%' THEN CASE ord WHEN 0 THEN 'loop' ELSE 'exit' END
        WHEN src LIKE 'view%' THEN CASE ord WHEN 0 THEN 'true' ELSE 'false' END WHEN dst <= src THEN 'back' ELSE '' END AS label FROM e WHERE ord < 2""", ("fe",)),
    "s7_listing": (s7, """, h AS (SELECT g, b, head_pc AS pc, -1 AS o, 'block ' || b || ' <- ' || CASE WHEN b > 0 THEN CAST(b - 1 AS VARCHAR) ELSE '' END || ' -> ' || CASE WHEN (g, b + 1) IN (SELECT g, b FROM blk) THEN CAST(b + 1 AS VARCHAR) ELSE '' END AS line FROM blk),
      a AS (SELECT * FROM h UNION ALL SELECT r.g, r.b, r.pc, 0, r.pc || ' ' || r.op || ' r' || ir.reg FROM blkrow r JOIN ir ON ir.g = r.g AND ir.pc = r.pc)
      SELECT g, string_agg(line, chr(10) ORDER BY b, o, pc) AS text FROM a GROUP BY g""", ("ir", "blk")),
    "s7_plain_listing": (s7_plain, "SELECT g, string_agg(pc || ' ' || op || ' r' || reg, chr(10) ORDER BY pc) AS text FROM ir GROUP BY g", ("ir",)),
    "s8_to_dot": (s8, """, e AS (SELECT g, src, dst, '"' || src || '" -> "' || dst || '" [label="' || CASE WHEN dst <= src THEN 'back' WHEN n > 2 THEN 'true &lt;&amp;&gt;' ELSE 'next' END || '"];' AS a FROM fe WHERE src NOT LIKE 'error%'
        UNION ALL SELECT DISTINCT g, src, 'unit ' || g, '"' || src || '" -> "unit ' || g || '" [style=dotted];' FROM fe WHERE src LIKE 'purchase%')
      SELECT g, 'digraph g {' || chr(10) || string_agg(a, chr(10) ORDER BY src, dst) || chr(10) || '}' AS dot FROM e GROUP BY g""", ("fe",)),
    "r1_update_chains": (r1, _ISLANDS.format(where=""), ("ir",)),
    "r2_drop_noops": (r2, "SELECT g, pc, op, k, reg FROM ir WHERE NOT (op = 'view' AND k = reg)", ("ir",)),
    "r2_drop_empty_branches": (r2_branches, """WITH c AS (SELECT c_custkey + 100000 AS id, c_nationkey AS n FROM customer WHERE c_acctbal > 9000), n AS (SELECT * FROM nation WHERE n_name LIKE 'I%' OR n_nationkey IN (SELECT n FROM c))
      SELECT id FROM c UNION ALL SELECT n_nationkey + 1000 FROM n UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)""", None),
    "r3_eliminate_dead": (r3, """, p AS (SELECT g, pc AS pos, reg AS target, lead(reg) OVER (PARTITION BY g ORDER BY pc) AS reads, mode = 'W' AS pure FROM du),
      live AS (SELECT * FROM p WHERE NOT pure UNION SELECT p.* FROM p JOIN live l ON l.g = p.g AND l.pos > p.pos AND l.reads = p.target) SELECT * FROM live""", ("du",)),
    "r4_prune_branches": (r4, """WITH t AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, CASE WHEN r_regionkey % 2 = 0 THEN true END AS condition, true AS side FROM region
      UNION ALL SELECT n_nationkey + 1000, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 END, n_nationkey % 2 = 0 FROM nation UNION ALL SELECT c_custkey + 100000, c_nationkey + 1000, NULL, c_custkey % 2 = 0 FROM customer),
      k AS (SELECT c.id, c.parent FROM t c LEFT JOIN t p ON p.id = c.parent WHERE p.condition IS NULL OR p.condition = c.side)
      SELECT a.id FROM k a WHERE a.parent IS NULL OR a.parent IN (SELECT b.id FROM k b WHERE b.parent IS NULL OR b.parent IN (SELECT c.id FROM k c WHERE c.parent IS NULL))""", None),
    "r3_nested_bodies": (r3_nested, """, p AS (SELECT g, pc AS pos, reg AS target, lead(reg) OVER (PARTITION BY g ORDER BY pc) AS reads, mode = 'W' AS pure,
        CASE pc % 3 WHEN 0 THEN 0 WHEN 1 THEN pc // 8 + 1000000 ELSE pc // 32 + 1000 END AS scope FROM du),
      live AS (SELECT * FROM p WHERE NOT pure UNION SELECT p.* FROM p JOIN live l ON l.g = p.g AND l.pos > p.pos AND l.reads = p.target
        AND (p.scope = 0 OR p.scope = l.scope OR l.scope >= 1000000 AND p.scope = (l.scope - 1000000) // 4 + 1000)) SELECT * FROM live""", ("du",)),
    "r4_prune_loops": (r4_loops, """WITH t AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, CASE WHEN r_regionkey <> 1 THEN r_regionkey <> 4 END AS condition, true AS side, r_regionkey > 2 AS loop FROM region
      UNION ALL SELECT n_nationkey + 1000, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 END, n_nationkey % 2 = 0, n_nationkey % 4 = 3 FROM nation UNION ALL SELECT c_custkey + 100000, c_nationkey + 1000, NULL, c_custkey % 2 = 0, false FROM customer),
      k AS (SELECT c.id, c.parent FROM t c LEFT JOIN t p ON p.id = c.parent WHERE (p.condition IS NULL OR p.loop OR p.condition = c.side) AND (NOT c.loop OR c.condition IS NULL OR c.condition))
      SELECT a.id FROM k a WHERE a.parent IS NULL OR a.parent IN (SELECT b.id FROM k b WHERE b.parent IS NULL OR b.parent IN (SELECT c.id FROM k c WHERE c.parent IS NULL))""", None),
    "r5_inline_candidates": (r5, """, n AS (SELECT u.g, u.reg, u.version, count(*) AS n, bool_or(ir.op = 'view') AS v, bool_or((u.g, u.reg, u.pc + 1) IN (SELECT g, reg, pc FROM defs)) AS o FROM uses u JOIN ir ON ir.g = u.g AND ir.pc = u.pc GROUP BY ALL),
      r AS (SELECT d.g, d.pc, d.reg, d.version, CASE WHEN n IS NULL THEN 'unused' WHEN ir.op = 'purchase' THEN 'effect' WHEN v THEN 'consumed' WHEN o THEN 'overwritten' WHEN n = 1 THEN 'single' WHEN ir.op = 'signup' THEN 'constant' ELSE 'several' END AS reason
        FROM defs d JOIN ir ON ir.g = d.g AND ir.pc = d.pc LEFT JOIN n ON n.g = d.g AND n.reg = d.reg AND n.version = d.version)
      SELECT g, pc, reg, version, reason IN ('single', 'constant') AS inline, reason FROM r""", ("uses",)),
    "r5_inline_sinks": (r5_sinks, """, n AS (SELECT u.g, u.reg, u.version, count(*) AS n, bool_or(ir.op = 'view' AND k % 2 = 0) AS v, bool_and(ir.op = 'click' AND k % 4 <> 0) AS s, bool_or((u.g, u.reg, u.pc + 1) IN (SELECT g, reg, pc FROM defs)) AS o
        FROM uses u JOIN ir ON ir.g = u.g AND ir.pc = u.pc GROUP BY ALL),
      r AS (SELECT d.g, d.pc, d.reg, d.version, CASE WHEN n IS NULL THEN 'unused' WHEN v THEN 'consumed' WHEN o THEN 'overwritten' WHEN ir.op = 'purchase' AND n = 1 AND s THEN 'sink' WHEN ir.op = 'purchase' THEN 'call'
        WHEN n = 1 THEN 'single' WHEN ir.op = 'signup' THEN 'constant' ELSE 'several' END AS reason
        FROM defs d JOIN ir ON ir.g = d.g AND ir.pc = d.pc LEFT JOIN n ON n.g = d.g AND n.reg = d.reg AND n.version = d.version)
      SELECT g, pc, reg, version, reason IN ('single', 'constant', 'sink') AS inline, reason FROM r""", ("uses",)),
    "r6_compound_updates": (r6, "SELECT g, pc, reg FROM (SELECT g, pc, reg, lag(reg) OVER (PARTITION BY g ORDER BY pc) AS l FROM ir) WHERE reg = l", ("ir",)),
    "t1_expression_type": (t1, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' WHEN 3 THEN 'integer' WHEN 4 THEN 'string' END AS type FROM events", None),
    "t2_call_site_facts": (t2, """WITH c AS (SELECT role || (conv_id % 40) AS callee, turn, turn % 2 AS position, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS type FROM conversations)
      SELECT callee, position, type, count(*) AS n FROM c WHERE callee IN (SELECT callee FROM c WHERE callee NOT LIKE 'user1%') GROUP BY ALL""", None),
    "t3_body_use_facts": (t3, """, u AS (SELECT g, reg AS subject, op, val, lead(op) OVER (PARTITION BY g ORDER BY pc) AS b FROM ir)
      SELECT g, subject, CASE op WHEN 'view' THEN 'table' WHEN 'click' THEN 'number' ELSE CASE b WHEN 'signup' THEN 'string' WHEN 'error' THEN 'boolean' ELSE 'unknown' END END AS type, count(*) AS n
      FROM u WHERE op IN ('click', 'view', 'purchase') AND NOT coalesce(val > 90, false) GROUP BY ALL""", ("ir",)),
    "t5_annotate_locals": (t5, "SELECT g, pc, CASE WHEN k % 2 = 0 THEN 'number' ELSE 'string' END AS type FROM ir WHERE op <> 'error'", ("ir",)),
    "t4_resolve_types": (t4, """SELECT p.g, p.reg AS subject, CASE WHEN p.reg = 0 THEN 'self' ELSE coalesce((SELECT 'bought' FROM ir c WHERE c.g = p.g AND c.reg = p.reg AND c.op = 'purchase' LIMIT 1),
      (SELECT min(op) FROM ir b WHERE b.g = p.g AND b.reg = p.reg AND b.op IN ('click', 'view')), 'unknown') END AS type FROM (SELECT DISTINCT g, reg FROM ir) p""", ("ir",)),
    "t6_call_result_type": (t6, """SELECT event_id, coalesce(CASE op WHEN 'click' THEN coalesce(CASE WHEN val > 30 THEN 'C' || k END, 'Instance') WHEN 'signup' THEN 'Player' END,
      CASE node WHEN 'view:0' THEN 'Signal' WHEN 'click:1' THEN 'never' WHEN 'purchase:1' THEN op END, CASE reg WHEN 2 THEN 'CFrame' WHEN 5 THEN op END) AS type FROM ir""", ("ir",)),
    "t7_propagate_types": (t7, """, t AS MATERIALIZED (SELECT g, pc, CASE op WHEN 'purchase' THEN 0 WHEN 'view' THEN pc // 8 + 1000000 ELSE pc // 32 + 1000 END AS scope, reg AS name,
        CASE WHEN op IN ('signup', 'purchase') THEN op WHEN val > 80 THEN 'seen' END AS type FROM ir)
      SELECT g, pc, scope, name, type, (SELECT max_by(b.type, b.pc) FROM t b WHERE b.g = a.g AND b.name = a.name AND b.pc < a.pc AND b.type IS NOT NULL
        AND (b.scope = a.scope OR b.scope = 0 OR a.scope >= 1000000 AND b.scope = (a.scope - 1000000) // 4 + 1000)) AS known FROM t a""", ("ir",)),
    "t8_suggest_names": (t8, """, p AS (SELECT g, pc, op, node, lag(op) OVER w AS o, lag(node) OVER w AS m FROM ir WINDOW w AS (PARTITION BY g ORDER BY pc))
      SELECT g, pc, replace(CASE WHEN op = 'purchase' THEN m ELSE node END, ':', '_') AS suggestion FROM p WHERE op IN ('click', 'view') OR op = 'purchase' AND o IN ('click', 'view')""", ("ir",)),
    "t9_resolve_names": (t9, """WITH t(name) AS (VALUES ('building'), ('v2_building'), ('v4_machinery'), ('v5_machinery')),
      w AS (SELECT c_custkey AS id, lower(c_mktsegment) AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer),
      l AS (SELECT id, name, r - CASE WHEN name IN (SELECT name FROM t) THEN 0 ELSE 1 END AS later FROM w),
      f AS (SELECT n.name, i, row_number() OVER (PARTITION BY n.name ORDER BY i) AS place FROM (SELECT DISTINCT name FROM w) n, range(1, 100000) q(i) WHERE 'v' || i || '_' || n.name NOT IN (SELECT name FROM t))
      SELECT id, l.name, CASE WHEN later = 0 THEN l.name ELSE 'v' || i || '_' || l.name END AS resolved FROM l LEFT JOIN f ON f.name = l.name AND place = later""", None),
    "t10_apply_renames": (t10, """SELECT a.g, a.pc, CAST(a.reg AS VARCHAR) AS name, coalesce((SELECT 'n' || max(b.pc) FROM ir b WHERE b.g = a.g AND b.reg = a.reg AND b.op = 'signup' AND b.pc < a.pc), CAST(a.reg AS VARCHAR)) AS shown
      FROM ir a WHERE op IN ('click', 'view')""", ("ir",)),
    "u2_inner_first": (u2_lists, """WITH i AS (SELECT c_nationkey AS g, o_custkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R')
      SELECT g, 'o' || l_orderkey AS scope, pos FROM i UNION ALL SELECT DISTINCT g, 'c' || o_custkey, l_orderkey FROM i UNION ALL SELECT DISTINCT g, 'n', o_custkey FROM i""", None),
    "u2_rewrite_hook": (u2, _ISLANDS.format(where="WHERE op <> 'error'"), ("ir",)),
}
