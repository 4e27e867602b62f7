"""Types and names inferred from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weirflow.operators.joins import as_of
from weirflow.plans.fixpoint import grow, settled
from weirflow.plans.scan import HOT_ROWS, latest, running

# ---- fixed values: what an operator's result is ----
RESULT_OF = {"==": "boolean", "<": "boolean", "not": "boolean", "+": "number", "-": "number", "*": "number", "/": "number", "#": "number", "..": "string", "{}": "table", "function": "function"}
# ---- end of fixed values ----


def expression_type(op: Column, literal: Column, integers: str = "number") -> Column:
    """Type by operator, else by the literal's text; integers names what a whole number is; null for neither."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for sign, name in RESULT_OF.items():
        chain = chain.when(op == sign, name)
    return F.coalesce(
        chain, F.when(literal.isin("true", "false"), "boolean").when(literal.rlike(r"^-?[0-9]+\z"), integers).when(literal.rlike(r"^-?[0-9]+\.[0-9]+\z"), "number").when(literal.isNotNull(), "string")
    )


def call_site_facts(calls: DataFrame, owners: DataFrame) -> DataFrame:
    """(callee, position, type, n): argument types seen at calls(callee, position, type) of names that owners(callee) has once."""
    once = owners.groupBy("callee").agg(F.count("*").alias("_n")).where("_n = 1")
    return calls.join(once, "callee", "left_semi").groupBy("callee", "position", "type").agg(F.count("*").alias("n"))


def resolve_types(params: DataFrame, *facts: DataFrame) -> DataFrame:
    """params(g, subject, declared) with type: declared, else of the first facts(g, subject, type) that have one, else unknown."""
    out, found = params, [F.col("declared")]
    for rank, f in enumerate(facts):
        out = out.join(f.groupBy("g", "subject").agg(F.min("type").alias(f"_t{rank}")), ["g", "subject"], "left")
        found.append(F.col(f"_t{rank}"))
    return out.withColumn("type", F.coalesce(*found, F.lit("unknown"))).select("g", "subject", "type")


def call_result_type(calls: DataFrame, *rules: tuple[str, DataFrame]) -> DataFrame:
    """calls with type: of each (on, rules(key, priority, result, argument)) in turn, the best rule for the call's column on.

    The first table with a rule for the call decides: by method, then by the receiver's type, then by the global
    function, say. A rule with an argument takes the class that the call names there, calls' column argN, and result
    only where it is null. Of several rules for one key that of least priority counts. No rule gives null, and so does
    an empty table.
    """
    out, found = calls, [F.lit(None).cast("string")]
    for rank, (on, table) in enumerate(rules):
        best = table.groupBy(F.col("key").alias(f"_k{rank}")).agg(F.min_by(F.struct("result", "argument"), "priority").alias(f"_r{rank}"))
        out = out.join(best, out[on] == F.col(f"_k{rank}"), "left")
        named = F.lit(None).cast("string")
        for name in [c for c in calls.columns if c.startswith("arg") and c[3:].isdigit()]:
            named = F.when(F.col(f"_r{rank}.argument") == int(name[3:]), F.col(name)).otherwise(named)
        found.append(F.coalesce(named, F.col(f"_r{rank}.result")))
    return out.select(*(F.col(c) for c in calls.columns), F.coalesce(*found).alias("type"))


def scope_ancestors(scopes: DataFrame) -> DataFrame:
    """(g, scope, ancestor): each of scopes(g, scope, parent), parent null at the top, with itself and all that enclose it."""
    up = settled(scopes.where("parent is not null").select("g", F.col("scope").alias("ancestor"), "parent"))
    seed = scopes.select("g", "scope", F.col("scope").alias("ancestor"))
    return grow(seed, lambda new, _: new.join(up, ["g", "ancestor"]).select("g", "scope", F.col("parent").alias("ancestor")))


def propagate_types(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """rows(g, pc, scope, name, type) with known: the last type that the name got before, in the same scope or one that encloses it.

    scopes(g, scope, parent) is the tree; a scope's types are not seen outside it. Each row asks its scope and those
    above by one sort each of (scope, name), and the latest answer counts.
    """
    asked = rows.select("g", "pc", "scope", "name").distinct().join(scope_ancestors(scopes), ["g", "scope"]).select("g", "pc", F.col("scope").alias("_own"), "name", F.col("ancestor").alias("scope"))
    marks = rows.where("type is not null").select("g", "pc", "scope", "name", F.struct("pc", "type").alias("mark"))
    seen = as_of(asked, marks, ["g", "scope", "name"], "pc", "mark", None)
    best = seen.groupBy("g", "pc", F.col("_own").alias("scope"), "name").agg(F.max("mark").alias("mark"))
    return rows.join(best, ["g", "pc", "scope", "name"], "left").select("g", "pc", "scope", "name", "type", F.col("mark.type").alias("known"))


def suggest_names(calls: DataFrame, methods: list[str], wanted: Column, requires: list[str] = ()) -> DataFrame:
    """(g, pc, suggestion) of lookup calls, and of calls in requires whose argument is the result of one: the record at arg_pc."""
    looked = calls.where(F.col("method").isin(*methods)).select("g", "pc", wanted.alias("suggestion"))
    if not requires:
        return looked
    needed = calls.where(F.col("method").isin(*requires)).select("g", F.col("pc").alias("_at"), F.col("arg_pc").alias("pc"))
    return looked.unionByName(needed.join(looked, ["g", "pc"]).select("g", F.col("_at").alias("pc"), "suggestion"))


def _ranked(wanted: DataFrame) -> DataFrame:
    """wanted(id, name) with _rank, the place of an id among its name's from 1, and _part, the stretch of the order it lies in.

    Rows are sorted over stretches of names and ids, so the claimants of a frequent name are many tasks' work; a
    stretch counts its own and adds what those before it have of the name.
    """
    dealt = settled(wanted.select("id", "name").repartitionByRange("name", "id").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("name", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.row_number().over(Window.partitionBy("name", "_part").orderBy("id"))
    offsets = parts.select("name", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.withColumn("_in", inside).join(offsets, ["name", "_part"]).select("id", "name", "_part", (F.col("_in") + F.col("_before")).alias("_rank"))


def resolve_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted(id, name), names clean already, with resolved: the first claimant keeps a free name, others get v{n}_{name}.

    n counts the claimants of a name from 1 and skips numbers whose name is in taken(name): the claimant of rank r
    gets the r-th number that is free. A number is at most the claimants and the taken names of that form together.
    A frequent name is dealt over the stretches of _ranked(); each finds the numbers skipped by one sort of its own.
    """
    free = taken.select("name").distinct().withColumn("_taken", F.lit(True))
    later = F.col("_rank") - F.when(F.col("_taken"), 0).otherwise(1)
    rows = settled(_ranked(wanted).join(free, "name", "left").select("id", "name", "_part", later.alias("_later")))
    # Taken numbers of each name, ascending; the i-th of them moves all claimants at or behind its place by one.
    used = taken.select(F.regexp_extract("name", "^v([1-9][0-9]{0,8})_(.*)$", 2).alias("name"), F.regexp_extract("name", "^v([1-9][0-9]{0,8})_(.*)$", 1).try_cast("long").alias("number")).where("number >= 1").distinct()
    nth = used.withColumn("_skip", F.row_number().over(Window.partitionBy("name").orderBy("number")).cast("long"))
    places = nth.groupBy("name", (F.col("number") - F.col("_skip") + 1).alias("_later")).agg(F.max("_skip").alias("_skip"))
    # A stretch knows the places inside it, and at its start what those before it add up to.
    starts = rows.groupBy("name", "_part").agg(F.min("_later").alias("_later"))
    opening = as_of(starts, places, ["name"], "_later", "_skip", 0, include=True)
    inside = as_of(places, starts, ["name"], "_later", "_part", None, include=True).where("_part is not null")
    marks = opening.unionByName(inside).groupBy("name", "_part", "_later").agg(F.max("_skip").alias("_skip"))
    out = as_of(rows, marks, ["name", "_part"], "_later", "_skip", 0, include=True).withColumn("_n", F.col("_later") + F.col("_skip"))
    return out.select("id", "name", F.when(F.col("_later") == 0, F.col("name")).otherwise(F.concat(F.lit("v"), F.col("_n").cast("string"), F.lit("_"), "name")).alias("resolved"))


def apply_renames(refs: DataFrame, renames: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """refs(g, pc, name) with shown: the new name of the last of renames(g, pc, name, renamed) before, else the name.

    A name of more than hot rows in a graph is cut into stretches.
    """
    events = refs.select("g", "pc", "name", F.lit(None).cast("string").alias("renamed"), F.lit(True).alias("_ref")).unionByName(renames.select("g", "pc", "name", "renamed", F.lit(False).alias("_ref")))
    seen = running(events.withColumn("_turn", ~F.col("_ref")), ["g", "name"], ["pc", "_turn"], hot, _last=latest(F.col("renamed")))
    return seen.where("_ref").select("g", "pc", "name", F.coalesce("_last", "name").alias("shown"))


def body_use_facts(uses: DataFrame, rules: DataFrame) -> DataFrame:
    """(g, subject, type, n): types that rules(op, type) say of a subject by the op of its uses(g, subject, op).

    A rule of type "other" takes the type of the other side, uses' column other, or unknown. Uses that a column nested
    marks, those in a function inside, are left out.
    """
    told = uses.where(~F.coalesce("nested", F.lit(False))) if "nested" in uses.columns else uses
    other = F.coalesce("other", F.lit("unknown")) if "other" in uses.columns else F.lit("unknown")
    kind = F.when(F.col("type") == "other", other).otherwise(F.col("type"))
    return told.join(rules.select("op", "type"), "op").groupBy("g", "subject", kind.alias("type")).agg(F.count("*").alias("n"))


def annotate_locals(rows: DataFrame, kind: Column) -> DataFrame:
    """(g, pc, type) of rows whose first value has a type; nil leaves a row bare."""
    return rows.select("g", "pc", kind.alias("type")).where("type is not null and type <> 'nil'")
