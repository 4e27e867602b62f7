import random

import pytest
from pyspark.sql import functions as F

from tests.llm.oracles import duck, same_rows
from weirflow.llm import urls

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    same_rows(urls.query(spark.read.parquet(f"{SF}/pages.parquet")), duck(SF), urls.ORACLE)


def plain(captures, entries):
    out = []
    for key, url, at in captures:
        host, _, path = (url or "").partition("://")[2].partition("/")
        labels = host.lower().split(".")
        patterns = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} if host else set()
        if host and path:
            patterns.add(f"{host.lower()}/{path.split('/')[0]}")
        active = []
        for name, pattern in {(e[0], e[1]) for e in entries if None not in e}:
            dated = sorted((e[2], e[3]) for e in entries if e[:2] == (name, pattern) and None not in e)
            last = [action for day, action in dated if at is not None and day <= at]
            if pattern in patterns and last and last[-1] == "add":
                active.append(name)
        out.append((key, len(active), ",".join(sorted(set(active)))))
    return sorted(out, key=repr)


def test_as_of_join_matches_brute_force(spark):
    draw = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.net", "x.other.net"]
    entries = [(draw.choice("LM"), draw.choice([*hosts, "other.net/p", "a.example.com/q"]), draw.randint(0, 20), draw.choice(["add", "remove"])) for _ in range(60)]
    entries += entries[:5] + [("L", None, 3, "add"), ("L", "other.net", None, "add"), (None, "other.net", 1, "add")]
    captures = [(i, f"http://{draw.choice(hosts)}{draw.choice(['', '/p', '/q/z', '/'])}", draw.randint(-1, 22)) for i in range(300)]
    captures += [(400, None, 5), (401, "no address", 5), (402, "http://other.net", None), (403, "", 1), captures[0]]
    table = spark.createDataFrame([(*c, "x") for c in captures], "key long, url string, fetched long, pattern string")
    out = urls.evaluate(table, spark.createDataFrame(entries, "list string, pattern string, effective long, action string"))
    assert sorted(((r.key, r.n_active, r.active_lists) for r in out.collect()), key=repr) == plain(captures, entries)
    assert out.where("blocked <> (n_active > 0) or pattern <> 'x'").count() == 0 and out.where("blocked").count() > 20


@pytest.mark.parametrize("kind", ["long", "date", "timestamp", "string", "double"])
def test_long_histories_of_any_time(spark, kind):
    draw = random.Random(7)
    entries = [(draw.choice("LMN"), draw.choice(["hot.org"] * 9 + ["a.net", "b.net"]), draw.randint(0, 200) ** 2, draw.choice(["add", "remove"])) for _ in range(500)]
    captures = [(i, f"http://{draw.choice(['hot.org', 'x.hot.org', 'a.net', 'c.net'])}", draw.randint(-1, 210) ** 2) for i in range(300)]
    timed = {"date": "date_add(date'2000-01-01', cast({0} as int))", "timestamp": "timestamp_seconds({0} * 1000)", "string": "lpad(cast({0} as string), 9, '0')", "double": "{0} / 7"}.get(kind, "{0}")
    listed = spark.createDataFrame(entries, "list string, pattern string, effective long, action string").withColumn("effective", F.expr(timed.format("effective")))
    table = spark.createDataFrame(captures, "key long, url string, fetched long").withColumn("fetched", F.expr(timed.format("fetched")))
    found = urls.evaluate(table, listed)
    assert sorted(((r.key, r.n_active, r.active_lists) for r in found.collect()), key=repr) == plain(captures, entries)


def test_a_history_does_not_multiply_its_questions(spark):
    valid = spark.range(4_000).selectExpr("'L' as list", "'hot.org' as pattern", "id * 10 as valid_from", "id * 10 + 5 as valid_to")
    wanted = spark.range(2_000).selectExpr("'hot.org' as pattern", "id * 20 + 1 as _at")
    plan = urls.in_force(wanted, valid)
    assert plan.count() == 2_000 and plan.select("_stretch").distinct().count() == 250
    most = valid.groupBy((F.col("valid_from") * 250 / 39_990).cast("int")).count().agg(F.max("count")).first()[0]
    assert most <= 2 * urls.STRETCH_INTERVALS


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.query(pages).count() == 0


def test_clashing_names_keep_their_values(spark):
    names = ["_part", "_at", "row", "list", "pattern", "valid_from", "filter_host", "n_active", "blocked"]
    captures = spark.createDataFrame([(1, "http://a.org/x", 5, *names)], "key long, url string, fetched long, " + ", ".join(f"{n} string" for n in names))
    out = urls.evaluate(captures, spark.createDataFrame([("L", "a.org", 1, "add")], "list string, pattern string, effective long, action string"))
    assert len(set(out.columns)) == len(out.columns)
    row = out.first()
    assert all(row[n] == n for n in names[:6]) and (row.filter_host, row.n_active, row.active_lists, row.blocked) == ("a.org", 1, "L", True)
    assert urls.evaluate(captures.unionByName(captures), spark.createDataFrame([], "list string, pattern string, effective long, action string")).where("not blocked").count() == 2
