"""URL filters: a temporal join of captures with dated list entries.

Dated entries (added or removed on a list) become validity intervals per list and pattern. A capture asks, as of
its fetch time, for the entries of every pattern that its address matches: its host, each parent domain, and its
host with the first part of the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weirflow.llm.common import whole_row


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) from entries(list, pattern, effective, action add or remove).

    From an add on, until the next entry of the same list and pattern, a pattern is on the list; valid_to is open
    and null at the end. Of an add and a remove at one time the remove holds. Repeated entries count once; entries
    with a null in any of the four columns, or another action, are ignored.
    """
    known = entries.select("list", "pattern", "effective", "action").dropna().where(F.col("action").isin("add", "remove"))
    once = known.groupBy("list", "pattern", "effective").agg(F.max("action").alias("action"))  # remove sorts behind add
    following = Window.partitionBy("list", "pattern").orderBy("effective")
    return once.select("list", "pattern", "action", F.col("effective").alias("valid_from"), F.lead("effective").over(following).alias("valid_to")).where(
        "action = 'add'"
    ).drop("action")


def host_of(url: Column) -> Column:
    """The lower-case host of an address, without user, port and closing dot; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+?)\.?(?:[:/?#]|$)", 1), F.lit(""))


def first_part(url: Column) -> Column:
    """The first part of an address's path, as it is; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))


def patterns_of(host: Column, part: Column) -> Column:
    """All patterns that match a host and first path part: the host, its parents of two labels or more, host/part."""
    labels = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).when(part == "", names).otherwise(F.array_append(names, F.concat(host, F.lit("/"), part)))


#: Intervals in a stretch of a pattern's time, on average: what a question meets at once.
STRETCH_INTERVALS = 16


def _placed(kind: T.DataType, at: Column) -> Column | None:
    """A time as a number in the same order; None for types that have no such number."""
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("double")
    return at.cast("double") if isinstance(kind, (T.NumericType, T.TimestampType)) else None


def in_force(wanted: DataFrame, valid: DataFrame, stretch_intervals: int = STRETCH_INTERVALS) -> DataFrame:
    """Rows of wanted(pattern, _at, ...) joined with those of valid(list, pattern, valid_from, valid_to) that hold at _at.

    A pattern of many intervals is cut into stretches of time, one for each stretch_intervals of them. A row meets the
    intervals of its own stretch only, so a long history doesn't multiply rows. An interval lies in every stretch
    that it touches; those of one list don't overlap, so they are as many as intervals, and stretches for each list.
    Times that aren't numbers, dates or time stamps alike on both sides are one stretch.
    """
    kind = wanted.schema["_at"].dataType
    holds = (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    start = _placed(kind, F.col("valid_from")) if valid.schema["valid_from"].dataType == kind else None
    if start is None:
        return wanted.join(valid, "pattern").where(holds)
    span = F.max("_start") - F.min("_start")
    spans = valid.withColumn("_start", start).groupBy("pattern").agg(
        F.min("_start").alias("_first"), F.ceil(F.count("*") / stretch_intervals).alias("_many"), F.when(span > 0, span).alias("_span")
    )
    stretch = lambda at: F.coalesce(
        F.greatest(F.lit(0), F.least(F.col("_many") - 1, F.floor((_placed(kind, at) - F.col("_first")) / F.col("_span") * F.col("_many")))), F.lit(0)
    ).cast("int")
    touched = F.sequence(stretch(F.col("valid_from")), F.when(F.col("valid_to").isNull(), F.col("_many").cast("int") - 1).otherwise(stretch(F.col("valid_to"))))
    cut = valid.join(spans, "pattern").withColumn("_stretch", F.explode(touched)).select("list", "pattern", "valid_from", "valid_to", "_stretch")
    asked = wanted.join(spans, "pattern").withColumn("_stretch", stretch(F.col("_at"))).drop("_first", "_many", "_span")
    return asked.join(cut, ["pattern", "_stretch"]).where(holds)


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures, all columns, with filter_host, n_active, active_lists and blocked as of the fetch time.

    n_active counts the list entries in force for the capture, active_lists names their lists in order, comma-joined.
    A capture with a null address or time has none. Repeated captures give repeated rows; of two changes of one list
    and pattern at one time the remove holds (intervals()). Without captures there are no rows, without entries none
    is blocked. Columns of captures named like one of the four results give way to it; other names can't clash.

    What a capture asks depends on (host, path part, time) only, so each distinct question is answered once and the
    answers join back: copies and hot hosts cost no more, and all joins are plain equi-joins, which adaptive
    execution can split. The join with the entries is by pattern and stretch of time (in_force()).
    """
    asked = captures.select(
        whole_row(captures).alias("row"), host_of(F.col(url)).alias("filter_host"), first_part(F.col(url)).alias("_part"), F.col(fetched).alias("_at")
    )
    questions = asked.where("filter_host <> '' and _at is not null").select("filter_host", "_part", "_at").distinct()
    wanted = questions.withColumn("pattern", F.explode(F.array_distinct(patterns_of(F.col("filter_host"), F.col("_part")))))
    hits = in_force(wanted, intervals(entries))
    answers = hits.groupBy("filter_host", "_part", "_at").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("active_lists")
    )
    told = ("filter_host", "n_active", "active_lists", "blocked")
    return asked.join(answers, ["filter_host", "_part", "_at"], "left").select(
        *(F.col("row").getField(c).alias(c) for c in captures.columns if c.lower() not in told), "filter_host",
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), F.coalesce("active_lists", F.lit("")).alias("active_lists"), (F.col("n_active").isNotNull()).alias("blocked"),
    )


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day: the tables have none, so it follows from the page's id."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.pmod(F.col("page_id").cast("long") * 7919, F.lit(366)).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts, parent domains and path parts that the pages have; days and actions follow from hashes.

    A third of the hosts come on the list spam, half of those leave it later, and some of those return. A fifth of
    the parent domains are on the list adult for a while, a quarter of the host/part pairs on the list harvest.
    """
    seen = pages.select(host_of(F.col("url").cast("string")).alias("host"), first_part(F.col("url").cast("string")).alias("part")).where("host <> ''").distinct()
    named = (
        seen.select(F.lit("spam").alias("list"), F.col("host").alias("pattern"))
        .unionByName(seen.where("host rlike '[.].*[.]'").select(F.lit("adult").alias("list"), F.regexp_replace("host", r"^[^.]*\.", "").alias("pattern")))
        .unionByName(seen.where("part <> ''").select(F.lit("harvest").alias("list"), F.concat("host", F.lit("/"), "part").alias("pattern")))
        .distinct()
        .withColumn("k", _number(F.concat("list", F.lit(":"), "pattern")))
    )
    every = F.when(F.col("list") == "spam", 3).when(F.col("list") == "adult", 5).otherwise(4)
    chosen = named.where(F.pmod("k", every) == 0).withColumn("day", F.pmod("k", F.lit(300)))
    steps = F.array(
        F.struct(F.col("day").alias("effective"), F.lit("add").alias("action")),
        F.struct(F.when(F.pmod(F.shiftright("k", 2), F.lit(2)) == 0, F.col("day") + 20 + F.pmod("k", F.lit(50))).alias("effective"), F.lit("remove").alias("action")),
        F.struct(F.when(F.pmod(F.shiftright("k", 2), F.lit(4)) == 0, F.col("day") + 100).alias("effective"), F.lit("add").alias("action")),
    )
    return chosen.select("list", "pattern", F.explode(steps).alias("s")).select("list", "pattern", "s.effective", "s.action").where("effective is not null")


def query(pages: DataFrame) -> DataFrame:
    """page_id, filter_host, fetched, n_active, active_lists, blocked for each row of pages(page_id, url).

    A null address has an empty host and no active entry; a null id has no fetch day, so no active entry either.
    Repeated rows give repeated rows, an empty table none; other columns, whatever their names, are not read.
    """
    return evaluate(page_captures(pages), page_entries(pages)).select("page_id", "filter_host", "fetched", "n_active", "active_lists", "blocked")


ORACLE = r"""
WITH p AS (
  SELECT page_id, (page_id * 7919) % 366 AS fetched,
    coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+?)\.?(?:[:/?#]|$)', 1), '') AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS part
  FROM pages),
s AS (SELECT DISTINCT host, part FROM p WHERE host <> ''),
n AS (
  SELECT 'spam' AS list, host AS pattern FROM s
  UNION SELECT 'adult', regexp_replace(host, '^[^.]*\.', '') FROM s WHERE regexp_matches(host, '[.].*[.]')
  UNION SELECT 'harvest', host || '/' || part FROM s WHERE part <> ''),
k AS (SELECT *, ('0x' || substr(md5(list || ':' || pattern), 1, 6))::BIGINT AS k FROM n),
c AS (SELECT *, k % 300 AS day FROM k WHERE k % (CASE list WHEN 'spam' THEN 3 WHEN 'adult' THEN 5 ELSE 4 END) = 0),
e AS (
  SELECT list, pattern, day AS effective, 'add' AS action FROM c
  UNION ALL SELECT list, pattern, day + 20 + k % 50, 'remove' FROM c WHERE (k // 4) % 2 = 0
  UNION ALL SELECT list, pattern, day + 100, 'add' FROM c WHERE (k // 4) % 4 = 0),
o AS (SELECT list, pattern, effective, max(action) AS action FROM e GROUP BY ALL),
iv AS (SELECT *, lead(effective) OVER (PARTITION BY list, pattern ORDER BY effective) AS valid_to FROM o),
w AS (
  SELECT DISTINCT page_id, host, part, fetched, pattern FROM (
    SELECT page_id, host, part, fetched, host AS pattern FROM p WHERE host <> ''
    UNION ALL SELECT page_id, host, part, fetched, array_to_string(string_split(host, '.')[i:], '.')
      FROM p, range(1, 40) r(i) WHERE host <> '' AND i < len(string_split(host, '.'))
    UNION ALL SELECT page_id, host, part, fetched, host || '/' || part FROM p WHERE host <> '' AND part <> '')),
h AS (
  SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS active_lists
  FROM w JOIN iv USING (pattern)
  WHERE action = 'add' AND effective <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY page_id)
SELECT p.page_id, p.host AS filter_host, p.fetched, coalesce(n_active, 0)::BIGINT AS n_active,
  coalesce(active_lists, '') AS active_lists, n_active IS NOT NULL AS blocked
FROM p LEFT JOIN h USING (page_id)
"""
