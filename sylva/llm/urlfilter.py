"""URL filters by a temporal list join.

A list is a history of dated entries: from a day on, a host pattern is put on a list or taken off it. Entries become
validity intervals, from the day of an ``add`` up to the next entry of the same pattern and list. A capture is judged by
the entries active on the day it was fetched, as of then: its host and all its parent domains are looked up, and the
longest active pattern decides; at equal length an ``allow`` wins over a ``block``.

What decides is the host and the day, so captures are reduced to these, and these to the names looked up and days, before
the join: a host with a third of all captures, or a parent domain of many hosts, has as many rows as days. Only DataFrame
operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A day after all others, as the end of an interval that is still open.
OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]+)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def suffixes(host: Column) -> Column:
    """The host and its parent domains down to two labels (a host of one label alone), longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, list, valid_from, valid_to (exclusive) from ``entries(pattern, list, day, action)``.

    Entries with a null in any column, or an action other than add and remove, are left out. Of entries for one pattern,
    list and day an ``add`` wins. An ``add`` while listed renews nothing: it ends one interval and starts the next.
    """
    known = (
        entries.select(
            F.lower(F.col("pattern")).alias("pattern"), F.col("list"), F.col("day").cast("date").alias("day"),
            (F.col("action") == "add").alias("added"), "action",
        )
        .where(F.col("action").isin("add", "remove")).dropna()
        .groupBy("pattern", "list", "day").agg(F.max("added").alias("added"))
    )
    history = Window.partitionBy("pattern", "list").orderBy("day")
    return known.withColumn("next", F.lead("day").over(history)).where("added").select(
        "pattern", "list", F.col("day").alias("valid_from"), F.coalesce("next", F.lit(OPEN_END).cast("date")).alias("valid_to")
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched, pattern, list, valid_from and verdict of each of ``captures(page_id, url, fetched)``.

    The verdict is ``block``, ``allow``, or ``none`` where no entry is active; pattern, list and valid_from are then
    null. A null or broken URL has an empty host, and that or a null day finds nothing. Repeated rows each stay; an
    empty list lets all pass; empty captures give an empty result; other columns are not looked at.
    """
    rows = captures.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
        F.col("fetched").cast("date").alias("fetched"),
    )
    seen = rows.where("host <> '' AND fetched IS NOT NULL").select("host", "fetched").distinct()
    asked = seen.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("suffix"))
    # Names and days meet the list without the hosts below them: a parent domain has as many rows as days, not hosts.
    days = asked.select("suffix", "fetched").distinct()
    listed = intervals(entries)
    active = days.join(
        listed,
        (days["suffix"] == listed["pattern"]) & (days["fetched"] >= listed["valid_from"]) & (days["fetched"] < listed["valid_to"]),
    )
    best = F.struct(F.length("pattern").alias("n"), (F.col("list") == "allow").alias("allow"), "pattern", "list", "valid_from")
    by_name = active.groupBy("suffix", "fetched").agg(F.max(best).alias("best"))
    decided = asked.join(by_name, ["suffix", "fetched"]).groupBy("host", "fetched").agg(F.max("best").alias("best"))
    return rows.join(decided, ["host", "fetched"], "left").select(
        "page_id", "host", "fetched", F.col("best.pattern").alias("pattern"), F.col("best.list").alias("list"),
        F.col("best.valid_from").alias("valid_from"), F.coalesce("best.list", F.lit("none")).alias("verdict"),
    )


# The pages table has no dates and comes with no list, so the registered query derives both from it: a fetch day from
# the page_id, and a history of entries for each host and parent domain from the MD5 of its name.
FIRST_DAY, DAYS = "2023-01-01", 900


def derived_captures(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.select(F.explode(suffixes(F.col("host"))).alias("pattern")).distinct()
    part = lambda i: F.conv(F.substring(F.md5("pattern"), 4 * i + 1, 4), 16, 10).cast("int")
    listed = names.select("pattern", *[part(i).alias(f"x{i}") for i in range(4)])
    start = F.col("x1") % DAYS
    entry = lambda kind, offset, action: F.struct(
        F.lit(kind).alias("list"), F.date_add(F.lit(FIRST_DAY).cast("date"), offset.cast("int")).alias("day"), F.lit(action).alias("action")
    )
    blocked = F.array(
        entry("block", start, "add"), entry("block", start + 30 + F.col("x2") % 200, "remove"),
        entry("block", start + 300 + F.col("x3") % 100, "add"),
    )
    allowed = F.array(entry("allow", F.col("x2") % DAYS, "add"))
    none = F.filter(allowed, lambda e: F.lit(False))
    return listed.select("pattern", F.explode(F.concat(
        F.when(F.col("x0") % 3 == 0, blocked).otherwise(none), F.when(F.col("x0") % 7 == 1, allowed).otherwise(none),
    )).alias("e")).select("pattern", "e.list", "e.day", "e.action")


ORACLE_SQL = f"""
WITH rows AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]+)', 1)), '\\.$', '') AS host,
    (DATE '{FIRST_DAY}' + CAST(((page_id * 7919) % {DAYS} + {DAYS}) % {DAYS} AS INTEGER))::DATE AS fetched FROM pages
), suffix AS (
  SELECT DISTINCT host, array_to_string(list_slice(labels, i, len(labels)), '.') AS pattern
  FROM (SELECT host, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i
        FROM (SELECT DISTINCT host, string_split(host, '.') AS labels FROM rows WHERE host <> ''))
), x AS (
  SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INTEGER AS x0, ('0x' || substr(md5(pattern), 5, 4))::INTEGER AS x1,
    ('0x' || substr(md5(pattern), 9, 4))::INTEGER AS x2, ('0x' || substr(md5(pattern), 13, 4))::INTEGER AS x3
  FROM (SELECT DISTINCT pattern FROM suffix)
), entries AS (
  SELECT pattern, 'block' AS list, x1 % {DAYS} AS d, true AS added FROM x WHERE x0 % 3 = 0
  UNION ALL SELECT pattern, 'block', x1 % {DAYS} + 30 + x2 % 200, false FROM x WHERE x0 % 3 = 0
  UNION ALL SELECT pattern, 'block', x1 % {DAYS} + 300 + x3 % 100, true FROM x WHERE x0 % 3 = 0
  UNION ALL SELECT pattern, 'allow', x2 % {DAYS}, true FROM x WHERE x0 % 7 = 1
), known AS (SELECT pattern, list, d, bool_or(added) AS added FROM entries GROUP BY ALL),
valid AS (
  SELECT pattern, list, (DATE '{FIRST_DAY}' + d)::DATE AS valid_from,
    coalesce((DATE '{FIRST_DAY}' + nxt)::DATE, DATE '{OPEN_END}') AS valid_to
  FROM (SELECT *, lead(d) OVER (PARTITION BY pattern, list ORDER BY d) AS nxt FROM known) WHERE added
), best AS (
  SELECT r.page_id, s.host, r.fetched, v.*,
    row_number() OVER (PARTITION BY r.page_id, r.host, r.fetched ORDER BY length(v.pattern) DESC, v.list = 'allow' DESC) AS k
  FROM rows r JOIN suffix s USING (host) JOIN valid v ON v.pattern = s.pattern AND r.fetched >= v.valid_from AND r.fetched < v.valid_to
)
SELECT r.page_id, r.host, r.fetched, b.pattern, b.list, b.valid_from, coalesce(b.list, 'none') AS verdict
FROM rows r LEFT JOIN best b ON b.k = 1 AND b.page_id = r.page_id AND b.host = r.host AND b.fetched = r.fetched
"""
