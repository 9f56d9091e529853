"""URL filters by a temporal list join: dated list entries become validity intervals, and each capture is judged by the entries active when it was fetched.

A list is a log of (list, verdict, pattern, action, day): ``add`` makes the pattern active from that day on, ``remove``
ends it.  Patterns are ``host:h`` (that host), ``domain:d`` (d and all below it) and ``prefix:h/p`` (paths below h/p, by whole
segments).  A capture has one key for each pattern that could match it, up to the most segments and labels that any listed
pattern has (so a URL's keys grow with the lists' patterns, not with the square of its length), and the join is an equality on the key, with the fetch
day inside the interval as its condition.  The join is declared; Spark broadcasts the lists only if their measured size is
below its threshold and otherwise sorts and merges, splitting hot hosts (adaptive skew handling).

Defined cases: a null or unparsable URL has no keys and a null day is inside no interval: verdict ``none``; of several
entries on one day for a pattern the add wins; repeated entries change nothing; repeated captures (page_id, url and day)
are one row with their number in ``n_captures``; ``allow`` beats ``block``; empty lists judge everything ``none``; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: str) -> Column:
    return F.regexp_extract(F.lower(F.col(url)), HOST, 1)


def keys(url: str, depth: Column, width: Column) -> Column:
    """Every pattern of at most ``depth`` path segments or ``width`` domain labels that could match the URL."""
    labels = F.split(host(url), "\\.")
    segments = F.filter(F.split(F.regexp_extract(F.col(url), PATH, 1), "/"), lambda s: s != "")
    segments = F.slice(segments, 1, depth)
    domains = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - width + 1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(segments, lambda s, i: F.concat(F.lit("prefix:"), host(url), F.lit("/"), F.array_join(F.slice(segments, 1, i + 1), "/")))
    found = F.concat(F.array(F.concat(F.lit("host:"), host(url))), domains, prefixes)
    return F.when(F.col(url).isNotNull() & (host(url) != ""), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, pattern, first_day, end_day): active from first_day until before end_day, null for ever."""
    daily = entries.groupBy("list", "verdict", "pattern", "day").agg(F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("active"))
    own = W.partitionBy("list", "verdict", "pattern").orderBy("day")
    spans = daily.filter(F.col("day").isNotNull()).withColumn("end_day", F.lead("day").over(own))
    return spans.filter("active = 1").select("list", "verdict", "pattern", F.col("day").alias("first_day"), "end_day")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Captures (page_id, url, day) with n_captures, n_active entries, the names of the lists and the verdict: allow, block or none."""
    once = captures.groupBy("page_id", "url", "day").agg(F.count("*").alias("n_captures"))
    spans = intervals(entries).select("list", "verdict", F.col("pattern").alias("_key"), "first_day", "end_day")
    depth, width = F.size(F.split("_key", "/")) - 1, F.size(F.split("_key", "\\."))
    most = [spans.agg(F.coalesce(F.max(F.when(F.col("_key").startswith(kind), n)), F.lit(least))).scalar() for kind, n, least in (("prefix:", depth, 0), ("domain:", width, 1))]
    keyed = once.select("*", most[0].alias("_depth"), most[1].alias("_width"))
    keyed = keyed.select("page_id", "url", "day", "n_captures", F.explode_outer(keys("url", F.col("_depth"), F.col("_width"))).alias("_key"))
    active = (keyed["_key"] == spans["_key"]) & (keyed["day"] >= spans["first_day"]) & (spans["end_day"].isNull() | (keyed["day"] < spans["end_day"]))
    met = keyed.join(spans, active, "left").groupBy("page_id", "url", "day").agg(
        F.max("n_captures").alias("n_captures"), F.count("list").alias("n_active"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.max(F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1).otherwise(0)).alias("_rank"),
    )
    return met.withColumn("verdict", F.when(F.col("_rank") == 2, "allow").when(F.col("_rank") == 1, "block").otherwise("none")).drop("_rank")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch times: the day follows from page_id by a rule."""
    return pages.select("page_id", "url", F.expr("date_add(DATE '2023-01-01', CAST(pmod(page_id * 7919, 730) AS int))").alias("day"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Lists for the pages table, which brings none: entries on its hosts, domains and paths, dated by digests of the patterns."""
    known = pages.select(host("url").alias("h"), F.regexp_extract("url", PATH, 1).alias("p")).filter("h <> ''").distinct()
    own = F.col("h")
    domain = F.expr("array_join(slice(split(h, '\\\\.'), greatest(1, size(split(h, '\\\\.')) - 1), 2), '.')")
    segment = F.expr("try_element_at(filter(split(p, '/'), s -> s <> ''), 1)")
    made = [
        ("ads", "block", F.concat(F.lit("host:"), own), 4),
        ("malware", "block", F.concat(F.lit("domain:"), domain), 8),
        ("adult", "block", F.concat(F.lit("prefix:"), own, F.lit("/"), segment), 5),
        ("trusted", "allow", F.concat(F.lit("host:"), own), 2),
    ]
    each = [F.struct(F.lit(n).alias("list"), F.lit(v).alias("verdict"), p.alias("pattern"), F.lit(s).alias("share")) for n, v, p, s in made]
    rules = known.select(F.explode(F.array(*each)).alias("r")).select("r.*").filter("pattern IS NOT NULL").distinct()
    digest = F.md5(F.concat(F.col("list"), F.lit("|"), F.col("pattern")))

    def number(first: int, digits: int) -> Column:
        return F.conv(F.substring(digest, first, digits), 16, 10).cast("int")

    day = F.expr("DATE '2023-01-01'")
    first = F.date_add(day, number(2, 3) % 500)
    second = F.date_add(first, 30 + number(5, 3) % 200)
    third = F.date_add(second, 10 + number(8, 3) % 100)
    dated = rules.filter(number(1, 1) < F.col("share")).select(
        "list", "verdict", "pattern",
        F.explode(F.array(*(F.struct(a.alias("action"), d.alias("day")) for a, d in ((F.lit("add"), first), (F.lit("remove"), second), (F.when(number(11, 1) < 8, "add").otherwise("remove"), third))))).alias("e"),
    )
    return dated.select("list", "verdict", "pattern", "e.action", "e.day")
