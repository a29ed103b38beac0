"""URL filters as a temporal list join.

A list is a history: dated entries that put a pattern (a domain, a host or a host with leading path parts) on it or take
it off.  The entries of a pattern become validity intervals [since, until): the last entry of a day counts, a removal
beats an addition of the same day, and repeats of a state start nothing new.  A capture of a URL is judged by the
entries in force on the day it was fetched: it is blocked if an interval of any of its patterns holds that day, and the
most specific pattern (host with path before host before wider domains, the longest first) gives the reason.

Captures are reduced to distinct (URL, day) before anything else and their patterns to distinct (pattern, day) before the
as-of join, so a host with a third of all captures is joined once per day and path, not once per capture.

Defined cases: a null or malformed URL and a capture without a day are not blocked; entries without a pattern or day are
ignored; an entry that is repeated counts once; repeated captures are judged one by one with the same verdict; empty
captures give an empty result and an empty list blocks nothing; an IPv4 address has no parent domains; no URL falls under
a public suffix of two labels (``co.uk``), only under names below it; a very long URL has as many path patterns as the
deepest entry has path parts; further columns of the captures are kept whatever their names, and columns named like an
added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.rows import columns as quoted

ADDED = ("host", "blocked", "rule", "category", "listed_since", "n_matches")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
#: Public suffixes of two labels under which names are given out.
SUFFIXES = "ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk com.au edu.au gov.au net.au org.au ac.jp co.jp go.jp ne.jp or.jp co.nz net.nz org.nz co.za org.za com.br net.br org.br co.in net.in org.in com.cn net.cn org.cn com.mx com.tr com.tw com.sg com.hk co.kr or.kr co.il com.ar com.pl com.ua".split()
_ADDRESS = r"^[0-9]{1,3}([.][0-9]{1,3}){3}$"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(host != "", F.regexp_replace(host, r"\.+$", ""))


def patterns_of(depth: int) -> Column:
    """The patterns of a row with host, labels and path, the most specific first: up to ``depth`` path parts, host, parent domains down to two labels."""
    suffixes = ", ".join(f"'{x}'" for x in SUFFIXES)
    return F.expr(f"""
        concat(
            case when size(path) > 0 and {depth} > 0 then reverse(transform(sequence(1, least(size(path), {depth})), i -> concat(host, '/', array_join(slice(path, 1, i), '/')))) else cast(array() as array<string>) end,
            array(host),
            case when size(labels) > 2 and not host rlike '{_ADDRESS}'
                 then filter(transform(sequence(1, size(labels) - 2), i -> array_join(slice(labels, i + 1, size(labels)), '.')), x -> x not in ({suffixes})) else cast(array() as array<string>) end)""")


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, category, since, until)`` of ``entries(pattern, category, day, action)``; until is null while it holds."""
    daily = entries.where("pattern is not null and day is not null and action in ('add', 'remove')").groupBy("pattern", F.coalesce("category", F.lit("")).alias("category"), "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern", "category").orderBy("day")
    turns = daily.withColumn("was", F.lag("action").over(order)).where("was is null or was <> action")
    return turns.withColumn("until", F.lead("day").over(order)).where("action = 'add'").select("pattern", "category", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(url, day, ...)`` with ``ADDED``."""
    kept = quoted([c for c in captures.columns if c not in ADDED])
    depth = entries.agg(F.max(F.size(F.split("pattern", "/")) - 1).alias("n")).first()["n"] or 0  # one number
    seen = captures.where("url is not null and day is not null").select("url", "day").distinct()
    seen = seen.withColumn("host", host_of(F.col("url"))).where("host is not null")
    seen = seen.withColumn("path", F.filter(F.split(F.regexp_extract("url", _PATH, 1), "/"), lambda x: x != "")).withColumn("labels", F.split("host", r"\."))
    asked = seen.select("url", "day", F.posexplode(patterns_of(depth)).alias("place", "pattern"))
    wanted = asked.select("pattern", "day").distinct()
    valid = wanted.join(intervals(entries), "pattern").where("since <= day and (until is null or day < until)")
    rules = valid.groupBy("pattern", "day").agg(F.min(F.struct("category", "since")).alias("r"), F.count("*").alias("n"))
    hits = asked.join(rules, ["pattern", "day"]).groupBy("url", "day").agg(F.min(F.struct("place", "pattern", "r")).alias("m"), F.sum("n").alias("n_matches"))
    hits = hits.select("url", "day", F.col("m.pattern").alias("rule"), F.col("m.r.category").alias("category"), F.col("m.r.since").alias("listed_since"), "n_matches")
    rows = captures.select(F.struct(*kept).alias("row"), "url", "day").join(hits, ["url", "day"], "left")
    return rows.select("row.*", host_of(F.col("url")).alias("host"), F.col("rule").isNotNull().alias("blocked"), "rule", "category", "listed_since", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


def _number(text: Column) -> Column:
    """A number from the first seven hex digits of an MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetch that follows from their page_id, since the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), (F.pmod(F.col("page_id"), F.lit(1500)) * 37 % 1500).cast("int")).alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list history over the hosts, domains and first path parts of the pages: added, taken off, perhaps added again."""
    urls = pages.where("url is not null").select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1).alias("first")).where("host is not null").distinct()
    hosts = urls.select(F.col("host").alias("pattern"), F.lit(3).alias("every"), F.lit("host").alias("category"))
    domains = urls.where(F.col("host").rlike("[.].*[.]") & ~F.col("host").rlike(_ADDRESS)).select(F.regexp_extract("host", r"[^.]+\.[^.]+$", 0).alias("pattern"), F.lit(7), F.lit("domain")).where(~F.col("pattern").isin(SUFFIXES))
    paths = urls.where("first <> ''").select(F.concat("host", F.lit("/"), "first").alias("pattern"), F.lit(4), F.lit("path"))
    listed = hosts.union(domains).union(paths).distinct().withColumn("x", _number(F.col("pattern"))).where("x % every = 0")
    start = F.date_add(F.lit("2020-01-01").cast("date"), F.col("x") % 900)
    dated = [(F.date_add(start, 0), "add"), (F.date_add(start, 100 + F.col("x") % 300), "remove"), (F.date_add(start, 500 + F.col("x") % 200), "add")]
    turns = F.explode(F.array(*[F.struct(day.alias("day"), F.lit(action).alias("action")) for day, action in dated])).alias("t")
    return listed.select("pattern", "category", turns).select("pattern", "category", "t.day", "t.action")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = judge(captures_of(pages), entries_of(pages))
    return found.select("page_id", "host", F.col("day").alias("fetched"), "blocked", "rule", "category", "listed_since", "n_matches")


_NONE = ", ".join(f"'{x}'" for x in SUFFIXES)
ORACLES = {
    "op6_temporal_url_lists": rf"""
    WITH pg AS (SELECT page_id, url, DATE '2020-01-01' + CAST(page_id % 1500 * 37 % 1500 AS INTEGER) AS fetched,
                       nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
                       list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS path FROM pages),
    listed AS (
        SELECT DISTINCT host AS pattern, 3 AS every, 'host' AS category FROM pg WHERE host IS NOT NULL
        UNION SELECT DISTINCT regexp_extract(host, '[^.]+\.[^.]+$'), 7, 'domain' FROM pg WHERE regexp_matches(host, '[.].*[.]') AND NOT regexp_matches(host, '{_ADDRESS}') AND regexp_extract(host, '[^.]+\.[^.]+$') NOT IN ({_NONE})
        UNION SELECT DISTINCT host || '/' || path[1], 4, 'path' FROM pg WHERE host IS NOT NULL AND len(path) > 0),
    dated AS (SELECT pattern, category, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS x, every FROM listed),
    turns AS (SELECT pattern, category, unnest([
        {{'day': DATE '2020-01-01' + CAST(x % 900 AS INTEGER), 'action': 'add'}},
        {{'day': DATE '2020-01-01' + CAST(x % 900 + 100 + x % 300 AS INTEGER), 'action': 'remove'}},
        {{'day': DATE '2020-01-01' + CAST(x % 900 + 500 + x % 200 AS INTEGER), 'action': 'add'}}]) AS t FROM dated WHERE x % every = 0),
    daily AS (SELECT pattern, category, t.day AS d, max(t.action) AS action FROM turns GROUP BY ALL),
    changes AS (SELECT *, lag(action) OVER (PARTITION BY pattern, category ORDER BY d) AS was FROM daily),
    spans AS (SELECT pattern, category, d AS since, lead(d) OVER (PARTITION BY pattern, category ORDER BY d) AS until, action FROM changes WHERE was IS NULL OR was <> action),
    labels AS (SELECT *, string_split(host, '.') AS l FROM pg),
    asked AS (
        SELECT page_id, fetched, -i AS place, host || '/' || array_to_string(path[1:i], '/') AS pattern FROM labels, unnest(range(1, len(path) + 1)) AS u(i) WHERE host IS NOT NULL
        UNION ALL SELECT page_id, fetched, 0, host FROM labels WHERE host IS NOT NULL
        UNION ALL SELECT page_id, fetched, i, array_to_string(l[i + 1:], '.') FROM labels, unnest(range(1, len(l) - 1)) AS u(i) WHERE host IS NOT NULL AND NOT regexp_matches(host, '{_ADDRESS}') AND array_to_string(l[i + 1:], '.') NOT IN ({_NONE})),
    hits AS (SELECT a.page_id, a.place, s.pattern, s.category, s.since, count(*) OVER (PARTITION BY a.page_id) AS n,
                    row_number() OVER (PARTITION BY a.page_id ORDER BY a.place, s.category, s.since) AS k
             FROM asked a JOIN spans s ON s.pattern = a.pattern AND s.action = 'add' AND s.since <= a.fetched AND (s.until IS NULL OR a.fetched < s.until))
    SELECT pg.page_id, pg.host, pg.fetched, h.page_id IS NOT NULL AS blocked, h.pattern AS rule, h.category, h.since AS listed_since, coalesce(h.n, 0) AS n_matches
    FROM pg LEFT JOIN hits h ON h.page_id = pg.page_id AND h.k = 1"""
}

QUERIES = {"op6_temporal_url_lists": op6_urls}
