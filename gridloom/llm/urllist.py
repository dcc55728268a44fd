"""Operator 7 (native): temporal list join for URLs.

A list's dated entries (add, remove) become validity intervals per key.  Keys
are host suffixes.  Each host's intervals are gathered once, over the hosts that
occur; an as-of join on the host then evaluates every capture against the
entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import OWN, bounded, free, materialise

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url):
    """The lower-cased host of an absolute URL without a trailing dot; null if there is none."""
    h = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(h != "", h)


def suffixes(host):
    """a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame, *, key_col: str = "key", action_col: str = "action", time_col: str = "at") -> DataFrame:
    """(key, since, until) while a key is listed; until is exclusive and null while it lasts.

    An entry holds until the key's next one.  Of entries at one instant a
    removal counts last; repeated entries count once.  Rows with a null key or
    time, or another action than add or remove, are left out.
    """
    e = (
        entries.select(F.lower(key_col).alias("key"), F.col(action_col).alias("action"), F.col(time_col).alias("since"))
        .filter(F.col("key").isNotNull() & F.col("since").isNotNull() & F.col("action").isin("add", "remove"))
        .groupBy("key", "since")
        .agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    )
    until = F.lead("since").over(W.partitionBy("key").orderBy("since"))
    return e.withColumn("until", until).filter(F.col("action") == "add").select("key", "since", "until")


def evaluate(
    captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched", **entry_cols
) -> DataFrame:
    """``captures`` with host, blocked, entry and listed_since as of their fetch time.

    Of several active keys the longest decides, then the latest listing.  A
    capture without host or time is not blocked.  Every row stays, repeated
    ones included.  Where the caller has columns of these names, they stay and
    the added ones are prefixed.
    """
    name = {c: free(c, captures.columns) for c in ("host", "blocked", "entry", "listed_since")}
    own, at = {c: OWN + c for c in ("list", "first", "for")}, F.col(time_col)
    c = captures.withColumn(name["host"], host_of(F.col(url_col)))
    hosts = c.select(F.col(name["host"]).alias("host")).filter(F.col("host").isNotNull()).distinct()
    matched = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("key")).join(intervals(entries, **entry_cols), "key")
    listed = F.collect_list(F.struct(F.length("key").alias("size"), "since", "key", "until"))
    lists = materialise(matched.groupBy(F.col("host").alias(own["for"])).agg(F.sort_array(listed, asc=False).alias(own["list"])))
    active = F.get(F.filter(own["list"], lambda x: (x["since"] <= at) & (x["until"].isNull() | (x["until"] > at))), F.lit(0))
    j = c.join(bounded(lists), F.col(name["host"]) == F.col(own["for"]), "left").withColumn(own["first"], active)
    first = F.col(own["first"])
    return j.withColumns({name["blocked"]: first.isNotNull(), name["entry"]: first["key"], name["listed_since"]: first["since"]}).drop(*own.values())


def dated_list(pages: DataFrame) -> DataFrame:
    """The query's list: dated entries for some of the hosts that occur and for some of their parent domains.

    Stands for a published list, which the tables don't hold; rules on the
    host's own characters decide key, action and day.
    """
    host = host_of(F.col("url"))
    keys = (
        pages.select(host.alias("host"))
        .filter(F.col("host").isNotNull())
        .distinct()
        .select("host", F.regexp_replace("host", r"^[^.]+\.", "").alias("parent"))
    )
    n = lambda c: F.length(c) * 31 + F.ascii(F.substring(c, 2, 1)) * 17 + F.ascii(F.substring(c, 4, 1)) * 7
    some = keys.select(F.explode(F.array("host", "parent")).alias("key")).distinct().withColumn("n", n(F.col("key"))).filter("n % 3 = 0")
    day = lambda k: F.date_add(F.to_date(F.lit("2024-01-01")), k.cast("int"))
    first = F.col("n") % 200
    rows = F.array(
        F.struct(F.lit("add").alias("action"), day(first).alias("at")),
        F.struct(F.lit("remove").alias("action"), F.when(F.col("n") % 2 == 0, day(first + 45)).alias("at")),
        F.struct(F.lit("add").alias("action"), F.when(F.col("n") % 4 == 0, day(first + 90)).alias("at")),
    )
    return some.select("key", F.explode(rows).alias("r")).select("key", "r.action", "r.at").filter("at is not null")


def op7_temporal_list_join(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    # the tables hold no fetch time: a day of 2024 by page
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    got = evaluate(pages.withColumn("fetched", fetched), dated_list(pages))
    return got.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", "entry", F.col("listed_since").cast("string").alias("listed_since"))


OP7_SQL = r"""
WITH c AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host,
         DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetched FROM pages
), k AS (
  SELECT key, length(key) * 31 + ascii(substr(key, 2, 1)) * 17 + ascii(substr(key, 4, 1)) * 7 AS n FROM (
    SELECT DISTINCT host AS key FROM c WHERE host IS NOT NULL
    UNION SELECT DISTINCT regexp_replace(host, '^[^.]+\.', '') FROM c WHERE host IS NOT NULL)
), e AS (
  SELECT key, 'add' AS action, DATE '2024-01-01' + CAST(n % 200 AS INTEGER) AS d FROM k WHERE n % 3 = 0
  UNION ALL SELECT key, 'remove', DATE '2024-01-01' + CAST(n % 200 + 45 AS INTEGER) FROM k WHERE n % 3 = 0 AND n % 2 = 0
  UNION ALL SELECT key, 'add', DATE '2024-01-01' + CAST(n % 200 + 90 AS INTEGER) FROM k WHERE n % 3 = 0 AND n % 4 = 0
), i AS (
  SELECT key, action, d AS since, lead(d) OVER (PARTITION BY key ORDER BY d) AS until FROM e
), m AS (
  SELECT c.page_id, c.host, c.fetched, i.key, i.since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.key) DESC NULLS LAST, i.since DESC NULLS LAST, i.key DESC) AS r
  FROM c LEFT JOIN i ON (c.host = i.key OR ends_with(c.host, '.' || i.key)) AND i.action = 'add'
       AND i.since <= c.fetched AND (i.until IS NULL OR i.until > c.fetched)
)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, key IS NOT NULL AS blocked, key AS entry, CAST(since AS VARCHAR) AS listed_since
FROM m WHERE r = 1
"""
