"""URL filters by a temporal list join.

A list is a history of dated entries (kind, value, action, at): `domain` entries cover a host and all below it, `url`
entries one address without scheme, query, fragment and closing slash. `add` opens a validity interval of its value,
the next entry of the value closes it. A capture is judged by the entries active when it was fetched: an as-of join on
every suffix of its host and on its address, `valid_from <= fetched_at < valid_to`.

Both sides are put into one form: hosts in lower case without a closing dot; a domain entry may be written as a host, as `*.host`, with a leading dot or as an address, of
which its host counts; an url entry may have a scheme, user, port, query, fragment or closing slash, and its host any case. Paths keep their case.

The intervals of a value travel as one sorted array, so the join is an equality join and a value with a long history makes
no more rows than one without; the verdict is worked out once for each distinct (url, time) and joined back.

Defined results: a null or unparsable url, or a null time, matches nothing; of entries of one value and moment, remove counts last;
repeated entries count once; repeated captures are judged alike; extra columns pass through, one
with the name of a new column is replaced; an empty list and entries without a host block nothing;
kept() returns the captures' own columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

FOREVER = 253402300800  # the year 10000, in seconds


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url):
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), r"\.+$", "")


def address_of(url):
    """Host and path: no scheme, user, port, query, fragment or closing slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.concat(host_of(url), path), "/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """entries(kind, value, action, at) -> (kind, value, valid_from, valid_to): when a value is listed."""
    whole = F.trim("value")
    whole = F.when(whole.rlike(_SCHEME), whole).otherwise(F.concat(F.lit("any://"), whole))
    domain = F.regexp_replace(host_of(F.regexp_replace(whole, r"://(\*?\.)+", "://")), r"^\.+", "")
    e = entries.select("kind", F.when(F.col("kind") == "domain", domain).otherwise(address_of(whole)).alias("value"), "action", "at")
    e = e.filter("value <> '' AND at IS NOT NULL").distinct()
    moment = e.groupBy("kind", "value", "at").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    turn = Window.partitionBy("kind", "value").orderBy("at")
    spans = moment.withColumn("to", F.coalesce(F.lead("at").over(turn), F.lit(FOREVER)))
    return spans.filter("action = 'add'").select("kind", "value", F.col("at").alias("valid_from"), F.col("to").alias("valid_to"))


def suffixes_of(host):
    """A host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with blocked, n_rules (listed values active at the time) and rule (the least of them).

    Domains are looked up for each distinct host, not for each capture, so a suffix such as `com` meets the list once for each host below it and
    goes before captures are joined: these meet only the hosts that the list covers.
    """
    asked = captures.select(F.col(url).alias("u"), F.col(at).alias("t")).filter("u IS NOT NULL AND t IS NOT NULL").distinct()
    asked = asked.select("u", "t", host_of(F.col("u")).alias("host"), address_of(F.col("u")).alias("address")).filter("host <> ''")
    listed = intervals(entries).groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to"))).alias("spans"))
    hosts = asked.select("host").distinct().select("host", F.explode(suffixes_of(F.col("host"))).alias("value"))
    covered = hosts.join(listed.filter("kind = 'domain'"), "value")
    by_host = asked.join(covered, "host").select("u", "t", "kind", "value", "spans")
    by_address = asked.join(listed.filter("kind = 'url'").withColumnRenamed("value", "address"), "address").select("u", "t", "kind", F.col("address").alias("value"), "spans")
    hit = by_host.unionByName(by_address).filter(F.exists("spans", lambda s: (s["valid_from"] <= F.col("t")) & (F.col("t") < s["valid_to"])))
    verdict = hit.groupBy(F.col("u").alias("__u"), F.col("t").alias("__t")).agg(F.count("*").alias("__n"), F.min(F.concat_ws(":", "kind", "value")).alias("__rule"))
    out = captures.join(verdict, (F.col(url) == F.col("__u")) & (F.col(at) == F.col("__t")), "left")
    new = {"blocked": F.col("__n").isNotNull(), "n_rules": F.coalesce("__n", F.lit(0)), "rule": F.col("__rule")}
    return out.select(*[F.col(c) for c in captures.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def kept(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """The captures that no active entry covers."""
    row = F.struct(*[F.col(c) for c in captures.columns]).alias("__row")
    asked = captures.select(row, F.col(url).alias("__url"), F.col(at).alias("__at"))
    return judged(asked, entries, "__url", "__at").filter(~F.col("blocked")).select("__row.*")


DAY = 86400
BEGIN = 1704067200  # 2024-01-01


def captured(pages: DataFrame) -> DataFrame:
    """pages with the fetch time that the table lacks, in seconds: a day of 2024 by page_id."""
    return pages.select("page_id", "url", (F.lit(BEGIN) + F.pmod(F.pmod("page_id", F.lit(366)) * 7919, F.lit(366)) * DAY + F.pmod("page_id", F.lit(DAY))).alias("fetched_at"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A list history made from the table's hosts: each third host (by name length) is added, removed and added again; casinos always are
    listed; and so is, from a day of 2024 on, each seventh address (by length)."""
    hosts = pages.select(host_of(F.col("url")).alias("value")).filter("value <> ''").distinct()
    n = F.length("value")
    step = lambda action, days: F.struct(F.lit("domain").alias("kind"), F.col("value").alias("value"), F.lit(action).alias("action"), (F.lit(BEGIN) + (n * 5 + days) * DAY).cast("long").alias("at"))
    some = hosts.filter(n % 3 == 0).select(F.explode(F.array(step("add", 0), step("remove", 90), step("add", 180))).alias("x")).select("x.*")
    casino = hosts.filter(F.col("value").contains("casino")).select(F.lit("domain").alias("kind"), F.regexp_replace("value", r"^[^.]*?\.(?=.*casino)", "").alias("value"), F.lit("add").alias("action"), F.lit(0).cast("long").alias("at"))
    address = pages.select(address_of(F.col("url")).alias("value"), host_of(F.col("url")).alias("host")).filter("host <> ''").select("value").distinct().filter(F.length("value") % 7 == 0)
    single = address.select(F.lit("url").alias("kind"), "value", F.lit("add").alias("action"), (F.lit(BEGIN) + F.length("value") * 5 * DAY).cast("long").alias("at"))
    return some.unionByName(casino).unionByName(single)


def digest(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(captured(pages), listed_hosts(pages))


SQL = r"""
WITH cap AS (
  SELECT *, regexp_replace(host || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS address FROM (
    SELECT row_number() OVER () AS r, page_id, url, 1704067200 + (page_id * 7919 % 366) * 86400 + page_id % 86400 AS fetched_at,
         regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', '') AS host
    FROM pages)),
hosts AS (SELECT DISTINCT host AS value FROM cap WHERE host <> ''),
entries AS (
  SELECT 'domain' AS kind, value, unnest(['add', 'remove', 'add']) AS action, 1704067200 + (length(value) * 5 + unnest([0, 90, 180])) * 86400 AS moment_s
  FROM hosts WHERE length(value) % 3 = 0
  UNION
  SELECT 'domain', CASE WHEN regexp_matches(value, '^[^.]*\..*casino') THEN regexp_replace(value, '^[^.]*\.', '') ELSE value END, 'add', 0
  FROM hosts WHERE value LIKE '%casino%'
  UNION
  SELECT 'url', address, 'add', 1704067200 + length(address) * 5 * 86400 FROM cap WHERE host <> '' AND length(address) % 7 = 0),
moment AS (SELECT kind, value, moment_s, max(action) AS action FROM entries GROUP BY kind, value, moment_s),
spans AS (SELECT kind, value, action, moment_s AS f, coalesce(lead(moment_s) OVER (PARTITION BY kind, value ORDER BY moment_s), 253402300800) AS t FROM moment),
hits AS (
  SELECT r, kind || ':' || value AS rule FROM cap JOIN spans ON action = 'add' AND fetched_at >= f AND fetched_at < t
  AND CASE WHEN kind = 'url' THEN address = value ELSE host = value OR suffix(host, '.' || value) END)
SELECT page_id, url, fetched_at, count(rule) > 0 AS blocked, count(rule) AS n_rules, min(rule) AS rule
FROM cap LEFT JOIN hits USING (r) GROUP BY r, page_id, url, fetched_at
"""
