"""URL filters: a temporal list join. Dated list entries become validity intervals; each capture meets the entries active at its fetch date.

Built-in functions only. A pattern is a host, any parent domain of two labels or more, or
``host/segment/...``, any leading run of path segments. The log of a (pattern, category), ``add`` or
``remove`` on a date, becomes disjoint intervals ``[from, to)``, so a pattern may be listed in several
categories at once. The as-of join works on the distinct (url, fetch date) pairs: their patterns meet
the intervals by (pattern, time bucket) with the interval test as residue, so a host that holds a third
of all captures is spread over the buckets and its repeats count once. The most specific active entry
of each pair goes back to the captures by a join of two plain shuffles, whose large partitions adaptive
execution can split.

Defined results: a null url or fetch date matches nothing; entries with a null pattern, date or
action are ignored, a null category is one of its own; of entries of one pattern and category on one
date ``remove`` comes last and wins; of several active entries the longest path wins, then the host,
then the nearest parent, then the first category; repeated captures and entries are no special case;
numeric addresses have no parents; empty tables give empty or unblocked results; capture columns named
like an output are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import private

#: Days in a time bucket of the as-of join.
BUCKET_DAYS = 30


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def url_patterns(url: Column) -> Column:
    """Array of (level, pattern), most specific first: paths, host, parents. Patterns are null without a host."""
    host = url_host(url)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/", -1), lambda x: x != "")
    labels = F.split(host, r"\.", -1)
    entry = lambda level, pattern: F.struct(F.lit(level).alias("level"), pattern.alias("pattern"))
    paths = F.transform(F.sequence(F.size(segments), F.lit(1), F.lit(-1)), lambda k: entry("path", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), k), "/"))))
    parents = F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: entry("parent", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    none = F.filter(F.array(entry("host", host)), lambda _: F.lit(False))
    has_parents = (F.size(labels) >= 3) & ~host.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.concat(F.when(F.size(segments) > 0, paths).otherwise(none), F.array(entry("host", host)), F.when(has_parents, parents).otherwise(none))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, listed_from, listed_to) of the spans during which a pattern was listed in a category; an open end is null.

    Patterns are compared without blanks around them and with their host in lower case, as hosts of captures are.
    """
    trimmed = F.trim("pattern")
    host = F.substring_index(trimmed, "/", 1)
    entries = entries.withColumn("pattern", F.concat(F.lower(host), F.substr(trimmed, F.length(host) + 1)))
    log = entries.where("pattern IS NOT NULL AND listed_on IS NOT NULL AND action IN ('add', 'remove')").select("pattern", "category", "listed_on", "action").distinct()
    by_date = Window.partitionBy("pattern", "category").orderBy("listed_on", "action")
    spans = log.withColumn("listed_to", F.lead("listed_on").over(by_date)).where("action = 'add' AND (listed_to IS NULL OR listed_to > listed_on)")
    return spans.select("pattern", "category", F.col("listed_on").alias("listed_from"), "listed_to")


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS)


def temporal_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", date_col: str = "fetched_on") -> DataFrame:
    """``captures`` with host, blocked, and the level, pattern, category and interval of the most specific active entry."""
    horizon = F.lit(captures.agg(F.max(date_col)).first()[0]).cast("date")
    spans = validity_intervals(entries).where(F.col("listed_from") <= horizon)
    last_day = F.least(F.coalesce(F.date_sub("listed_to", 1), horizon), horizon)
    spans = spans.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("listed_from")), _bucket(last_day))))
    pairs = captures.select(F.col(url_col).alias("url"), F.col(date_col).alias("day")).where("url IS NOT NULL AND day IS NOT NULL").distinct()
    asked = pairs.select("url", "day", _bucket(F.col("day")).alias("bucket"), F.posexplode(url_patterns(F.col("url"))).alias("rank", "e")).select("url", "day", "bucket", "rank", "e.*").where("pattern IS NOT NULL")
    hits = asked.join(spans, ["pattern", "bucket"]).where("listed_from <= day AND (listed_to IS NULL OR day < listed_to)")
    own_url, own_day, own_hit = private(captures, "url", "day", "hit")
    best = hits.groupBy(F.col("url").alias(own_url), F.col("day").alias(own_day)).agg(F.min(F.struct("rank", "category", "listed_from", "listed_to", "level", "pattern")).alias(own_hit))
    hit = F.col(own_hit)
    out = captures.join(best, (F.col(url_col) == F.col(own_url)) & (F.col(date_col) == F.col(own_day)), "left")
    out = out.withColumns({"host": url_host(F.col(url_col)), "blocked": hit.isNotNull(), **{c: hit[c] for c in ("level", "pattern", "category", "listed_from", "listed_to")}})
    return out.drop(own_url, own_day, own_hit)
