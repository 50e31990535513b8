"""URL filters as a temporal list join, with DataFrame functions only.

A list is a history of dated entries: an entry blocks or allows a key (a host with all its subdomains, or a host and the
first segment of a path) or takes the key off the list. Entries become validity intervals; every capture is judged by the
entries that were active when it was fetched, and the most specific active one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Days of a period: intervals and captures meet by key and period, so a long history is not scanned for each capture.
PERIOD = 64


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def first_segment(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) from (key, action, day, seq): an entry holds until the day of the key's next one.

    Of several entries of a key on one day the one with the largest seq counts. ``remove`` ends an interval and begins none.
    """
    days = entries.where("key is not null and day is not null").groupBy("key", "day").agg(F.max_by("action", "seq").alias("action"))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return days.withColumn("until", following).where("action <> 'remove'").select("key", "action", F.col("day").alias("since"), "until")


def keys_of(host: Column, segment: Column) -> Column:
    """The keys that can judge a capture: host/segment, the host, and every parent domain of at least two labels."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(F.when(segment != "", F.array(F.concat_ws("/", host, segment))).otherwise(F.array().cast("array<string>")), parents))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, day, and any other columns) with host, blocked, matched_key, action, since.

    * Captures without a url, a host or a day match nothing and are not blocked; repeated captures are judged alike.
    * The longest active key decides; keys of one length cannot tie, as they are suffixes of one name.
    * An empty list blocks nothing. A column of captures that has the name of one of the five gives way to it.
    """
    rows = captures.withColumn("host of url", host_of(F.col("url"))).withColumn("segment of path", first_segment(F.col("url")))
    # Captures are judged once for each host, segment and day, however many there are.
    probe = (rows.where("`host of url` <> '' and day is not null")
             .select(F.col("host of url").alias("host"), F.col("segment of path").alias("segment"), "day").distinct())
    asked = probe.withColumn("key", F.explode(keys_of(F.col("host"), F.col("segment")))).withColumn("period", F.floor(F.col("day") / PERIOD))
    last = probe.agg(F.max("day")).first()[0]
    valid = intervals(entries).where(F.col("since") <= F.lit(last))
    until = F.coalesce(F.least("until", F.lit(last)), F.lit(last))
    valid = valid.withColumn("period", F.explode(F.sequence(F.floor(F.col("since") / PERIOD), F.floor(until / PERIOD))))
    # The planner takes exploded sides for as small as their source and would broadcast them.
    hit = asked.hint("merge").join(valid.hint("merge"), ["key", "period"]).where("day >= since and (until is null or day < until)")
    best = hit.groupBy("host", "segment", "day").agg(F.max(F.struct(F.length("key").alias("length"), "key", "action", "since")).alias("best"))
    best = best.select(*[F.col(c).alias(f"{c} judged") for c in best.columns])
    joined = rows.join(best, (rows["host of url"] == best["host judged"]) & (rows["segment of path"] == best["segment judged"]) & (rows["day"] == best["day judged"]), "left")
    judged = {"host": F.col("host of url"), "blocked": F.coalesce(F.col("best judged.action") == "block", F.lit(False)), "matched_key": F.col("best judged.key"),
              "action": F.col("best judged.action"), "since": F.col("best judged.since")}
    return joined.select(*[joined[c] for c in captures.columns if c not in judged], *[value.alias(name) for name, value in judged.items()])
