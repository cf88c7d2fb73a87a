"""URL filter with dated lists (DataFrame functions only).

List entries come as dated events: from its date on, ``add`` puts a pattern on
a list and ``remove`` takes it off. ``validity`` turns the events into
intervals; ``evaluate`` finds for every capture the entries that were active
when it was fetched (an as-of join), for the host, each parent domain and each
leading part of the path.

Cases: a capture without URL, host or time matches nothing and stays in the
result; events without pattern, list or time are void; of several events of
one pattern on one day ``remove`` wins; repeated captures are evaluated one by
one, repeated events count once; empty tables give empty results or no
matches; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; NULL where there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.when(host != "", host)


def host_keys(host: Column) -> Column:
    """The host and its parent domains of at least two labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(
        F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(host))


def path_keys(url: Column, host: Column) -> Column:
    """``host/first`` , ``host/first/second``, ...: the leading parts of the path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))


def validity(events: DataFrame) -> DataFrame:
    """``list, pattern, valid_from, valid_to``: half-open intervals in which a pattern is on a list.

    ``events`` has ``list, pattern, action, since``. ``valid_to`` is NULL while the
    entry stands. Windows run per list and pattern, whose dated history is short.
    """
    days = (events.where(c("list").isNotNull() & c("pattern").isNotNull() & c("since").isNotNull())
            .groupBy("list", F.lower("pattern").alias("pattern"), "since")
            .agg(F.max(F.when(c("action") == "remove", 1).otherwise(0)).alias("gone")))
    line = Window.partitionBy("list", "pattern").orderBy("since")
    turns = days.withColumn("before", F.lag("gone").over(line)).where(
        "before IS NULL AND gone = 0 OR before <> gone")
    return turns.withColumn("valid_to", F.lead("since").over(line)).where("gone = 0").select(
        "list", "pattern", c("since").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """``id, host, n_active, lists, rule``: per capture the lists that hold it at its fetch time.

    ``rule`` is the longest active pattern (then the first by name). Equal
    (host and path, time) captures are evaluated once, so the join sees a hot
    host as its distinct pages; the keys carry no text. At one time a pattern
    is at most once on a list, so intervals of a key never multiply rows.
    """
    rows = captures.select(c(id_col).alias("id"), c(time_col).alias("fetched"), c(url_col).alias("url"))
    rows = rows.withColumn("host", host_of(c("url")))
    rows = rows.withColumn("page", F.regexp_extract("url", r"^[^?#]*", 0))
    pages = rows.where(c("host").isNotNull() & c("fetched").isNotNull()).select("page", "host", "fetched").distinct()
    keyed = pages.select("page", "fetched", F.explode(F.array_distinct(F.concat(
        host_keys(c("host")), F.transform(path_keys(c("page"), c("host")), lambda k: F.lower(k))))).alias("pattern"))
    hits = keyed.join(entries, "pattern").where(
        (c("valid_from") <= c("fetched")) & (c("valid_to").isNull() | (c("fetched") < c("valid_to"))))
    active = hits.groupBy("page", "fetched").agg(
        F.count(F.lit(1)).alias("n_active"), F.collect_set("list").alias("lists"),
        F.min(F.struct((-F.length("pattern")).alias("order"), "pattern"))["pattern"].alias("rule"))
    return (rows.join(active, ["page", "fetched"], "left")
            .select("id", "host", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
                    F.array_join(F.array_sort(F.coalesce("lists", F.array().cast("array<string>"))), ",").alias("lists"),
                    "rule"))
