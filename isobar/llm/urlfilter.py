"""URL filters: a temporal list join.

A list entry is dated: from ``listed_at`` on, its pattern has its action (``block``, or ``allow`` for taken
off). A pattern is a host, which covers its subdomains too, or a host with a path prefix that ends at a
slash (``a.org/``, ``a.org/x/``, ``a.org/x/y/``), of any depth. The host's case and a leading ``www.`` do not matter, the path's case
does; a path that does not end at a slash covers nothing. The entries of one pattern, in order of date, become validity intervals
[listed_at, next listed_at); an entry at the same date as another of its pattern counts as the later one if its
action sorts last, so ``block`` wins.

A capture (url, fetched_at) is held against the entries active when it was fetched. Captures are first
reduced to their distinct keys (host and path, as deep as the deepest pattern), which a partial aggregation does before any
shuffle; each key is expanded to the patterns that can cover it, joined to the patterns' histories (block intervals in order, an array for each pattern, whose size follows the list and not
the captures) by equality of the pattern, and gathers the histories of these few patterns in one row. Each capture then meets one row, its key's, and looks up its fetch time in each history by halving: a
key that holds a third of all captures only makes a join partition of one right row, which adaptive
execution splits. No row count grows by the joins.

Defined results: a null URL, or one without a host, is not blocked; a null fetch time is not blocked; scheme,
user, port, a leading ``www.``, a dot at the end and letter case of the host do not matter (an address in numbers has no subdomains), nor do query and fragment; repeated captures
give repeated rows; without entries nothing is blocked. Entries with a null pattern or date are ignored. The pattern returned is the normal one.
Other columns of the captures are kept; host, blocked, pattern and since are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?([^/?#:@]+)"
_WHOLE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_FOLDER = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/(?:[^?#]*/)?)"


def url_host(url: Column) -> Column:
    """Lower-cased host without ``www.`` and without a dot at its end; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def _match_host(url: Column) -> Column:
    """url_host, but with its ``www.`` where no other dot is left (``www.com``)."""
    host = url_host(url)
    return F.when(host.contains("."), host).otherwise(F.lower(F.regexp_extract(url, _WHOLE, 1)))


def url_folder(url: Column) -> Column:
    """Path up to its last slash; one slash without a path."""
    path = F.regexp_extract(url, _FOLDER, 1)
    return F.when(path != "", path).otherwise("/")


def normal_pattern(pattern: Column) -> Column:
    """pattern with its host in lower case and without ``www.`` (unless no other dot is left); the path is kept."""
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, "^[^/]*", 0)), r"\.+$", "")
    return F.concat(F.regexp_replace(host, r"^www\.(?=.*\.)", ""), F.regexp_extract(pattern, "(?s)^[^/]*(.*)$", 1))


def _prefixes(folder: Column, depth: Column) -> Column:
    """Of a path that ends at a slash, the prefixes that do, up to depth slashes."""
    parts = F.split(folder, "/")
    upto = F.least(depth, F.size(parts) - 1)
    return F.when(upto > 0, F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until of each time a pattern is blocked; until is null while it still is."""
    e = entries.filter(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull())
    e = e.groupBy(normal_pattern(F.col("pattern")).alias("pattern"), F.col("listed_at").alias("since")).agg(F.max("action").alias("action"))
    nxt = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return e.withColumn("until", nxt).filter("action = 'block'").select("pattern", "since", "until")


def _covering(host: Column, folder: Column) -> Column:
    """All patterns that could cover the key: its host's suffixes at label bounds (of an address in numbers only the whole), alone and with each prefix of the folder."""
    parts = F.when(host.rlike(r"^[0-9.]+$"), F.array(host)).otherwise(F.split(host, r"\."))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    paths = F.concat(F.array(F.lit("")), _prefixes(folder, F.size(F.split(folder, "/"))))
    return F.flatten(F.transform(tails, lambda t: F.transform(paths, lambda p: F.concat(t, p))))


def _last(times: Column, at: Column) -> Column:
    """The last of a pattern's intervals, which follow each other, that begins at or before a time, by halving: as many steps as the number of intervals has bits."""
    n = F.size(times)
    steps = F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    place = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & (F.try_element_at(times, p + s).since <= at), p + s).otherwise(p))
    return F.when(place > 0, F.try_element_at(times, F.greatest(place, F.lit(1))))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """captures with host, blocked, and the pattern and since of the longest (then first) active entry."""
    blocked = intervals(entries)
    depth = blocked.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("depth"))
    captures = captures.drop("host", "blocked", "pattern", "since")
    own = free_names(captures, ("depth", "host", "folder", "h", "f", "spans", "hit"))
    host, folder = F.col(own["host"]), F.col(own["folder"])
    c = captures.withColumn("host", url_host(F.col(url))).crossJoin(F.broadcast(depth.withColumnRenamed("depth", own["depth"])))
    c = c.withColumn(own["host"], F.when(F.col("host").isNotNull(), _match_host(F.col(url)))).withColumn(own["folder"], F.coalesce(F.try_element_at(_prefixes(url_folder(F.col(url)), F.col(own["depth"])), F.lit(-1)), F.lit(""))).drop(own["depth"])
    keys = c.filter("host IS NOT NULL").groupBy(host.alias("h"), folder.alias("f")).agg(F.lit(1).alias("one")).select("h", "f")
    history = blocked.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("times"))
    hits = keys.withColumn("p", F.explode(_covering(F.col("h"), F.col("f")))).join(history, F.col("p") == F.col("pattern"))
    spans = hits.groupBy(F.col("h").alias(own["h"]), F.col("f").alias(own["f"])).agg(F.sort_array(F.collect_list(F.struct((-F.length("pattern")).alias("o"), "pattern", "times"))).alias(own["spans"]))
    at = F.col(fetched_at)
    j = c.join(spans, (host == F.col(own["h"])) & (folder == F.col(own["f"])), "left")
    found = F.transform(own["spans"], lambda x: F.struct(x.pattern.alias("pattern"), _last(x.times, at).alias("time")))
    live = F.filter(found, lambda x: x.time.isNotNull() & (x.time.until.isNull() | (at < x.time.until)))
    j = j.withColumn(own["hit"], F.when(F.size(live) > 0, F.struct(live[0].pattern.alias("pattern"), live[0].time.since.alias("since"))))
    return j.withColumns({"blocked": F.col(own["hit"]).isNotNull(), "pattern": F.col(f"{own['hit']}.pattern"), "since": F.col(f"{own['hit']}.since")}).drop(*[n for k, n in own.items() if k != "depth"])
