"""URL filters as a temporal join with dated lists.

List entries are events: at a time, an entry is added to a list or removed from it.  Each
addition holds until the next event of the same entry, which makes validity intervals.  A
capture asks for the entries that cover its URL and were valid when it was fetched: its host,
each parent domain and each leading part of its path are candidate keys (no more labels and
folders than the longest entry has), joined with the intervals on key and month and narrowed by
time.  An interval has a row for each month in which a capture asks for its key, so neither its
length nor the span of fetch times counts, be they seconds, milliseconds or nonsense.  The most
specific valid entry decides.

Everything is DataFrame expressions.  Captures of a hot host spread by month and are left to
the skew handling of joins; the successor of an event is sought within its month first, and
across months only among the first events of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

BUCKET = 30 * 86400
_OPEN = 1 << 62
#: Copies of a capture that are written out at a time.
_RUN = 10_000
_KEY = ("list", "kind", "value")
_RANK = {"domain": 1, "host": 2, "path": 3}


def host_of(url: Column) -> Column:
    """The host of an absolute URL, lowered, without user, port and final dot; '' if there is none."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def events_of(entries: DataFrame) -> DataFrame:
    """list, kind, value, listed_at, event and action: one event for each entry and time, as a written table.

    Of several events of an entry at one time a removal wins, else an addition that blocks.
    Rows with a null in kind, value, event or listed_at are no events; a null list is a list
    like others, a null action blocks.
    """
    named = entries.select(F.coalesce(F.col("list"), F.lit("")).alias("list"), "kind", F.lower("value").alias("value"), F.coalesce("action", F.lit("block")).alias("action"), "event", F.col("listed_at").cast("long").alias("listed_at")).dropna(subset=["kind", "value", "event", "listed_at"])
    return written(named.groupBy(*_KEY, "listed_at").agg(F.max("event").alias("event"), F.max("action").alias("action")), "entries")


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, value, action, valid_from, valid_to (null: open) of each addition among events_of()."""
    once = events.withColumn("month", F.floor(F.col("listed_at") / BUCKET))
    firsts = once.groupBy(*_KEY, "month").agg(F.min("listed_at").alias("first"))
    later = firsts.select(*_KEY, "month", F.lead("first").over(Window.partitionBy(*_KEY).orderBy("month")).alias("later"))
    own = F.lead("listed_at").over(Window.partitionBy(*_KEY, "month").orderBy("listed_at"))
    dated = once.withColumn("own", own).join(later, [*_KEY, "month"])
    return dated.where(F.col("event") == "add").select(*_KEY, "action", F.col("listed_at").alias("valid_from"), F.coalesce("own", "later").alias("valid_to"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched_at, n_active, verdict, entry_kind, entry_value, valid_from.

    captures: page_id, url, fetched_at in seconds; a row comes out for each.  entries: list,
    kind (domain, host, path), value, action (block, allow), event (add, remove), listed_at
    (seconds); other columns of both are not read.  n_active: entries that
    cover the URL and were valid then (valid_from <= fetched_at < valid_to).  verdict: the
    action of the most specific of them (path over host over domain, then the longer value,
    then block, then the list's name), else ``none``.  A null or relative URL has no
    candidates, a null time no active entry, negative and far-off times are times like others; numeric hosts and IPv6 addresses are hosts
    without parent domains.  Repeated captures each have their row, an empty table gives none.
    """
    events = events_of(entries)
    valid = intervals(events)
    depth, deepest = (events.agg(F.max(F.when(F.col("kind") == "path", F.size(F.split("value", "/")))), F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\."))))).first())  # two numbers

    url = F.col("url").cast("string")
    source = captures.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("fetched_at").cast("long").alias("fetched_at"), host_of(url).alias("host"), path_of(url).alias("path"))
    source = source.groupBy("page_id", "url", "fetched_at", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    labels = F.split("host", r"\.")
    known = F.col("host") != ""
    numeric = F.col("host").rlike(r"^([0-9.]+|\[.*)$")
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value")))
    domains = F.when(numeric, F.array()).otherwise(F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) + 1 - (deepest or 1)), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"))))
    segments = F.slice(_segments(F.lower("path")), 1, depth or 1)
    paths = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.struct(F.lit("path").alias("kind"), F.concat_ws("/", F.col("host"), F.slice(segments, F.lit(1), i)).alias("value")))).otherwise(F.array())
    keys = F.when(known, F.concat(own, domains, paths)).otherwise(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value"))))
    asked = source.select("page_id", "url", "host", "fetched_at", "copies", F.explode(keys).alias("key")).select("page_id", "url", "host", "fetched_at", "copies", "key.kind", "key.value", F.floor(F.col("fetched_at") / BUCKET).alias("month"))
    # Intervals stand in those months alone in which their entry is asked for, however long they are.
    months = asked.where(F.col("month").isNotNull() & (F.col("kind") != "")).select("kind", "value", "month").distinct()
    until = F.coalesce(F.col("valid_to"), F.lit(_OPEN))
    dated = valid.where(until > F.col("valid_from")).join(months, ["kind", "value"]).where(F.col("month").between(F.floor(F.col("valid_from") / BUCKET), F.floor((until - 1) / BUCKET)))
    held = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    a, d = asked.alias("a"), dated.alias("d")
    met = a.join(d, (F.col("a.kind") == F.col("d.kind")) & (F.col("a.value") == F.col("d.value")) & (F.col("a.month") == F.col("d.month")) & held, "left")
    rank = F.coalesce(*(F.when(F.col("d.kind") == k, n) for k, n in _RANK.items()), F.lit(0))
    best = F.struct(rank.alias("rank"), F.length("d.value").alias("size"), F.col("d.action").alias("action"), F.col("d.list").alias("list"), F.col("d.kind").alias("kind"), F.col("d.value").alias("value"), F.col("d.valid_from").alias("since"))
    key = ("page_id", "url", "host", "fetched_at", "copies")
    each = met.groupBy(*(F.col(f"a.{c}").alias(c) for c in key)).agg(F.count("d.kind").alias("n_active"), F.max(F.when(F.col("d.kind").isNotNull(), best)).alias("best"))
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _RUN))
    rest = F.least(F.lit(_RUN), F.col("copies") - F.col("run") * _RUN)
    repeated = each.withColumn("run", F.explode(runs)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), rest)))
    return repeated.select("page_id", "url", "host", "fetched_at", "n_active", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.kind").alias("entry_kind"), F.col("best.value").alias("entry_value"), F.col("best.since").alias("valid_from"))


def _number(text: Column) -> Column:
    """A number from 0 to 2**32 - 1 that any engine with MD5 computes alike."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: 2024-01-01, the first day of the synthetic captures and entries.
DAY_ZERO = 1704067200
_DAY = 86400


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures for pages that come without a fetch time: a day of the year 2024 by page_id."""
    return pages.select("page_id", "url", (DAY_ZERO + F.pmod(F.col("page_id") * 7919, F.lit(365)) * _DAY + F.pmod("page_id", F.lit(_DAY))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, by a fixed rule of hashes.

    Hosts are blocked and partly freed and blocked again, some are allowed, some have one
    folder blocked; whole domains are blocked for a time.
    """
    labels = F.split("value", r"\.")
    parent = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")
    hosts = pages.select(host_of(F.col("url")).alias("value")).where("value != ''").distinct()
    both = F.array(F.struct(F.lit(False).alias("whole"), F.col("value").alias("value")), F.struct(F.lit(True).alias("whole"), parent.alias("value")))
    k, own = F.col("k"), ~F.col("whole")
    named = hosts.select(F.explode(both).alias("n")).select("n.*").distinct().withColumn("k", _number(F.col("value")))

    def event(test: Column, name: str, kind: str, action: str, what: str, day: Column, value: Column | None = None) -> Column:
        fields = {"list": F.lit(name), "kind": F.lit(kind), "value": F.col("value") if value is None else value, "action": F.lit(action), "event": F.lit(what), "listed_at": DAY_ZERO + day * _DAY}
        return F.when(test, F.struct(*(c.alias(f) for f, c in fields.items())))

    events = F.array(
        event(own & (k % 3 == 0), "hosts", "host", "block", "add", k % 200),
        event(own & (k % 6 == 0), "hosts", "host", "block", "remove", k % 200 + 40),
        event(own & (k % 30 == 0), "hosts", "host", "block", "add", k % 200 + 90),
        event(own & (k % 7 == 2), "exceptions", "host", "allow", "add", k % 300),
        event(own & (k % 4 == 1), "folders", "path", "block", "add", k % 100, F.concat("value", F.lit("/en"))),
        event(~own & (k % 2 == 0), "domains", "domain", "block", "add", k % 150),
        event(~own & (k % 2 == 0), "domains", "domain", "block", "remove", k % 150 + 60),
    )
    return named.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*")
