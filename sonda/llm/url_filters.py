"""URL filters by a temporal list join, in DataFrame operations only.

A list has dated entries: a domain is added or removed on a day. Entries become validity intervals, held as one row
for each domain, and every capture is joined as of its fetch time: of each domain on the list that its host stands
under, the interval is looked up that holds at the time. No interval is paired with a capture it doesn't hold for.

Captures are first brought down to their distinct (host, day) pairs, so a host with a third of all captures is
evaluated once a day, and only that small table is joined. What is broadcast, the list or the judged pairs, is
counted before and has at most ``BROADCAST_ROWS`` rows; larger ones are joined by shuffle, where a domain or a pair
that many rows have is dealt over ``SALTS`` tasks.

Null or malformed URLs have a null host; null fetch times match nothing; both are kept and not blocked. The host of
a literal address keeps its brackets. Null domains, days or actions in the list are ignored; of entries of a domain on
the same day a removal counts last. Repeated captures and entries change nothing for others. An empty list blocks
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS, SALTS = 100_000, 32


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port or a dot at the end; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def intervals(entries: DataFrame, domain: str = "domain", action: str = "action", day: str = "day") -> DataFrame:
    """(domain, since, until): when a domain is listed, from its first addition on until it is removed (null: still listed)."""
    e = entries.select(F.lower(F.col(f"`{domain}`")).alias("domain"), F.lower(F.col(f"`{action}`")).alias("action"), F.col(f"`{day}`").cast("date").alias("day"))
    e = e.where("domain is not null and day is not null and action in ('add', 'remove')")
    # the last word of each day, then only the changes
    e = e.groupBy("domain", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("domain").orderBy("day")
    e = e.withColumn("before", F.lag("action").over(w)).where("action <> coalesce(before, 'remove')")
    return e.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("domain", F.col("day").alias("since"), "until")


def _joined(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], spread: Column, rows: int, how: str) -> DataFrame:
    """``left`` with the one row of ``right`` (of ``rows`` rows) that has its keys: by broadcast, or by a salted shuffle."""
    on = None
    if rows > BROADCAST_ROWS:
        left = left.withColumn("__salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
        right = right.withColumn("__salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = F.col("__salt") == F.col("__salt_")
    for a, b in zip(left_keys, right_keys):
        same = F.col(a) == F.col(b)
        on = same if on is None else on & same
    out = left.join(right if rows > BROADCAST_ROWS else F.broadcast(right), on, how)
    return out.drop("__salt", "__salt_")


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on", **names: str) -> DataFrame:
    """``captures`` with host, n_active (listed domains of its host at fetch time), entry (the longest), active_since and blocked.

    Columns of ``captures`` that bear one of these names are replaced.
    """
    # a domain has fewer intervals than the list has days
    spans = intervals(entries, **names).groupBy("domain").agg(F.collect_list(F.struct("since", "until")).alias("spans"))
    spans = spans.withColumnRenamed("domain", "listed")
    at = captures.withColumn("__sonda_host", host(F.col(f"`{url}`"))).withColumn("__sonda_day", F.col(f"`{fetched}`").cast("date"))
    pairs = at.select(F.col("__sonda_host").alias("h"), F.col("__sonda_day").alias("d")).where("h is not null and d is not null").distinct()
    parts = F.split("h", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = pairs.select("h", "d", F.explode(above).alias("domain"))
    n_spans = spans.select(F.explode("spans")).limit(BROADCAST_ROWS + 1).count()
    known = _joined(keys, spans, ["domain"], ["listed"], F.xxhash64("h", "d"), n_spans, "inner")
    held = F.get(F.filter("spans", lambda s: (s["since"] <= F.col("d")) & (s["until"].isNull() | (F.col("d") < s["until"]))), 0)
    active = known.select("h", "d", "domain", held["since"].alias("since")).where("since is not null")
    best = active.groupBy("h", "d").agg(F.count("*").alias("n"), F.max_by(F.struct("domain", "since"), F.struct(F.length("domain"), F.col("domain"))).alias("e"))
    n_best = best.limit(BROADCAST_ROWS + 1).count()
    got = _joined(at, best, ["__sonda_host", "__sonda_day"], ["h", "d"], F.monotonically_increasing_id(), n_best, "left")
    new = {"host": F.col("__sonda_host"), "n_active": F.coalesce("n", F.lit(0)), "entry": F.col("e.domain"), "active_since": F.col("e.since"), "blocked": F.col("n").isNotNull()}
    return got.select(*(F.col(f"`{c}`") for c in captures.columns if c not in new), *(v.alias(k) for k, v in new.items()))
