"""URL filters over time: dated list entries become validity intervals, and each capture meets those active when it was fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_name

MOST_BROADCAST = 32 << 20  # bytes of patterns, and ROW_BYTES a row, that are broadcast; more go through a salted join
ROW_BYTES = 64
SALTS = 32
HOST = r"^(?i)[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[^:]+://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from, valid_to (null: open) from dated entries (pattern, action `add` or `remove`, effective_at).

    An entry holds until the next one of its pattern; of entries at one time the removal wins. Adds that follow each
    other make one interval. Entries with a null pattern or time, or another action, are left out.
    """
    known = entries.where(F.col("pattern").isNotNull() & F.col("effective_at").isNotNull() & F.col("action").isin("add", "remove"))
    one = known.groupBy(F.lower("pattern").alias("pattern"), "effective_at").agg(F.min((F.col("action") == "add").cast("int")).alias("listed"))
    order = Window.partitionBy("pattern").orderBy("effective_at")
    turns = one.withColumn("was", F.coalesce(F.lag("listed").over(order), F.lit(0))).where("listed <> was")
    return turns.withColumn("valid_to", F.lead("effective_at").over(order)).where("listed = 1").select("pattern", F.col("effective_at").alias("valid_from"), "valid_to")


def host_of(url):
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys_of(url, most_labels: int, most_slashes: int):
    """The patterns of at most so many labels or slashes that can list a URL: its host and every parent domain of two labels or more, and the host with each leading part of its path that ends in a slash.

    The bounds come from the list, so a URL of any length has no more keys than the list has depths.
    """
    host, none = host_of(url), F.array().cast("array<string>")
    labels = F.split(host, r"\.")
    size = F.size(labels)
    shortest = F.least(size, F.lit(2))  # a host of one label is its own domain
    longest = F.least(size, F.lit(most_labels))
    suffixes = F.when(longest >= shortest, F.transform(F.sequence(shortest, longest), lambda n: F.array_join(F.slice(labels, size - n + 1, n), "."))).otherwise(none)
    steps = F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/", most_slashes + 1)  # "/a/b" gives "", "a", "b"
    deep = F.size(steps)
    folders = F.when(deep > 1, F.transform(F.sequence(F.lit(1), deep - 1), lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))).otherwise(none)
    return F.when(host != "", F.array_distinct(F.concat(suffixes, folders))).otherwise(none)


def judged(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with host, blocked, n_active (patterns in force at the fetch), first_pattern and listed_since (of the pattern that sorts first).

    Verdicts are made once for each distinct URL and time and joined back, so rows that repeat cost no more than one. A
    null URL, one without a host, or a null time is never blocked. Of no captures nothing comes back; without entries
    nothing is blocked. URLs and patterns may be of any length. Columns of those five names that captures brings stay as
    they are, and the new ones get underscores in front.
    """
    spans = intervals(entries)
    labels, slashes = F.size(F.split(F.split("pattern", "/")[0], r"\.")), F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))
    held = spans.agg(
        F.coalesce(F.sum(F.octet_length("pattern") + ROW_BYTES), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(F.when(slashes == 0, labels)), F.lit(0)).alias("labels"),
        F.coalesce(F.max(slashes), F.lit(0)).alias("slashes"),
    ).first()  # one row, which says how the list is met and never what it lists
    u, t = F.col(f"`{url_col}`"), F.col(f"`{time_col}`")
    visits = captures.where(u.isNotNull() & t.isNotNull()).select(u.alias("v_url"), t.alias("v_at")).distinct()
    keyed = visits.select("v_url", "v_at", F.explode(keys_of(F.col("v_url"), held.labels, held.slashes)).alias("pattern"))
    during = (F.col("v_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("v_at") < F.col("valid_to")))
    if held.bytes <= MOST_BROADCAST:
        met = keyed.join(F.broadcast(spans), "pattern")
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("v_url", "v_at"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"])
    verdicts = met.where(during).groupBy("v_url", "v_at").agg(F.count(F.lit(1)).cast("int").alias("n_active"), F.min(F.struct("pattern", "valid_from")).alias("first"))
    host, blocked, n_active, first_pattern, listed_since = (column_name(captures, c) for c in ("host", "blocked", "n_active", "first_pattern", "listed_since"))
    joined = captures.alias("c").join(verdicts.alias("v"), (F.col(f"c.`{url_col}`") == F.col("v.v_url")) & (F.col(f"c.`{time_col}`") == F.col("v.v_at")), "left")
    return joined.select(
        *[F.col(f"c.`{c}`") for c in captures.columns],
        F.nullif(host_of(F.col(f"c.`{url_col}`")), F.lit("")).alias(host),
        F.col("v.n_active").isNotNull().alias(blocked),
        F.coalesce("v.n_active", F.lit(0)).alias(n_active),
        F.col("v.first.pattern").alias(first_pattern),
        F.col("v.first.valid_from").alias(listed_since),
    )
