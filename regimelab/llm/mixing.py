"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate. A document's number of copies is the Poisson quantile of its own hash at that
rate, so it depends on nothing but its id, the seed and the rate; copies are then dealt out in a global random order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import column_name, placed

MOST_BROADCAST = 50_000  # sources; a row is some 60 bytes
SALTS = 64


def poisson_quantile(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The least k with P(X <= k) > u, for X Poisson of mean rate.

    Of each distinct rate, chances are taken relative to the most likely count, over all counts within twelve standard
    deviations and 60 more, so that no rate is too large; what lies outside is less than a double can tell.
    """
    out = np.zeros(len(u), np.int64)
    for r in np.unique(rate[rate > 0]):
        mode, reach = int(r), int(12 * np.sqrt(r)) + 60
        low = max(0, mode - reach)
        k = np.arange(low, mode + reach + 1)
        steps = np.concatenate([[0.0], np.cumsum(np.log(r / k[1:]))])
        chance = np.exp(steps - steps[mode - low])
        total = chance.sum()
        below, above = np.cumsum(chance) / total, np.append(np.cumsum(chance[:0:-1])[::-1], 0.0) / total  # P(X <= k), P(X > k)
        mine = np.flatnonzero(rate == r)
        x = u[mine]
        out[mine] = low + np.where(x < 0.5, np.searchsorted(below, x, "right"), np.searchsorted(-above, x - 1, "right"))
    return out


def _copies():
    @pandas_udf("long")
    def copies(u: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series(poisson_quantile(u.to_numpy(np.float64), rate.to_numpy(np.float64)))

    # Its values are fixed; but a filter on a deterministic column is put below it with a copy of the function, and each
    # copy takes a Python worker of its own for every running task, which then stays for the stages that follow.
    return copies.asNondeterministic()


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source and rate, the mean number of copies of each of its documents.

    The target is `epochs` times the bytes of the corpus, shared out by `weights` (a source that is not named has none),
    or without weights in proportion to bytes ** alpha. A source of no bytes gets rate 1. Null is a source like another.
    """
    each = docs.groupBy(F.col(source_col).alias("source")).agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0)).cast("double").alias("bytes"))
    if weights is None:
        share = F.pow(F.col("bytes"), F.lit(alpha))
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        share = F.when(F.col("bytes") > 0, F.coalesce(F.try_element_at(known, F.col("source")).cast("double"), F.lit(0.0))).otherwise(0.0)
    each = each.withColumn("share", share)
    total = each.agg(F.sum("share").alias("shares"), F.sum("bytes").alias("all_bytes"))
    rate = F.when((F.col("bytes") <= 0) | (F.col("shares") <= 0), F.lit(1.0)).otherwise(F.col("share") / F.nullif(F.col("shares"), F.lit(0.0)) * F.col("all_bytes") * F.lit(float(epochs)) / F.nullif(F.col("bytes"), F.lit(0.0)))
    return each.join(F.broadcast(total)).select("source", rate.alias("rate"))  # total is one row


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", extras: bool = False) -> DataFrame:
    """The columns of docs, each row as often as its Poisson count says, in a global random order.

    With extras come `n_copies` (of this document), `copy` (0, 1, ...) and `shuffle_key` (the order within a partition,
    which a hash of the key and of the row's place in the input chose, so that rows of one id spread); names that docs
    has already get underscores in front.

    A null id counts as the text "null"; rows of one id have one count; a null text has no bytes; a null source is a
    source like another. Of an empty table nothing comes back.
    """
    rate, count, copy, key, salt, place = (column_name(docs, c) for c in ("rate", "n_copies", "copy", "shuffle_key", "salt", "place"))
    columns, docs = docs.columns, placed(docs, place)
    spark = docs.sparkSession
    table = rates(docs, weights, alpha, epochs, source_col, text_col)
    # The table of rates has a row for each source; it is gathered with one row more than may be broadcast at most.
    held = table.limit(MOST_BROADCAST + 1).collect()
    name = F.coalesce(F.col(source_col), F.lit(""))
    known = F.concat(F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.lit("+")), name)
    join_col = column_name(docs, "source_key")
    if len(held) <= MOST_BROADCAST:
        # From Arrow, as a list of rows would go through Python workers and a second daemon on each executor.
        keys = [("-" if r.source is None else "+") + (r.source or "") for r in held]
        local = spark.createDataFrame(pa.table({join_col: pa.array(keys, pa.string()), rate: pa.array([r.rate for r in held], pa.float64())}))
        rated = docs.withColumn(join_col, known).join(F.broadcast(local), join_col, "left").drop(join_col)
    else:  # too many sources: an equi-join, where the rows of a hot source go to SALTS tasks
        side = table.select(F.concat(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce("source", F.lit(""))).alias(join_col), F.col("rate").alias(rate), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        rated = docs.withColumns({join_col: known, salt: F.pmod(F.xxhash64(id_col, place), F.lit(SALTS)).cast("int")}).join(side, [join_col, salt], "left").drop(join_col, salt)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    u = _hash52(F.concat(F.lit(f"{seed}:count:"), ident)) / F.lit(float(1 << 52))
    rated = rated.withColumn(count, _copies()(u, F.coalesce(F.col(rate), F.lit(1.0)))).where(F.col(count) > 0)
    copies = rated.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)))
    copies = copies.withColumn(key, _hash52(F.concat(F.lit(f"{seed}:order:"), ident, F.lit(":"), F.col(copy).cast("string"))))
    shuffled = copies.repartition(F.col(key), F.col(place)).sortWithinPartitions(key, copy)
    return shuffled.select(*[F.col(f"`{c}`") for c in columns], *([F.col(count), F.col(copy), F.col(key)] if extras else []))


def _hash52(text):
    """52 bits of a text's MD5, which a double holds exactly and any SQL engine can compute."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
