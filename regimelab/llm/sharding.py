"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and growth moves only what must move.

The rest of a shard's layout is relational: rows get gapless slots in their shard from counts of small hash buckets, so
no task ever holds a whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import U64, mix, parts, written

NULL_KEY = 0x5EED
RUN = 4096


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket 0 to buckets - 1 of each unsigned 64-bit key.

    Each key walks forward through the bucket numbers at which it would move as buckets are added one by one; the last
    stop below `buckets` is its bucket. So with one more bucket a key stays or goes to the new one.
    """
    state = keys.astype(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    moving, at = np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(moving):
        out[moving] = at
        state[moving] = state[moving] * U64(2862933555777941757) + U64(1)
        draw = ((state[moving] >> U64(33)) + U64(1)).astype(np.float64)
        at = ((at + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        stay = at < buckets
        moving, at = moving[stay], at[stay]
    return out


def _shards(buckets: int):
    @pandas_udf("shard int, grown_shard int")
    def shard_of(key: pd.Series) -> pd.DataFrame:
        keys = mix(key.fillna(NULL_KEY).astype("int64").to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": jump_hash(keys, buckets).astype(np.int32), "grown_shard": jump_hash(keys, buckets + 1).astype(np.int32)})

    return shard_of


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its shard by the law `key`: the id and the number of shards decide, nothing else.

    Columns: id_col, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard (the shard with
    one shard more, which is the same or the new one). Slots of a shard run from 0 without gaps, in order of a hash
    bucket, then id, checksum and size.

    A null text has 0 bytes and checksum 0. A null id counts as one fixed key. Repeated rows stay, each with a slot of
    its own. Of an empty table nothing comes back. Other columns are ignored, whatever their names.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    # Equal rows meet as a count, before anything is dealt out by shard: a key that holds a third of the rows is one row.
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    buckets = parts(docs.count(), n_shards * 200_000, 8)
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket")
    # Texts are read once: what is left of them is some 40 bytes a row, which is written and read twice.
    rows = written(rows.select("*", _shards(n_shards)("doc_id").alias("to"), bucket).select("doc_id", "size", "text_crc32", "n", "to.shard", "to.grown_shard", "bucket"), "shards")
    held = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, ["shard", "bucket"])
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    each = F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("n")) - 1)).alias("i")
    return runs.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "base", "first", each).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("first") + F.col("i")).alias("slot"), "grown_shard"
    )
