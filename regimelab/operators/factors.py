"""Features as factors: quantile buckets, their forward returns, and rank correlations by horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.win import average_rank
from .metrics import rank_ic


def buckets(long: DataFrame, n: int = 252, count: int = CONFIG.quantiles) -> DataFrame:
    """long (feature, ticker, pos, x) with bucket 1 to `count`: one more than the edges of the rows before that lie below x."""
    from pyspark.sql import Window

    frame = Window.partitionBy("feature", "ticker").orderBy("pos").rowsBetween(-n, -1)
    edges = F.percentile("x", F.array(*[F.lit(k / count) for k in range(1, count)])).over(frame)
    rows = long.withColumn("_e", F.when(F.count("x").over(frame) >= n, edges))
    return rows.withColumn("bucket", F.when(F.col("_e").isNotNull() & F.col("x").isNotNull(), F.size(F.filter("_e", lambda e: e < F.col("x"))) + 1)).drop("_e")


def bucket_table(bucketed: DataFrame, y: str = "y", count: int = CONFIG.quantiles) -> DataFrame:
    """feature, bucket, mean, n of every bucket, also of empty ones."""
    grid = bucketed.select("feature").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(count))))
    held = bucketed.where(F.col("bucket").isNotNull() & F.col(y).isNotNull()).groupBy("feature", "bucket").agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"))
    return grid.join(held, ["feature", "bucket"], "left").select("feature", "bucket", "mean", F.coalesce("n", F.lit(0)).alias("n"))


def monotonicity(table: DataFrame) -> DataFrame:
    """table with the rank correlation of bucket and mean of its feature."""
    known = table.where("mean is not null")
    ranks = known.select("feature", average_rank("bucket", "feature").alias("a"), average_rank("mean", "feature").alias("b"))
    return table.join(ranks.groupBy("feature").agg(F.corr("a", "b").alias("monotonicity")), "feature", "left")


def ic_decay(features: DataFrame, changes: DataFrame, names: list[str], horizons) -> DataFrame:
    """feature, h, n, ic, t of every feature against every horizon's change."""
    x = features.unpivot(["ticker", "pos"], names, "feature", "x")
    y = changes.unpivot(["ticker", "pos"], [f"change_h{h}" for h in horizons], "name", "y").withColumn("h", F.regexp_extract("name", r"(\d+)$", 1).cast("int")).drop("name")
    return rank_ic(x.join(y, ["ticker", "pos"]), ["feature", "h"])


def ic_summary(raw: DataFrame, orthogonal: DataFrame, h: int = 5) -> DataFrame:
    """feature, and rank correlation and t at one horizon, raw and of what the baseline leaves; the best of the latter first."""
    a = raw.where(F.col("h") == h).select("feature", F.col("ic").alias("ic_raw"), F.col("t").alias("t_raw"))
    b = orthogonal.where(F.col("h") == h).select("feature", F.col("ic").alias("ic_orthogonal"), F.col("t").alias("t_orthogonal"))
    return a.join(b, "feature", "left").orderBy(F.desc("ic_orthogonal"), "feature")
