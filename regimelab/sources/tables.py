"""Readers and writers: price files, the trade tables, Parquet and CSV results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..operators.quality import DataQualityError, findings, require_clean, schema_findings
from .kept import kept

MARKET = "ALL"
FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def stem(ticker: str) -> str:
    """The file name of a ticker, without its ending."""
    return ticker.replace("^", "").replace("-", "_")


def tickers(extended: bool = True) -> tuple[str, ...]:
    return (*CONFIG.core, *CONFIG.sectors, *(CONFIG.extension if extended else ()))


def read_prices(spark: SparkSession, folder: str, dedupe: bool = True, strict: bool = True) -> DataFrame:
    """ticker, date and six numbers from one CSV a ticker.

    A file's first column is the date; the others go by their names, in any order. A file without one of the six names
    is an error, or with strict=False has nulls there. Rows without a date (stray header lines) go, what is no number is
    null, and of a date's rows the first stays. A file's name is its ticker, or the configured ticker that it stands for.
    """
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()]  # a file a ticker
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(files):
        layouts.setdefault(tuple(spark.read.option("header", True).csv(path).columns), []).append(path)
    gone = {p.rsplit("/", 1)[-1]: lost for columns, paths in layouts.items() for p in paths if (lost := schema_findings(list(columns[1:])))}
    if strict and gone:
        raise DataQualityError("; ".join(f"{name}: no column {', '.join(lost)}" for name, lost in sorted(gone.items())))
    known = F.create_map(*[F.lit(x) for t in tickers() for x in (stem(t), t)])
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    out = None
    for columns, paths in layouts.items():  # one read a layout, not one a file
        places = [f"c{i}" for i in range(len(columns))]
        raw = spark.read.option("header", True).option("enforceSchema", True).schema(", ".join(f"{c} string" for c in places)).csv(paths)
        number = lambda c: F.expr(f"try_cast({places[columns.index(c)]} as double)") if c in columns[1:] else F.lit(None).cast("double")
        day = F.expr("try_cast(substring(c0, 1, 10) as date)").alias("date")
        rows = raw.select(F.coalesce(F.try_element_at(known, name), name).alias("ticker"), day, *[number(c).alias(f) for c, f in zip(CONFIG.columns, FIELDS)], place.alias("at")).where("date is not null")
        out = rows if out is None else out.unionByName(rows)
    return first_of_each(out, ["ticker", "date"], "at").drop("at") if dedupe else out.drop("at")


def checked_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of a folder, after a stop at any hard finding."""
    require_clean(findings(read_prices(spark, folder, dedupe=False), "adj_close"))
    return read_prices(spark, folder)


def first_of_each(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def lines(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Line items as trades of the whole market."""
    held = spark.read.parquet(f"{folder}/lineitem.parquet")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).alias("px")
    return held.select(F.lit(MARKET).alias("ticker"), F.to_date("l_shipdate").alias("date"), price, "l_orderkey", "l_linenumber", "l_quantity", *more)


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trades: each part type is a ticker."""
    parts = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return lines(spark, folder, "l_partkey").join(parts, "l_partkey").withColumn("ticker", F.col("p_type")).drop("l_partkey", "p_type")


def daily(trades: DataFrame) -> DataFrame:
    """ticker, date, open, high, low, close, volume of each day with trades.

    Partial aggregates, of numbers only, meet before the shuffle, so a hot ticker costs a row a day and task and nothing
    is sorted. They say which order comes first and last; its few trades, found by a second look, give open and close.
    """
    days = trades.groupBy("ticker", "date").agg(
        F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").alias("volume"), F.min("l_orderkey").alias("_first"), F.max("l_orderkey").alias("_last")
    )
    ends = days.select("ticker", "date", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("l_orderkey"))  # two rows a day and ticker
    order = F.struct("l_orderkey", "l_linenumber", "px")
    edges = trades.join(ends, ["ticker", "date", "l_orderkey"]).groupBy("ticker", "date").agg(F.min_by("px", order).alias("open"), F.max_by("px", order).alias("close"))
    return days.join(edges, ["ticker", "date"]).select("ticker", "date", "open", "high", "low", "close", "volume")


def _sources(folder: str) -> list[str]:
    return [f"{folder}/lineitem.parquet", f"{folder}/part.parquet"]


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of every part type, and of the whole market as MARKET; kept as a table."""
    return kept(spark, "bars", _sources(folder), lambda: daily(trades(spark, folder)).unionByName(market(spark, folder).drop("pos")))


def market(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of the whole market, numbered; kept as a table. No other table is read for them."""
    return numbered(kept(spark, "market", _sources(folder)[:1], lambda: daily(lines(spark, folder))))


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def wide(df: DataFrame, names: list[str], value: str) -> DataFrame:
    """A date by ticker panel of one field."""
    return df.groupBy("date").pivot("ticker", names).agg(F.first(value))
