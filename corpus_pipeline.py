"""A corpus pipeline of five operators: language ID, n-gram Jaccard join, substring dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows before the next reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimelab.llm import langid, mixing, ngram_join, packing, registry, substring_dedup
from regimelab.llm.common import column_name, written

LEAST_SCORE = 0.15  # texts of a few letters that no language claims


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that no language learned from these documents claims with LEAST_SCORE.

    A null or empty text has no letter, so it goes. Rows that repeat are judged alike. Where no row has a language,
    nothing is learned and all go; of an empty table nothing comes back. Columns of any name stay as they are.
    """
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~registry.held_out()))
    lang, score = column_name(docs, "lang_pred"), column_name(docs, "score")
    return langid.identified(docs, model).where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id.

    Of rows that share an id and a text one stays, as of any copies. Rows that share an id and have other texts are
    documents of their own, and stay where their id is the least of a group. A text without words (null, empty) is in no
    group, and a row without an id is compared with nothing: both stay. Columns of any name stay as they are.
    """
    ident, times = column_name(docs, "kept_id"), column_name(docs, "kept_times")
    kept = ngram_join.joined(docs, 0.8, 5).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(ident)).agg(F.count(F.lit(1)).alias(times))
    met = docs.join(kept, F.col("doc_id") == F.col(ident)).drop(ident)
    once = met.where(F.col(times) == 1)
    again = met.where(F.col(times) > 1).dropDuplicates(["doc_id", "text"])  # only rows of ids that repeat
    return once.unionAll(again).drop(times).unionAll(docs.where(F.col("doc_id").isNull()))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of 13-word windows that a document of a smaller id holds; other texts stay as they are, white space and all.

    Where a text loses words, n_chars, if there is such a column, is counted anew. Null, empty and short texts and rows
    without an id stay as they are; rows that share an id cut nothing from each other. Columns of any name stay.
    """
    columns, kinds = docs.columns, dict(docs.dtypes)
    cut, text = column_name(docs, "n_removed"), column_name(docs, "kept_text")
    out = substring_dedup.deduplicated(docs, 13).withColumn("text", F.when(F.col(cut) > 0, F.col(text)).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col(cut) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kinds["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says: sources meet in proportion to bytes ** 0.7, as many bytes as before.

    A null source is a source like another; a source without a byte keeps each row once in the mean. Rows of one id have
    one count. Of an empty table nothing comes back. Columns of any name stay as they are.
    """
    return mixing.mixed(docs, alpha=0.7, epochs=1.0, seed=17)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece of a document, with its ids.

    A null or empty text is the closing id alone; copies that mixing made are packed each. Of an empty table nothing
    comes back. Only doc_id and text are read, whatever other columns there are.
    """
    return packing.packed(docs, registry.tokenizer_path(), 2048, 1, with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring),
    ("mixing to target weights", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"stage{at}")
    return docs


ORACLE_SQL = None  # a kernel classifier and a tokenizer have no SQL; tests/llm compares the stages with plain loops
