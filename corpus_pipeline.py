"""A corpus from raw documents: good, near-unique, without repeated passages, mixed and packed.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of docs, whatever they are
called. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import mixing, packing, quality, scratch, shingles, substrings

#: Near copies share that much of their runs of so many words; op10_prefix_tree_join has values of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


#: Bytes of rows that Spark hands to Python at once (its own bound is 10,000 rows, which are 25 MB of texts and more outside the heap).
BATCH_BYTES = 4 << 20


def _begin(spark: SparkSession) -> None:
    """The stage before is written: what it was computed from can go."""
    scratch.clear(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows are judged by their texts alone: rows with null ids, null or empty texts (without
    words) and repeated rows each by themselves. Without labelled rows all stay.
    """
    _begin(spark)
    model, _ = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of its least id; rows that share an id are judged each by its text.

    Rows with null ids stay, as do those without words, which are nobody's copies.
    """
    _begin(spark)
    key, name = (substrings.unused(docs.columns, x) for x in ("key", "gone_key"))
    keyed = substrings.with_keys(docs, key)
    links = shingles.link(keyed.select(F.col(key).alias("doc_id"), "text"), NEAR_PERCENT, NEAR_WORDS)
    gone = scratch.save(links.where("doc_id <> component_id").select(F.col("doc_id").alias(name)), "gone")
    scratch.release(spark)
    return substrings.without_keys(keyed, key, gone).drop(key)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 words and more that start earlier in the corpus.

    Of equal rows the first keeps its text. Null texts and rows with null ids stay as they are.
    """
    _begin(spark)
    return substrings.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words (null texts among them) are taken 0 times; null sources are one
    source; rows that share id, source and size get their copies between them.
    """
    _begin(spark)
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in sequences.

    Null texts are empty documents; null ids are kept; repeated rows are documents of their own.
    """
    _begin(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next one starts."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs, path = scratch.keep(stage(spark, docs, sf_dir), "stage")
        written.append(path)
    scratch.clear(spark)
    scratch.forget_later(*written)
    return docs


#: The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None
