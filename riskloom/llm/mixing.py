"""Mixing sources to target weights by systematic sampling, with Spark expressions only.

A document's size is its number of words. Within a source, documents are ordered by
size (then by doc_id modulo a number of shares, and doc_id), each expects target / source size copies, the
running sum of expected copies is shifted by the source's one random offset, and a
document is taken once for each integer that the sum crosses in it. As every document of
a source expects as many copies, the running sum is its rank times that number, and the
words taken differ from the target by no more than the longest document about.

Null texts have size 0; the null source comes last; rows with equal doc_id are documents
of their own; documents without words and sources of size 0 are taken 0 times, as their
words cannot change the mix; an empty table has an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .components import by_shuffle
from .scratch import save

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source and size are dealt to shares: so many at least, and one for so many rows.
SHARES, SHARE_ROWS = 16, 1_000_000
#: Sources of one range when they are ranked.
RANGE = 500_000
CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)


def n_words(text: Column) -> Column:
    """Words of a text by what follows white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source."""
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Adds _k, a source's place from 0 by code point, null last; by ranges, as sources may be many."""
    n = sizes.count()
    order = F.col("source").cast("binary").asc_nulls_last()
    dealt = save(sizes.repartitionByRange(max(1, n // RANGE), order).withColumn("_pid", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("count").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_pid").count().select("_pid", before.alias("_before"))  # one row for RANGE sources
    place = F.row_number().over(W.partitionBy("_pid").orderBy(order)) - 1
    return dealt.withColumn("_k", place).join(F.broadcast(starts), "_pid").withColumn("_k", F.col("_k") + F.col("_before")).drop("_pid", "_before")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size (long). Adds target (double): all words, shared by weight.

    Sources by code point, null last, get the weights in turn. A target stops at cap times
    its source's size, and what is above is shared anew by weight until none is above.
    """
    named = _ranked(sizes)
    named = named.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int")))
    named = save(named.withColumn("_cap", F.lit(cap) * F.col("source_size")), "weighed")
    level, left = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_w") * F.lit(level) > F.col("_cap")
        about = named.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("_cap"))).alias("capped"), F.sum(F.when(~full, F.col("_w"))).alias("weight"), F.count(F.when(~full, 1)).alias("n")).first()
        if about["n"] == left or not about["n"]:
            break
        left, level = about["n"], (about["all"] - (about["capped"] or 0.0)) / about["weight"]
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.col("_w") * F.lit(level))
    return named.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = 20) -> DataFrame:
    """docs: doc_id, text, source. Returns doc_id, source, size, source_size, target, copies, taken.

    Two copies of a row count as two; ``copies`` is how often the mix takes the row.
    """
    # sizes are counted once, and stored: a few bytes a document
    rows = save(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes")
    return mix_sizes(rows, weights, cap, seed)


def mix_sizes(rows: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = 20) -> DataFrame:
    """As mix, for rows of doc_id, source, size."""
    shares = max(SHARES, rows.count() // SHARE_ROWS)
    share = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(shares)).cast("int")
    rows = rows.withColumn("share", share)
    blocks = rows.groupBy("source", "size", "share").agg(F.count(F.lit(1)).alias("n"))
    blocks = save(blocks, "blocks")
    sizes = blocks.groupBy("source", "size").agg(F.sum("n").alias("n")).groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("bigint").alias("source_size"))
    by_size = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    by_share = W.partitionBy("source", "size").orderBy("share").rowsBetween(W.unboundedPreceding, -1)
    per_size = blocks.groupBy("source", "size").agg(F.sum("n").alias("m")).select("source", "size", F.coalesce(F.sum("m").over(by_size), F.lit(0)).alias("below"))
    spread = targets(sizes, weights, cap)
    same = lambda a, b, *more: a["source"].eqNullSafe(b["source"]) & (F.lit(True) if not more else a["size"] == b["size"])
    starts = blocks.withColumn("within", F.coalesce(F.sum("n").over(by_share), F.lit(0)))
    starts = starts.join(by_shuffle(per_size), same(starts, per_size, 1)).select(starts["source"], starts["size"], "share", (F.col("below") + F.col("within")).alias("before"))
    starts = starts.join(by_shuffle(spread), same(starts, spread)).select(starts["source"], "size", "share", "before", "source_size", "target")
    rank = F.row_number().over(W.partitionBy("source", "size", "share").orderBy("doc_id"))
    ranked = rows.withColumn("rank", rank)
    both = ranked.join(by_shuffle(starts), same(ranked, starts, 1) & (ranked["share"] == starts["share"]), "left").select(
        "doc_id", ranked["source"], ranked["size"], "source_size", "target", (F.col("rank") + F.col("before")).alias("place")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    begin = offset(F.col("source"), seed)
    crossed = F.floor(F.col("place") * rate + begin) - F.floor((F.col("place") - 1) * rate + begin)
    out = both.withColumn("copies", F.when(F.col("size") > 0, crossed).otherwise(F.lit(0)).cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = 20) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns only.

    Rows that agree in doc_id, source and size get their copies between them: the
    number taken is exact, and which of them bears it does not matter for the mix.
    """
    # a struct's null fields are equal to one another, so the place and the join need one shuffle of the rows
    # of one type on both sides, nullable fields included: a cast in between would deal the rows anew
    key = lambda i, source, size: F.struct(i.alias("i"), source.alias("source"), size.alias("size")).cast("struct<i:bigint,source:string,size:bigint>")
    chosen = mix(docs, weights, cap, seed).groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("_key")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d"))
    rows = rows.select("_d", key(F.col("_d.doc_id"), F.col("_d.source").cast("string"), n_words(F.col("_d.text"))).alias("_key"))
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy("_key").orderBy(F.lit(1))))
    own = F.expr("cast(_copies div _rows + if(_place <= _copies % _rows, 1, 0) as int)")
    each = F.explode(F.when(own > 0, F.sequence(F.lit(1), own)).otherwise(F.array().cast("array<int>")))
    return placed.join(by_shuffle(chosen), "_key").select("_d", each.alias("_copy")).select(*[F.col(f"_d.`{c}`") for c in names])
