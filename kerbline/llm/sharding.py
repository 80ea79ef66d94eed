"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number from a hash of the key and its own number, scaled by its weight; the largest wins. One more
shard takes rows only into itself. The shard is one expression on the key: no shuffle. Slots number a shard's rows
without a gap: rows are counted in hash buckets of each shard, the counts give every bucket its first slot. Nothing is written on
the way: texts are read once for the counts and once for the slots, and only keys, sizes and checksums are shuffled.

Defined results: a null key is a key like another. A null text has no bytes and the crc32 of the empty text. Equal rows
get consecutive slots. An input column named shard is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SHARDS = 24
#: Rows numbered together.
BUCKET_ROWS = 512


def draw(key: Sequence[str], shard: int, weight: float) -> Column:
    """weight over an exponential variate that the key and the shard decide."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard)), 11)
    return F.lit(float(weight)) / -F.ln((bits + F.lit(0.5)) * F.lit(2.0**-53))


def shard_of(key: Sequence[str], weights: Sequence[float]) -> Column:
    """The number of the shard, 0 to len(weights) - 1, that draws the largest number; of equal ones the first."""
    return -F.array_max(F.array(*[F.struct(draw(key, i, w).alias("d"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]))["i"]


def assign_shards(docs: DataFrame, key: Sequence[str] = ("doc_id",), weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """docs with the int column shard."""
    return docs.withColumn("shard", shard_of(key, weights).cast("int"))


def manifest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (in the shard, from 0) and grown_shard (with one more shard)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    units = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m"))
    buckets = docs.count() // (shards * BUCKET_ROWS) + 1
    units = assign_shards(units, weights=(1.0,) * shards).withColumn("grown_shard", shard_of(["doc_id"], (1.0,) * (shards + 1)).cast("int"))
    units = units.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    sums = units.groupBy("shard", "bucket").agg(F.sum("m").alias("rows"))
    # one row for each bucket, not for each document
    first = sums.select("shard", "bucket", (F.sum("rows").over(W.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("first"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = units.withColumn("before", F.sum("m").over(inside) - F.col("m")).join(first, ["shard", "bucket"])
    start = F.col("first") + F.col("before")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(start, start + F.col("m") - 1)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, key: Sequence[str] = ("doc_id",), weights: Sequence[float] = (1.0,) * SHARDS) -> None:
    """Writes one folder of Parquet files for each shard; every task writes its own file in each, so no shard is one task."""
    assign_shards(docs, key, weights).write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = manifest(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
