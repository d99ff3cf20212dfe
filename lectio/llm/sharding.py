"""Sharding by jump consistent hashing (Lamping and Veach, "A Fast, Minimal Memory, Consistent
Hash Algorithm", 2014), in DataFrame functions only.

A row's shard follows from its key and the number of shards alone: no ring table, nothing to
broadcast. With one more shard a row either stays or goes into the new one.

Defined cases: a null key counts as 0; a null text has no bytes (size 1, crc32 of nothing, 0);
repeated rows land in one shard and get different slots; an empty table gives an empty result;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, slices, stage

#: The generator's multiplier, a fixed value of the published algorithm.
MULTIPLIER = 2862933555777941757
LOW32, LOW16 = 0xFFFFFFFF, 0xFFFF


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2^32 for x and c below 2^32, without a signed overflow."""
    return x * F.lit(c & LOW16) + F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(LOW16)), 16)


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The next 64-bit state (state * MULTIPLIER + 1 modulo 2^64), kept as two 32-bit halves."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32
    a, b = lo * F.lit(c_lo & LOW16), lo * F.lit(c_lo >> 16)
    low = a.bitwiseAND(F.lit(LOW32)) + F.shiftleft(b.bitwiseAND(F.lit(LOW16)), 16) + F.lit(1)
    carry = F.shiftright(a, 32) + F.shiftright(b, 16) + F.shiftright(low, 32)
    high = carry + _times(hi, c_lo) + _times(lo, c_hi)
    return high.bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump_shards(key: Column, counts: list[int]) -> Column:
    """A struct with the shard of a 64-bit key for each number of shards: fields s0, s1, ...

    One walk serves all counts: the walk visits the shards at which the key would move, and the
    last visited one below n is the shard among n. Each step moves on by one at least, so
    max(counts) steps always end it.
    """
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    top = max(counts)
    start = F.struct(
        F.shiftrightunsigned(k, 32).alias("hi"),
        k.bitwiseAND(F.lit(LOW32)).alias("lo"),
        F.lit(0).cast("long").alias("j"),
        *[F.lit(0).cast("long").alias(f"s{i}") for i in range(len(counts))],
    )

    def step(at: Column, _: Column) -> Column:
        hi, lo = _advance(at["hi"], at["lo"])
        jump = F.floor((at["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            jump.cast("long").alias("j"),
            *[F.when(at["j"] < n, at["j"]).otherwise(at[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)],
        )
        return F.when(at["j"] < top, moved).otherwise(at)

    end = lambda at: F.struct(*[at[f"s{i}"].cast("int").alias(f"s{i}") for i in range(len(counts))])
    return F.aggregate(F.sequence(F.lit(1), F.lit(top)), start, step, end)


def shard_documents(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots are dense within a shard. They come from row numbers in small hash slices of a shard
    plus the sums of the slices before, so no task ever sorts a whole shard; a row's place in the written
    table is part of the slice's hash, so that repeated rows are spread too. Columns `key` and
    `text` are the only ones read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shards(F.col(key), [shards, shards + 1]).alias("to"),
    )
    rows = stage(
        placed.select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("to.s0").alias("shard"),
            F.col("to.s1").alias("grown_shard"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shards",
    )
    part = F.pmod(F.xxhash64("doc_id", "_row"), F.lit(slices(rows, shards))).alias("_slice")
    rows = rows.select("*", part)
    sums = rows.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    sums = sums.select("shard", "_slice", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy("doc_id", "text_crc32", "size", "_row")) - 1
    return (
        rows.withColumn("_within", within)
        .join(sums, ["shard", "_slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_before") + F.col("_within")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op6_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
