"""Jump consistent hashing into shards, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import block_count, text_or_empty, without

#: The multiplier of the published generator, in 32-bit halves.
_MULTIPLIER_HIGH, _MULTIPLIER_LOW = divmod(2862933555777941757, 1 << 32)
_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """One step of the generator modulo 2**64, on unsigned halves so that no product leaves a signed long."""
    t = low.bitwiseAND(F.lit(_M16)) * F.lit(_MULTIPLIER_LOW) + F.lit(1)
    u = F.shiftright(low, 16) * F.lit(_MULTIPLIER_LOW) + F.shiftright(t, 16)
    new_low = F.shiftleft(u.bitwiseAND(F.lit(_M16)), 16).bitwiseOR(t.bitwiseAND(F.lit(_M16)))
    cross = high.bitwiseAND(F.lit(_M16)) * F.lit(_MULTIPLIER_LOW) + F.shiftleft((F.shiftright(high, 16) * F.lit(_MULTIPLIER_LOW)).bitwiseAND(F.lit(_M16)), 16)
    new_high = (F.shiftright(u, 16) + cross.bitwiseAND(F.lit(_M32)) + (low * F.lit(_MULTIPLIER_HIGH)).bitwiseAND(F.lit(_M32))).bitwiseAND(F.lit(_M32))
    return new_high, new_low


def jump_hash(key: Column, n_shards: int) -> Column:
    """The shard of a 64-bit key, 0 to ``n_shards - 1``; a null key counts as 0.

    The published loop makes ``ln(n_shards) + 1`` steps on average and ``n_shards`` at most, so a fold
    over that many elements, idle once the jump passes the end, gives its very result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"),
        key.bitwiseAND(F.lit(_M32)).alias("l"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next_state(s["h"], s["l"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(s["j"] >= n_shards, s).otherwise(F.struct(high.alias("h"), low.alias("l"), s["j"].alias("b"), jump.cast("long").alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, step, lambda s: s["b"].cast("int"))


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", slots: bool = True) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (with one shard more) and, if ``slots``, ``slot``: a gapless number from 0 in the shard.

    Key and shard count alone decide the shard: equal keys share one, null keys go where 0 goes, and one more shard
    takes rows only into itself. Slots follow blocks of hashed keys, then the key; rows of equal keys are numbered in any
    order. No shard is sorted as a whole: rows are numbered within blocks, and a small table of block
    counts (shards times blocks, a bound set by the parameters) gives each block's first number. The counts need
    only the key. An empty table gives an empty one; columns named as the new ones are replaced.
    """
    df = without(df, "shard", "grown_shard", "slot")
    out = df.withColumn("shard", jump_hash(F.col(key), n_shards)).withColumn("grown_shard", jump_hash(F.col(key), n_shards + 1))
    if not slots:
        return out
    blocks = max(4, block_count(df.sparkSession) // n_shards + 1)
    block = F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(blocks)).cast("int")
    counts = df.select(jump_hash(F.col(key), n_shards).alias("__s"), block.alias("__b")).groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    firsts = counts.select("__s", "__b", (F.sum("__n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__n")).alias("__first"))
    numbered = out.withColumn("__b", block).withColumn("__k", F.row_number().over(Window.partitionBy("shard", "__b").orderBy(key)) - 1)
    joined = numbered.join(F.broadcast(firsts), (F.col("shard") == F.col("__s")) & (numbered["__b"] == firsts["__b"]))
    return joined.select(*out.columns, (F.col("__first") + F.col("__k")).cast("long").alias("slot"))


def op3_sharding(documents: DataFrame, n_shards: int = 40) -> DataFrame:
    """All documents in shards 0 to 39 by the law ``key``; a null text has no bytes."""
    text = text_or_empty()
    rows = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return assign_shards(rows, n_shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
