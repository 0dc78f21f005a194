"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, block_count, checkpointed, text_or_empty, without

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
#: Rows of the plan (some 50 bytes each) that are broadcast at most.
MOST_BROADCAST_ROWS = 100_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. Targets are in proportion to weight, stop at
    ``most_epochs`` times the size, and what goes beyond is shared again: sources are filled in the order of
    ``most_epochs * size / weight``, and those before the first that its share doesn't fill are full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most_epochs))
    s = sizes.withColumn("__w", weight).withColumn("__full", full).withColumn("__r", F.col("__full") / F.col("__w"))
    order = Window.orderBy("__r", F.col("source").isNull(), "source")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("__full").over(before), F.lit(0.0))) / F.sum("__w").over(onward)
    s = s.withColumn("__level", level).withColumn("__open", F.col("__level") <= F.col("__r"))
    filled = F.max(F.col("__open")).over(before)
    shared = F.first(F.when(F.col("__open"), F.col("__level")), ignorenulls=True).over(every)
    target = F.when(F.coalesce(filled, F.lit(False)) | F.col("__open"), F.col("__w") * shared).otherwise(F.col("__full"))
    return s.select("source", "source_size", F.least(target, F.col("__full")).alias("target"))


def mix_sources(
    df: DataFrame,
    size: Column,
    key: Column,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
    whole: bool = False,
    seed: int = 7,
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    Each source is put in a hash-random order of ``key`` and cut at its budget, as often around as needed: ``taken`` is
    the words taken of a row, repeats counted; the row at the cut gives a part, so a source's total is
    its target rounded. With ``whole``, the row at the cut is taken if most of it is within the budget.
    ``copies`` is how often the row is taken whole. Rows without words take no part (``taken`` 0); with ``whole`` they
    have as many copies as the rows beside them. A null source is a source of its own. Equal keys in one source are
    ordered by size; rows equal in both are interchangeable.

    The hash is uniform, so fixed ranges of it split a source of any size into even blocks; sums by
    (source, block) become each block's start, and prefix sums run within blocks alone.
    """
    spark = df.sparkSession
    df = without(df, "size", "source_size", "target", "taken", "copies")
    blocks = block_count(spark)
    key_hash = F.xxhash64(key, F.lit(seed))
    block = F.shiftrightunsigned(key_hash, 40).cast("double") / float(1 << 24)
    rows = df.withColumn("size", size).withColumn("__key", F.shiftrightunsigned(key_hash, 1)).withColumn("__b", F.least(F.floor(block * blocks), F.lit(blocks - 1)).cast("int"))
    sums = checkpointed(rows.groupBy("source", "__b").agg(F.sum("size").alias("__sum")))
    totals = sums.groupBy("source").agg(F.sum("__sum").cast("long").alias("source_size"))
    targets = source_targets(totals, weights, share, most_epochs)
    starts = sums.withColumn("__start", F.sum("__sum").over(Window.partitionBy("source").orderBy("__b")) - F.col("__sum"))
    plan = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("__src"), starts["__b"].alias("__pb"), "__start", "source_size", "target"
    )
    # A row for each source and block: small unless there are very many sources, so it is counted before it is broadcast.
    if sums.count() <= MOST_BROADCAST_ROWS:
        plan = F.broadcast(plan)
    inner = Window.partitionBy("source", "__b").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__before", F.sum("size").over(inner) - F.col("size"))
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["__src"]) & (rows["__b"] == plan["__pb"]))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div nullif(source_size, 0)")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    at = F.col("__start") + F.col("__before")
    if whole:
        part = F.when(at * 2 + F.col("size") <= rest * 2, F.when(rest > 0, F.col("size")).otherwise(F.lit(0))).otherwise(F.lit(0))
        copies = epochs + F.when((at * 2 + F.col("size") <= rest * 2) & (rest > 0), 1).otherwise(0)
    else:
        part = F.greatest(F.lit(0), F.least(F.col("size"), rest - at))
        copies = epochs + F.when((F.col("size") > 0) & (part >= F.col("size")), 1).otherwise(0)
    taken = epochs * F.col("size") + part
    return joined.select(*df.columns, "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"))


def op7_mixing(documents: DataFrame) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 to 150 % of all words, two epochs of a source at most."""
    narrow = checkpointed(documents.select("doc_id", "source", word_count().alias("n_words")))
    mixed = mix_sources(narrow, F.col("n_words"), F.col("doc_id"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
