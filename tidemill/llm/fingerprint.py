"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a text's five-word shingles. Sketches of parts merge into
the sketch of the union, and two of them estimate resemblance, containment and the number of distinct shingles;
a text of up to k distinct shingles is held whole, and then every estimate is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import block_count, extended, hash_words, slices, split_words, text_or_empty, windows, without

K, SHINGLE = 256, 5
_EMPTY = np.zeros(0, np.uint64)


def sketches(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Ascending hashes of each text. Fewer words than a shingle has count as one shingle; no words give an empty sketch."""
    offsets, codes, dictionary = split_words(texts)
    ends, hashes = windows(hash_words(dictionary)[codes] if len(codes) else _EMPTY, offsets, shingle)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = hashes[a:b]
        # Repeats may fill the smallest values, so distinct values are taken first; the cut only spares the sort.
        own = np.sort(pd.unique(own))[:k] if b - a <= 4 * k else smallest(pd.unique(own), k)
        out.append(own)
    return out


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.partition(values, k)[:k] if len(values) > k else values)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: counted below k, else (k - 1) by the k-th smallest share of the hash range."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the k smallest of the union that both hold. Two empty sketches are alike (1), an empty and a full one aren't (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    first = np.concatenate([[True], ~same])
    union = min(k, int(first.sum()))
    last = both[first][union - 1]
    return float((both[1:][same] <= last).sum()) / union


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b holds, from resemblance and the counts."""
    if not len(a):
        return 1.0
    r, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return min(1.0, r * (na + nb) / ((1 + r) * na))


def encode(a: np.ndarray) -> str:
    """Base64 of the hashes, eight little-endian bytes each, ascending; empty for an empty sketch."""
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def add_fingerprints(df: DataFrame, text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with ``fingerprint`` and ``n_shingles`` (estimated distinct ones). Null text counts as empty; no shuffle."""
    df = without(df, "fingerprint", "n_shingles")
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[at]):
            s = sketches(b.column(at), k, shingle)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([encode(x) for x in s], pa.string()), pa.array([distinct_count(x, k) for x in s], pa.float64())], [*names, "fingerprint", "n_shingles"])

    return df.mapInArrow(run, extended(df, fingerprint="string", n_shingles="double"))


def beside_next(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt into ranges of ``key``, descending, each range followed by a copy of the next one's first row.

    Adds ``__block`` and ``__tail`` (the copy; the last range is followed by the first row of all). Ranges are cut at quantiles of the
    keys, which are gathered as one number for each block; null keys come last. Within a partition rows are sorted
    by block, copy last, key descending and a hash of the rest, so that rows of equal keys have one order.
    """
    blocks = block_count(df.sparkSession)
    cuts = df.select(F.percentile_approx(F.col(key), F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(10 * blocks)).alias("c")).first()["c"]
    edges = np.array(sorted({-int(c) for c in cuts or []}), np.int64)

    def spots(keys: pa.Array) -> np.ndarray:
        keyed = np.searchsorted(edges, -pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), "right")
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), len(edges), keyed)

    @F.arrow_udf("int")
    def block_of(keys: pa.Array) -> pa.Array:
        return pa.array(spots(keys), pa.int32())

    heads = df.select(F.col(key).alias("k")).groupBy(block_of("k").alias("b")).agg(F.max("k").alias("m")).orderBy("b").collect()
    known = np.array([r["b"] for r in heads], np.int64)
    highest = pa.array([r["m"] for r in heads], pa.int64())
    before = np.roll(known, 1)

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array) -> pa.Array:
        own = spots(keys)
        at = np.searchsorted(known, own)
        top = highest.take(pa.array(at))
        first = pc.or_(pc.fill_null(pc.equal(keys, top), False), pc.and_(keys.is_null(), top.is_null())).to_numpy(zero_copy_only=False)
        return pa.array([[int(o), ~int(t)] if f else [int(o)] for o, t, f in zip(own, before[at], first, strict=True)], pa.list_(pa.int32()))

    dealt = df.withColumn("__order", F.xxhash64(*df.columns)).withColumn("__p", F.explode(places(key)))
    dealt = dealt.withColumn("__tail", F.col("__p") < 0).withColumn("__block", F.when(F.col("__tail"), F.bitwise_not("__p")).otherwise(F.col("__p"))).drop("__p")
    return dealt.repartition(blocks, "__block").sortWithinPartitions("__block", "__tail", F.col(key).desc_nulls_last(), "__order").drop("__order")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by as many first ones of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op8_fingerprints(documents: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each whole text's fingerprint, that of its edited text, and its likeness to both the edited and the next text."""
    rows = beside_next(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), "doc_id")
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its next one
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            rows = list(zip(b.column("doc_id").to_pylist(), texts, b.column("__block").to_pylist(), b.column("__tail").to_pylist(), sketches(b.column("text"), k, shingle), strict=True))
            pairs = []
            for row in rows:
                if held is not None and held[2] == row[2] and not held[3]:
                    pairs.append((held, row))
                held = row
            changed = [edited(a[1], n[1]) for a, n in pairs]
            marks = sketches(pa.array(changed, pa.string()), k, shingle) if pairs else []
            columns = [
                [a[0] for a, _ in pairs],
                [len(a[1]) for a, _ in pairs],
                [hashlib.sha256(c.encode()).hexdigest() for c in changed],
                [encode(a[4]) for a, _ in pairs],
                [encode(m) for m in marks],
                [resemblance(a[4], m, k) for (a, _), m in zip(pairs, marks, strict=True)],
                [resemblance(a[4], n[4], k) for a, n in pairs],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
