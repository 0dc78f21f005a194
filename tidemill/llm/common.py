"""What the operators of this subpackage share: reading, checkpoints, word splitting and hashing.

A word is a run of characters other than space and ``\\t \\n \\v \\f \\r``.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the Python side of an operator works on at once.
SLICE_BYTES = 2 << 20
U64 = np.uint64
_GOLD, _MIX1, _MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STORED_BLOCK = 8 << 20
_local_folder: list[str] = []
_stored: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a temporary folder serves a local master; on a cluster that's an error."""
    if (top := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="tidemill-shared-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return _local_folder[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from reliable files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows from Parquet in the shared folder, where several readers each need few of the columns. Removed when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", STORED_BLOCK).parquet(path)  # what a writer holds beside the workers
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_stored() -> None:
    for spark, path in _stored:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_count(spark: SparkSession, least: int = 64) -> int:
    """Blocks that a hot key is split into: four for each shuffle partition, so the count follows the cluster's size."""
    return max(least, 4 * shuffle_partitions(spark))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash with those an operator adds."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def extended(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` with further columns; ``StructType.add`` would change the frame's own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in kinds.items())).fields])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about ``most_bytes`` of text each, one row at least; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def trim() -> None:
    """Give back memory that a task no longer needs: Python workers outlive tasks, and run beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, dictionary): the words of text i are ``dictionary[codes[offsets[i]:offsets[i + 1]]]``."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    values, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.greater(pc.binary_length(values), 0)
    if values and not pc.all(full).as_py():  # text that begins or ends with white space gives empty words
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
        offsets, values = kept[offsets], values.filter(full)
    coded = values.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``start[i]`` to ``start[i] + length[i] - 1`` for each i, one after another."""
    ends = np.cumsum(length, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def hash_words(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string: the sum of a mixed number for each byte and place, mixed with the length."""
    dictionary = dictionary.cast(pa.large_binary())
    if not len(dictionary):
        return np.zeros(0, U64)
    offsets = np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset : dictionary.offset + len(dictionary) + 1]
    lengths = np.diff(offsets)
    data = np.frombuffer(dictionary.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    place = (np.arange(len(data)) - np.repeat(starts[:-1], lengths)).astype(U64)
    keyed = int(mix(np.array([seed + 1], U64))[0])
    total = np.concatenate([[U64(0)], np.cumsum(mix(((place << U64(8)) | data) * _GOLD + U64(keyed)), dtype=U64)])
    return mix(total[starts[1:]] - total[starts[:-1]] + (lengths.astype(U64) + U64(1)) * _MIX1)


def windows(hashes: np.ndarray, offsets: np.ndarray, n: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the windows of ``n`` words of each text.

    A text of one to ``n - 1`` words gives its whole word sequence as one window if ``short_whole``; one without words gives none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= n, lengths - n + 1, ((lengths > 0) & short_whole).astype(np.int64))
    total = len(hashes)
    rolled = np.full(total, U64(n))
    for j in range(n):
        rolled[: max(0, total - j)] = mix((rolled[: max(0, total - j)] + hashes[j:]) * _GOLD + U64(j + 1))
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(offsets[:-1], counts)
    out = rolled[at]
    if short_whole:
        for i in np.flatnonzero((lengths > 0) & (lengths < n)):
            h = np.full(1, U64(lengths[i]))
            for j, w in enumerate(hashes[offsets[i] : offsets[i + 1]]):
                h = mix((h + w) * _GOLD + U64(j + 1))
            out[ends[i] - 1] = h[0]
    return np.concatenate([[0], ends]).astype(np.int64), out


#: Bits of a filter at most: 8 MB. Beyond, it lets more rows through, to the exact join that follows it.
MOST_FILTER_BITS = 1 << 26


class RowFilter:
    """A set of hashed longs as bits of bounded size, which thins rows out before an exact join. It has no false negatives."""

    def __init__(self, df: DataFrame, hashed: str):
        self.bits = min(MOST_FILTER_BITS, 1 << max(16, (16 * df.count()).bit_length()))
        at = df.select(F.col(hashed).bitwiseAND(F.lit(self.bits - 1)).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(p & 63 as int))")).alias("b")).toPandas()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)

    def __call__(self, hashed: np.ndarray) -> np.ndarray:
        """Whether each value may be in the set."""
        at = hashed & (self.bits - 1)
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1
