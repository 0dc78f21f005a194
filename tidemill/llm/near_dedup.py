"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A text's signature has 64 symbols: the lowest b = 16 bits of (a mix of) 64 minima over its shingles. Two texts of resemblance J
differ in about 64 (1 - J) symbols. The join finds every pair within ``most_errors`` differing symbols: the signature is split
into chunks so that by pigeonhole one chunk has few enough errors, and for each chunk the allowed errors are
enumerated by leaving symbols out. With 25 errors, a pair of resemblance 0.8 is farther apart once in ten thousand times.

Pairs are never listed. Texts of equal word sequences are one node. Within a bucket only a spanning forest of the pairs under
the signature distance is kept; the forests' components are candidate groups; within each, every pair that its
full shingle sets don't rule out is compared on them, whatever the signatures say, and a spanning forest of true links remains. Texts don't move
for that, but the sets of those in a group. Buckets of many texts, and groups of many texts or shingles, are split in blocks, each pair of blocks a
task of its own, so no task holds an unbounded group and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import U64, RowFilter, checkpointed, hash_words, mix, slices, split_words, text_or_empty, windows, without
from tidemill.llm.graph import components, links_in_groups, whole_groups

SYMBOLS, BITS = 64, 16
MOST_ERRORS = 25
SHINGLE, PERCENT = 5, 80
#: Texts of a bucket, and texts and shingles of a candidate group, that are one block.
BLOCK, GROUP_BLOCK, BLOCK_SHINGLES = 4096, 256, 1 << 20
#: Bits of the sketch that rules pairs of sets out.
RULED_BITS = 8192
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(4)
def _multipliers(n: int) -> np.ndarray:
    return ((mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def shingle_sets(texts: pa.Array, shingle: int, lower: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(ascending distinct shingle hashes, word-sequence hashes, their second half) of each text."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    offsets, codes, dictionary = split_words(texts)
    hashes = hash_words(dictionary)[codes] if len(codes) else np.zeros(0, U64)
    ends, rolled = windows(hashes, offsets, shingle)
    sets = [np.unique(rolled[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    place = np.arange(len(hashes), dtype=U64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(U64)
    sums = []
    for seed in (U64(0x51ED270B), U64(0x2545F4914F6CDD1D)):
        total = np.concatenate([[U64(0)], np.cumsum(mix((hashes ^ seed) * U64(0xD6E8FEB86659FD93) + mix(place + seed)), dtype=U64)])
        sums.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(U64)))
    return sets, sums[0], sums[1]


def signature(hashes: np.ndarray, n: int = SYMBOLS) -> np.ndarray:
    """``n`` symbols of 16 bits; the set must not be empty. The permutations multiply the upper 32 bits of the hashes."""
    lowest, upper = np.full(n, np.iinfo(np.uint32).max, np.uint32), (hashes >> U64(32)).astype(np.uint32)
    for i in range(0, len(upper), 2048):
        np.minimum(lowest, (_multipliers(n) * upper[None, i : i + 2048]).min(axis=1), out=lowest)
    return (mix(lowest.astype(U64) + U64(1)) >> U64(64 - BITS)).astype("<u2")


@lru_cache(4)
def chunk_masks(n: int = SYMBOLS, most_errors: int = MOST_ERRORS, per_chunk: int = 1) -> list[np.ndarray]:
    """The symbols that each key takes. With ``per_chunk`` errors enumerated in a chunk, as many chunks are needed that
    ``most_errors`` errors can't put more than that in every one."""
    return [np.array(sorted(set(c.tolist()) - set(left))) for c in chunks(n, most_errors, per_chunk) for left in combinations(c.tolist(), min(per_chunk, len(c) - 1))]


def chunks(n: int = SYMBOLS, most_errors: int = MOST_ERRORS, per_chunk: int = 1) -> list[np.ndarray]:
    return np.array_split(np.arange(n), most_errors // (per_chunk + 1) + 1)


def bucket_keys(signatures: np.ndarray, masks: list[np.ndarray] | None = None) -> np.ndarray:
    """(texts, keys) 64-bit keys, one for each mask; by default those of all allowed errors."""
    out = []
    for i, mask in enumerate(masks or chunk_masks(signatures.shape[1])):
        h = np.full(len(signatures), U64(i + 1))
        for s in mask:
            h = mix(h * U64(0x9E3779B97F4A7C15) + signatures[:, s].astype(U64) + U64(1))
        out.append(h)
    return np.column_stack(out).view(np.int64)


def _signature_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


class Sets:
    """Ascending distinct shingle hashes of several texts, and which of them are linked."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(x) for x in sets], np.int64)
        at = np.concatenate([h >> U64(64 - RULED_BITS.bit_length() + 1) for h in sets]).astype(np.int64) if sets else np.zeros(0, np.int64)
        bits = np.zeros((len(sets), RULED_BITS), bool)
        bits[np.repeat(np.arange(len(sets)), self.size), at] = True
        self.bits = np.packbits(bits, axis=1).view(U64)

    def linked(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether texts ``u[i]`` and ``v[i]`` are: first by their sizes, then by the sketches, which bound what is not common from below, then in full."""
        small, large = np.minimum(self.size[u], self.size[v]), np.maximum(self.size[u], self.size[v])
        out = 100 * small >= self.percent * large
        out &= small > 0
        some = np.flatnonzero(out)
        a, b = self.bits[u[some]], self.bits[v[some]]
        common = np.minimum(self.size[u[some]] - np.bitwise_count(a & ~b).sum(axis=1), self.size[v[some]] - np.bitwise_count(b & ~a).sum(axis=1)).astype(np.int64)
        out[some] = 100 * common >= self.percent * (small[some] + large[some] - common)
        for k in np.flatnonzero(out):
            x, y = self.sets[u[k]], self.sets[v[k]]
            spot = np.searchsorted(x, y)
            n = int((x[np.minimum(spot, len(x) - 1)] == y).sum())
            out[k] = 100 * n >= self.percent * (len(x) + len(y) - n)
        return out


def _blocks(df: DataFrame, id_: str, size: Column, block: int) -> DataFrame:
    """``df``, in whose rows ``size`` is that of their group, with ``__i``, ``__j`` (a pair of blocks, which together form a task) and ``__side``: 0 within a block, else 1 or 2."""
    n = F.greatest(F.lit(1), F.ceil(size / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64(id_, F.lit("block")), n).cast("int")
    tasks = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.struct(
            F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), F.when(j == own, 0).when(own < j, 1).otherwise(2).cast("int").alias("side")
        ),
    )
    return df.withColumn("__t", F.explode(tasks)).select(*df.columns, F.col("__t.i").alias("__i"), F.col("__t.j").alias("__j"), F.col("__t.side").alias("__side"))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, lower: bool = True, most_errors: int = MOST_ERRORS, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``df``.

    Two texts are linked if ``100 * common >= percent * all`` distinct shingles; component_id is the smallest key reachable. A text with fewer
    words than a shingle has its whole sequence as its one shingle. Null and wordless texts have none and stand alone, as do rows
    whose key is null. Rows that repeat a key are one node. An empty table gives an empty one.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets, h1, h2 = shingle_sets(b.column("text"), shingle, lower)
            signs = [signature(s).tobytes() if len(s) else None for s in sets]
            columns = [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2", "sig"])

    signed = checkpointed(rows.mapInArrow(sign, "id long, n long, h1 long, h2 long, sig binary"))
    full = signed.where("sig is not null and id is not null")
    # One text of each word sequence goes on. A sequence's rows share everything but the id.
    # Written, they are joined from an exchange of their own, so that a class of a third of all rows can be split.
    classes = checkpointed(full.groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    same = full.join(classes, ["h1", "h2"])
    nodes = checkpointed(same.where("id = rep").dropDuplicates(["id", "h1", "h2"]).select("id", "n", "sig"))

    def candidates_by(masks: list[np.ndarray], labelled: DataFrame) -> DataFrame:
        """(u, v) of ``labelled`` (id, sig, label): edges that connect, in each bucket, what is near and of unlike label."""

        def keyed(known: RowFilter | None):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        keys = bucket_keys(_signature_rows(b.column("sig")), masks)
                        ids = np.repeat(b.column("id").to_numpy(), keys.shape[1])
                        keys = keys.ravel()
                        keep = slice(None) if known is None else known(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep])], ["key", "id"])

            return run

        keys = labelled.select("id", "sig").mapInArrow(keyed(None), "key long, id long")
        live = checkpointed(keys.select("key").groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        # Most keys belong to one text: a filter of bounded size keeps them out of the join's shuffle.
        maybe = labelled.select("id", "sig").mapInArrow(keyed(RowFilter(live, "key")), "key long, id long")
        members = _blocks(maybe.join(live, "key"), "id", F.col("size"), block).join(labelled, "id")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, starts in whole_groups(batches, ["key", "__i", "__j"]):
                ids, label, signs = g["id"].to_numpy(), g["label"].to_numpy(), _signature_rows(g["sig"])

                def close(a: np.ndarray, b: np.ndarray, label=label, signs=signs) -> np.ndarray:
                    out = label[a] != label[b]
                    out[out] = (signs[a[out]] != signs[b[out]]).sum(axis=1) <= most_errors
                    return out

                u, v = links_in_groups(starts, len(ids), close, g["__side"].to_numpy())
                edges = pa.table({"u": np.minimum(ids[u], ids[v]), "v": np.maximum(ids[u], ids[v])}).group_by(["u", "v"]).aggregate([])
                yield from edges.select(["u", "v"]).to_batches()

        dealt = members.select("key", "__i", "__j", "__side", "id", "label", "sig").repartition("key", "__i", "__j").sortWithinPartitions("key", "__i", "__j", "id")
        return dealt.mapInArrow(near, "u long, v long").distinct()

    # Texts that share a whole chunk first: in the many buckets of the enumerated errors only texts that are still apart are compared.
    first = checkpointed(components(candidates_by(chunks(SYMBOLS, most_errors), nodes.select("id", "sig", F.col("id").alias("label")))))
    apart = nodes.join(first.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "sig", F.coalesce("component", "id").alias("label"))
    edges = candidates_by(chunk_masks(SYMBOLS, most_errors), checkpointed(apart))
    candidates = checkpointed(components(edges.unionByName(first.select(F.col("node").alias("u"), F.col("component").alias("v")))))
    # Few texts have a candidate: only theirs are moved.
    chosen = RowFilter(candidates.select(F.xxhash64("node").alias("h")), "h")

    @F.arrow_udf("boolean")
    def may_be_chosen(hashed: pa.Array) -> pa.Array:
        return pa.array(chosen(hashed.to_numpy(zero_copy_only=False)))

    wanted = rows.where("id is not null").where(may_be_chosen(F.xxhash64("id")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), shingle, lower)[0]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "set"])

    weights = candidates.join(nodes.groupBy(F.col("id").alias("node")).agg(F.max("n").alias("n")), "node")
    sizes = weights.groupBy("component").agg(F.greatest(F.count("*"), F.sum("n") * F.lit(GROUP_BLOCK / BLOCK_SHINGLES)).alias("size"))
    placed = _blocks(candidates.join(sizes, "component"), "node", F.col("size"), max(1, min(GROUP_BLOCK, block)))
    whole = placed.join(wanted.mapInArrow(shingled, "node long, set binary"), "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, starts in whole_groups(batches, ["component", "__i", "__j"], 2 * GROUP_BLOCK):
            ids = g["node"].to_numpy()
            sets = Sets([np.frombuffer(x, U64) for x in g["set"].to_pylist()], percent)
            u, v = links_in_groups(starts, len(ids), sets.linked, g["__side"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    sorted_groups = whole.select("component", "__i", "__j", "__side", "node", "set").repartition("component", "__i", "__j").sortWithinPartitions("component", "__i", "__j", "node")
    true_links = sorted_groups.mapInArrow(links, "u long, v long")
    linked = components(true_links)
    of_class = same.select("id", "rep").distinct()
    # A key with several word sequences is one node: its classes are linked through it.
    shared = of_class.where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    repeats = of_class.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    if repeats:
        linked = components(true_links.unionByName(shared))
        ids = of_class.select("id", F.col("id").alias("root")).distinct()
    else:
        ids = of_class.select("id", F.col("rep").alias("root"))
    found = ids.join(linked.withColumnRenamed("node", "root"), "root", "left").select("id", F.coalesce("component", "root").alias("component_id"))
    out = signed.select("id", "n").join(found, "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` without rows whose group has a smaller key: one row of each group stays, or all that repeat its key. Null keys stay."""
    df_ = without(df, "__component")
    groups = near_groups(df_, key, text, **options).where(F.col("component_id") != F.col(key)).select(key).distinct()
    return df_.join(groups, key, "left_anti").select(*df_.columns)


def op10_near_dedup(documents: DataFrame) -> DataFrame:
    """Components of all documents by 4-word shingles of lower-cased texts, linked from resemblance 0.8."""
    out = near_groups(documents, shingle=4)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The same from every pair of texts that share a shingle.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reached AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT b.v, t.r FROM reached t JOIN both_ways b ON b.u = t.id),
c AS (SELECT id, min(r) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
