"""Stupid-backoff scores of documents, from n-gram counts of the whole corpus.

Documents are dealt with in slices of text. A slice explodes into its n-grams, 56-bit hashes counted once for each slice, which are
partitioned by hash range into buckets. A bucket sums the slices' counts into its part of the count tables and joins them back
to each slice's n-grams. A slice then has a count for each of its n-grams and sums its documents' scores.

The rows that move are packed arrays: for each slice, order and bucket the ascending hashes as differences in as few bytes as
they need; on the way back their counts. A frequent n-gram is one entry for each slice that holds it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import U64, WORD, checkpointed, hash_words, mix, slices, split_words, text_or_empty, trim, windows
from tidemill.llm.graph import grouped

ORDER, BACKOFF, LEAST_COUNT = 3, 0.4, 2
#: Bytes of text in a slice: a worker's memory is some ten times that.
SCORED_BYTES = 12 << 20
HASH_BITS = 56
#: Bytes of packed n-grams of one order in a bucket, about.
BUCKET_BYTES = 8 << 20


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as byte planes of their differences."""
    steps = np.diff(values, prepend=U64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=U64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, most of them small: a compressed byte each, and the larger ones in full."""
    large = counts > 254
    small = np.where(large, 255, counts).astype(np.uint8)
    return np.uint32(len(counts)).tobytes() + zlib.compress(small.tobytes() + counts[large].astype("<u8").tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    raw = zlib.decompress(data[4:])
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def gram_hashes(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(word offsets, for each length 1 to ``order`` the hashes of the n-grams of each text in order)."""
    offsets, codes, dictionary = split_words(texts)
    words = hash_words(dictionary, 1)[codes] if len(codes) else np.zeros(0, U64)
    grams = [mix(words + U64(1)) >> U64(64 - HASH_BITS)]
    grams += [windows(words, offsets, n, False)[1] >> U64(64 - HASH_BITS) for n in range(2, order + 1)]
    return offsets, grams


def slice_name(texts: pa.Array) -> str:
    """A slice is known by its content, so that a task that runs again finds its own counts."""
    digest = hashlib.blake2b(digest_size=16)
    for t in texts.to_pylist():
        raw = t.encode()
        digest.update(b"%d:" % len(raw))
        digest.update(raw)
    return digest.hexdigest()


def score_slice(offsets: np.ndarray, counts: list[np.ndarray], total: int, backoff: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(summed log score, words scored by the highest order) of each text; ``counts[n - 1]`` is the corpus count of each of its n-grams."""
    n_words = np.diff(offsets)
    texts = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
    place = np.minimum(np.arange(len(texts)) - np.repeat(offsets[:-1], n_words), len(counts)).astype(np.int8)
    history = np.minimum(place, len(counts) - 1)
    score = np.log(np.maximum(counts[0], 1)) - np.log(max(total, 1)) + history * np.log(backoff)
    top = np.zeros(len(texts), bool)
    for n in range(2, len(counts) + 1):
        # The i-th n-gram of a text ends at its word i + n - 1; its context is the (n-1)-gram that begins with it.
        ends = np.flatnonzero(place >= n - 1)
        shorter = np.flatnonzero(place >= n - 2)
        context = counts[n - 2][np.searchsorted(shorter, ends - 1)]
        seen = counts[n - 1] >= least
        at = ends[seen]
        score[at] = np.log(counts[n - 1][seen]) - np.log(np.maximum(context[seen], 1)) + (history[at] - (n - 1)) * np.log(backoff)
        if n == len(counts):
            top[at] = True
    sums = np.bincount(texts, score, len(n_words)).astype(float)  # of no words at all it is integers
    return sums, np.bincount(texts[top], minlength=len(n_words))


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", corpus: DataFrame | None = None, order: int = ORDER, backoff: float = BACKOFF, least_count: int = LEAST_COUNT) -> DataFrame:
    """(key, n_words, n_seen, log_score, mean_log_score) of each row of ``df``.

    A word's score is the count of the longest n-gram up to ``order`` that ends with it and occurs ``least_count`` times or more in the corpus, by
    its context's count, times ``backoff`` for each order given up; single words are scored by their count (1 at least) over all words.
    Histories don't cross texts. log_score sums natural logs; n_seen counts words scored by the highest order. The counts are those of all of
    ``corpus``, by default ``df`` itself; so an n-gram that only its own text holds once is no evidence for it. A null or wordless text has log_score 0 and
    a null mean. Repeated rows count, and are scored, as rows of their own; an empty table gives an empty one.
    """
    # Two passes meet slice by slice, so both must cut the same slices. Files are read in the same order whenever they are read;
    # what comes out of a shuffle is not, and is checkpointed first. Both passes take the same columns, so the same plan.
    rows = df.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = checkpointed(rows)
    texts = rows.select("text") if corpus is None else corpus.select(text_or_empty(text).alias("text"))
    size = lambda frame: frame.agg(F.sum(F.regexp_count("text", F.lit(WORD))), F.sum(F.octet_length("text").cast("long"))).first()
    total, n_bytes = (int(x or 0) for x in size(texts))
    n_bytes += int(size(rows)[1] or 0) if corpus is not None else 0
    # As many buckets as the text needs, whatever the session's partitions are: the packed n-grams of an order are about as large as the text.
    buckets = 1 << max(6, (-(-n_bytes // BUCKET_BYTES) - 1).bit_length())
    shift = U64(HASH_BITS - (buckets.bit_length() - 1))
    names = ["slice", "wanted", "counted", "order", "bucket", "grams", "counts"]

    def explode(wanted: bool, counted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(_joined(batches), "text", SCORED_BYTES):
                texts = b.column("text")
                name, (_, grams) = slice_name(texts), gram_hashes(texts, order)
                for n, all_grams in enumerate(grams, 1):
                    distinct, counts = _counted(all_grams)
                    edges = np.searchsorted(distinct, np.arange(1, buckets).astype(U64) << shift)
                    out = [(k, g, c) for k, (g, c) in enumerate(zip(np.split(distinct, edges), np.split(counts, edges), strict=True)) if len(g)]
                    for start in range(0, len(out), 32):
                        part = out[start : start + 32]
                        m = len(part)
                        columns = [pa.array([name] * m), pa.array([wanted] * m), pa.array([counted] * m), pa.array([n] * m, pa.int32()), pa.array([k for k, *_ in part], pa.int32()), pa.array([pack_sorted(g) for _, g, _ in part]), pa.array([pack_counts(c) for *_, c in part])]
                        yield pa.RecordBatch.from_arrays(columns, names)

        return run

    kinds = "slice string, wanted boolean, counted boolean, order int, bucket int, grams binary, counts binary"
    if corpus is None:
        packed = rows.mapInArrow(explode(True, True), kinds)
    else:
        packed = rows.mapInArrow(explode(True, False), kinds).unionByName(texts.mapInArrow(explode(False, True), kinds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["order", "bucket"]):
            # The same slice may come again where rows repeat: its counts add, and its answer is wanted once.
            hashes = [unpack_sorted(x) for x in g["grams"].to_pylist()]
            weights = [unpack_counts(x) * int(c) for x, c in zip(g["counts"].to_pylist(), g["counted"].to_pylist(), strict=True)]
            every = np.concatenate(hashes)
            order_ = np.argsort(every, kind="stable")
            ranked = every[order_]
            first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            sums = np.add.reduceat(np.concatenate(weights)[order_], np.flatnonzero(first))
            answer = np.empty(len(every), np.int64)
            answer[order_] = sums[np.cumsum(first) - 1]
            del every, ranked, order_, weights
            ends = np.cumsum([len(h) for h in hashes])
            done: set[str] = set()
            out = []
            for name, wanted, end, h in zip(g["slice"].to_pylist(), g["wanted"].to_pylist(), ends, hashes, strict=True):
                if wanted and name not in done:
                    done.add(name)
                    out.append((name, pack_counts(answer[end - len(h) : end])))
            n, k = g["order"][0].as_py(), g["bucket"][0].as_py()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out]), pa.array([n] * len(out), pa.int32()), pa.array([k] * len(out), pa.int32()), pa.array([c for _, c in out])], ["slice", "order", "bucket", "counts"])
        trim()

    dealt = packed.repartition(buckets, "order", "bucket").sortWithinPartitions("order", "bucket")
    answers = dealt.mapInArrow(count, "slice string, order int, bucket int, counts binary")

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(_joined(batches), "text", SCORED_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([slice_name(b.column("text"))]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "order", "bucket", "counts"])

    frames = rows.mapInArrow(frame, "slice string, order int, bucket int, counts binary")
    met = frames.unionByName(answers).repartition(max(12, 2 * n_bytes // SCORED_BYTES), "slice").sortWithinPartitions("slice", "order", "bucket")
    id_type = rows.schema["id"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["slice"]):
            orders, data = g["order"].to_numpy(), g["counts"].to_pylist()
            of_order = [np.concatenate([np.zeros(0, np.int64), *[unpack_counts(d) for o, d in zip(orders, data, strict=True) if o == n]]) for n in range(1, order + 1)]
            for o, d in zip(orders, data, strict=True):
                if o == 0:
                    b = pa.ipc.open_stream(d).read_next_batch()
                    offsets, grams = gram_hashes(b.column("text"), order)
                    counts = []
                    grams.reverse()
                    for answer in of_order:
                        # One length at a time, so that the others' hashes are gone or not yet ranked.
                        all_grams = grams.pop()
                        codes, distinct = pd.factorize(all_grams, sort=True)
                        if len(distinct) != len(answer):
                            raise RuntimeError("a slice's n-grams and its counts differ; the input has changed while it was read")
                        counts.append(answer[codes])
                        del all_grams, codes, distinct
                    sums, seen = score_slice(offsets, counts, total, backoff, least_count)
                    n_words = np.diff(offsets)
                    mean = pa.array(np.divide(sums, n_words, out=np.zeros(len(sums)), where=n_words > 0), mask=n_words == 0)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words), pa.array(seen.astype(np.int64)), pa.array(sums), mean], [key, "n_words", "n_seen", "log_score", "mean_log_score"])
                    del b, grams, counts
            del of_order, data
            trim()

    return met.mapInArrow(score, f"`{key}` {id_type.simpleString()}, n_words long, n_seen long, log_score double, mean_log_score double")


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, how often each occurs)."""
    ranked = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[first], np.diff(np.append(first, len(ranked)))


def _joined(batches: Iterator[pa.RecordBatch], most_bytes: int = SCORED_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``most_bytes``: larger slices share more n-grams."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if held and size + b.nbytes > most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def op1_lm_scoring(documents: DataFrame) -> DataFrame:
    """Scores of all documents by the trigrams of all documents, rounded to 6 decimals."""
    out = score_documents(documents)
    return out.select("doc_id", "n_words", "n_seen", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


#: The same by plain counting.
OP1_SQL = r"""
WITH w AS (
  SELECT d.doc_id, u.i AS i, u.w AS w
  FROM documents d, (SELECT 1) one,
  LATERAL (SELECT unnest(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'), 1) AS i) u
), g AS (
  SELECT doc_id, i, w AS w3, lag(w, 1) OVER o AS w2, lag(w, 2) OVER o AS w1 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT w3, count(*) AS n FROM g GROUP BY w3),
c2 AS (SELECT w2, w3, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY w2, w3),
c3 AS (SELECT w1, w2, w3, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY w1, w2, w3),
t AS (SELECT count(*)::DOUBLE AS n FROM g),
s AS (
  SELECT g.doc_id, CASE WHEN c3.n >= 2 THEN 1 ELSE 0 END AS seen,
    CASE WHEN c3.n >= 2 THEN ln(c3.n::DOUBLE) - ln(b.n::DOUBLE)
         WHEN c2.n >= 2 THEN ln(c2.n::DOUBLE) - ln(a.n::DOUBLE) + CASE WHEN g.w1 IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
         ELSE ln(c1.n::DOUBLE) - ln(t.n) + least(g.i - 1, 2) * ln(0.4::DOUBLE) END AS s
  FROM g CROSS JOIN t JOIN c1 ON c1.w3 = g.w3
  LEFT JOIN c1 a ON a.w3 = g.w2
  LEFT JOIN c2 ON c2.w2 = g.w2 AND c2.w3 = g.w3
  LEFT JOIN c2 b ON b.w2 = g.w1 AND b.w3 = g.w2
  LEFT JOIN c3 ON c3.w1 = g.w1 AND c3.w2 = g.w2 AND c3.w3 = g.w3
)
SELECT d.doc_id, count(s.s)::BIGINT AS n_words, coalesce(sum(s.seen), 0)::BIGINT AS n_seen,
  round(coalesce(sum(s.s), 0.0), 4) AS log_score, round(sum(s.s) / nullif(count(s.s), 0), 6) AS mean_log_score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
