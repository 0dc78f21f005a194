"""Quality rules: base rules and gradient-boosted trees over document statistics.

The trees are trained here, on a bounded sample of labelled rows, with monotonic constraints on chosen statistics, and are
flattened into numpy node arrays, so that a batch of documents walks all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import extended, slices, split_words, text_or_empty, without

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic -> the direction in which the score may move with it: 1 up, -1 down, 0 free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 0,
    "bar_per_word": -1,
    "shout_per_word": -1,
    "upper_share": -1,
    "digit_share": 0,
    "stop_share": 0,
    "comma_share": 0,
    "line_words": 0,
}
#: Labelled rows that a fit takes at most: those with the smallest keyed hash of their id.
MOST_LABELLED = 20_000


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a string array."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _table(characters: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(characters)] = 1
    return out


_SPACE, _SYMBOL = _table(b" \t\n\v\f\r"), _table(SYMBOLS)
_LEAD = 1 - _table(range(0x80, 0xC0))
_BAR, _SHOUT, _STOP, _COMMA = _table(b"|"), _table(b"!"), _table(b".?"), _table(b",;")
_UPPER, _DIGIT = _table(range(65, 91)), _table(range(48, 58))


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(counts, features): the base counts of each text, and a row of ``FEATURES``. A null text counts as empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets, data = _bytes(texts)
    word_offsets, codes, dictionary = split_words(texts)
    n_words = np.diff(word_offsets)
    count = lambda lut: _per_text(lut[data], offsets)
    word_chars = count(_LEAD) - count(_SPACE)

    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat = lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    line_codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_keys = (line_doc * (len(flat) + 1) + line_codes)[full]
    n_lines = np.bincount(line_doc[full], minlength=n)
    distinct_lines = np.bincount(pd.unique(line_keys) // (len(flat) + 1), minlength=n) if len(line_keys) else np.zeros(n, np.int64)

    word_doc = np.repeat(np.arange(n), n_words)
    covered = np.zeros(len(codes), bool)
    if len(codes) > 2:
        at = np.flatnonzero(word_doc[:-2] == word_doc[2:])
        pairs = pd.factorize(codes[at] * len(dictionary) + codes[at + 1])[0].astype(np.int64)
        triples = pd.factorize(pairs * len(dictionary) + codes[at + 2])[0].astype(np.int64)
        keys = pd.factorize(triples * n + word_doc[at])[0]
        again = at[np.bincount(keys)[keys] > 1] if len(keys) else at
        for j in range(3):
            covered[again + j] = True
    n_repeat = _per_text(covered, word_offsets)
    distinct = np.bincount(pd.unique(word_doc * max(1, len(dictionary)) + codes) // max(1, len(dictionary)), minlength=n) if len(codes) else np.zeros(n, np.int64)

    counts = dict(zip(COUNTS, (n_words, word_chars, count(_SYMBOL), n_lines - distinct_lines, n_repeat), strict=True))
    words, chars, line_count = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    features = np.column_stack(
        [
            np.log1p(n_words),
            word_chars / words,
            counts["n_symbols"] / words,
            counts["n_dup_lines"] / line_count,
            n_repeat / words,
            distinct / words,
            count(_BAR) / words,
            count(_SHOUT) / words,
            count(_UPPER) / chars,
            count(_DIGIT) / chars,
            count(_STOP) / words,
            count(_COMMA) / words,
            n_words / line_count,
        ]
    ).astype(np.float64)
    return {k: v.astype(np.int64) for k, v in counts.items()}, features


@dataclass
class Trees:
    """Boosted trees as flat node arrays; node ``i`` of a leaf has feature -1. ``roots`` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row. A missing statistic goes left."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[row, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(inner, np.where(right, self.right[at], self.left[at]), at)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least_weight: float = 1.0
) -> Trees:
    """Second-order boosting of the logistic loss on binned statistics.

    A split against a feature's direction is refused, and children inherit the mid-point of a constrained split as a bound on
    their values, so the whole score is monotonic in that feature. Without both classes the score is constant.
    """
    y = np.asarray(y, float)
    rate_of = min(max(y.mean() if len(y) else 1.0, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    nodes: list[list[float]] = []
    roots = []
    if len(np.unique(y)) > 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        margin = np.full(len(y), base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(nodes))
            nodes.append([-1, 0, 0, 0, 0])
            work = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
            while work:
                node, rows, low, high, level = work.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                weight = float(np.clip(-gs / (hs + l2), low, high))
                best = (1e-6, None)
                for f in range(x.shape[1]) if level < depth else ():
                    size = len(cuts[f]) + 1
                    if size < 2:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                    gr, hr = gs - gl, hs - hl
                    wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                    gain = -(gl * wl + (hl + l2) * wl**2 / 2) - (gr * wr + (hr + l2) * wr**2 / 2) + (gs * weight + (hs + l2) * weight**2 / 2)
                    ok = (hl >= least_weight) & (hr >= least_weight) & (directions[f] * (wr - wl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, wl[k], wr[k]))
                if best[1] is None:
                    nodes[node][4] = rate * weight
                    margin[rows] += rate * weight
                    continue
                f, k, wl, wr = best[1]
                middle = (wl + wr) / 2
                left_high, right_low = (middle, middle) if directions[f] > 0 else (high, low)
                left_low, right_high = (middle, middle) if directions[f] < 0 else (low, high)
                nodes[node][:4] = [f, float(cuts[f][k]), len(nodes), len(nodes) + 1]
                nodes += [[-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]
                goes = binned[rows, f] <= k
                work += [(len(nodes) - 2, rows[goes], left_low, left_high, level + 1), (len(nodes) - 1, rows[~goes], right_low, right_high, level + 1)]
    else:
        roots, nodes = [0], [[-1, 0, 0, 0, 0]]
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), base, depth)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        _, x = text_statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def fit_quality(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, **options) -> Trees:
    """Trees for ``quality`` from ``most_labelled`` labelled rows at most, a bound on what is broadcast and collected.

    The rows are those with the smallest keyed hash of doc_id, so any run takes the same ones. Labels that are
    null or without a document are left out; without labels every score is the same and passes.
    """
    order = F.xxhash64("doc_id", F.lit("quality"))
    picked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().orderBy(order, "doc_id", "quality").limit(most_labelled)
    rows = documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    got = rows.select("doc_id", "text", "quality").mapInArrow(_labelled, "doc_id long, quality int, x array<double>").orderBy(order, "doc_id", "quality", "x").limit(most_labelled).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit_trees(x, (got["quality"].to_numpy() > 0).astype(float), list(FEATURES.values()), **options)


def judge_quality(df: DataFrame, trees: Trees, least_score: float = 0.5, least_words: int = 50, most_repeat_percent: int = 50, text: str = "text") -> DataFrame:
    """``df`` with the base counts, ``base_failed``, ``score`` and ``kept``.

    base_failed: fewer than ``least_words`` words, or over ``most_repeat_percent`` % of the words in repeated windows.
    kept: not base_failed, and the trees' score is ``least_score`` or more. Null text counts as empty and fails. Whole texts
    are read; columns of the same names are replaced. No shuffle.
    """
    df = without(df, *COUNTS, "base_failed", "score", "kept")
    names, at = df.columns, df.columns.index(text)
    schema = extended(df, **dict.fromkeys(COUNTS, "long"), base_failed="boolean", score="double", kept="boolean")
    bound = trees

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, names[at]):
            counts, x = text_statistics(b.column(at))
            failed = (counts["n_words"] < least_words) | (100 * counts["n_repeat_words"] > most_repeat_percent * counts["n_words"])
            score = bound.score(x)
            columns = [*b.columns, *(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least_score))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *COUNTS, "base_failed", "score", "kept"])

    return df.mapInArrow(judge, schema)


def op2_quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every document."""
    judged = judge_quality(documents.select("doc_id", "text"), fit_quality(documents, labels))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "score")
