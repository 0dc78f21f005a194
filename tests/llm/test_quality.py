import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm.quality import COUNTS, FEATURES, fit_quality, fit_trees, judge_quality, op2_quality_rules, text_statistics


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_counts_are_exact(request, which):
    texts = [r.text for r in request.getfixturevalue(which).collect()]
    counts, x = text_statistics(pa.array(texts, pa.string()))
    assert list(zip(*(counts[c].tolist() for c in COUNTS))) == [counted(t) for t in texts]
    assert np.isfinite(x).all() and x.shape == (len(texts), len(FEATURES))


def test_repeats():
    for text in ("a b c a b c", "a a a a", "x\nx\ny\nx", " \n \nx", "a b\na b\n", "", "a b c d\x0b\x0ca b c"):
        counts, _ = text_statistics(pa.array([text, "a b c", text]))
        assert [tuple(int(counts[c][i]) for c in COUNTS) for i in (0, 2)] == [counted(text)] * 2


def test_trees_learn_and_obey_directions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + 0.3 * rng.normal(size=3000) > 0).astype(float)
    trees = fit_trees(x[:2000], y[:2000], [1, 0, -1])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    grid = np.repeat(x[:50], 40, axis=0)
    for feature, sign in ((0, 1), (2, -1)):
        moved = grid.copy()
        moved[:, feature] = np.tile(np.linspace(-4, 4, 40), 50)
        steps = np.diff(trees.raw(moved).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all()
    assert np.allclose(fit_trees(x[:5], np.ones(5), [0, 0, 0]).score(x[:2]), 0.999)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    trees = fit_quality(documents, labels.where("doc_id % 2 = 0"))
    judged = judge_quality(documents, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in judged) / len(judged) > 0.95


def test_verdicts(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (None, 0, 0), (10, 0, 1), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = op2_quality_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert op2_quality_rules(empty, labels).count() == 0
    assert op2_quality_rules(odd, labels.limit(0)).where("kept").count() > 0
    clash = judge_quality(odd.withColumn("Score", F.lit("x")).withColumn("extra", F.lit(1)), fit_quality(odd, labels))
    assert clash.columns == [*odd.columns, "extra", *COUNTS, "base_failed", "score", "kept"] and clash.count() == odd.count()
    sampled = fit_quality(odd, labels, most_labelled=1)
    assert np.isfinite(sampled.base)
