import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import lm_scoring as lm


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute(texts, corpus, order=3, backoff=0.4, least=2):
    counts = Counter(g for t in corpus for n in range(1, order + 1) for g in grams(t, n))
    total = sum(len(grams(t, 1)) for t in corpus)
    out = []
    for t in texts:
        w = [g[0] for g in grams(t, 1)]
        score, top = 0.0, 0
        for i in range(len(w)):
            most = min(i + 1, order)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log(max(counts[g], 1)) - math.log(max(total, 1)) + (most - 1) * math.log(backoff)
                elif counts[g] >= least:
                    score += math.log(counts[g]) - math.log(max(counts[g[:-1]], 1)) + (most - n) * math.log(backoff)
                    top += n == order
                    break
        out.append((len(w), top, score))
    return out


def check(df, corpus=None, **options):
    rows = df.collect()
    want = brute([r.text for r in rows], [r.text for r in (corpus or df).collect()], **options)
    names = {"least": "least_count"}
    got = lm.score_documents(df, corpus=corpus, **{names.get(k, k): v for k, v in options.items()}).collect()
    key = lambda d, n, top, s: (d is None, d or 0, n, top, round(s, 5))
    assert sorted(key(r.doc_id, r.n_words, r.n_seen, r.log_score) for r in got) == sorted(key(r.doc_id, *w) for r, w in zip(rows, want, strict=True))
    assert all((r.mean_log_score is None) == (r.n_words == 0) and (r.n_words == 0 or abs(r.mean_log_score - r.log_score / r.n_words) < 1e-9) for r in got)
    return got


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_documents(docs, order):
    check(docs, order=order)


def test_slices_agree(docs, monkeypatch):
    monkeypatch.setattr(lm, "SCORED_BYTES", 20_000)
    check(docs.repartition(5))


def test_another_corpus(docs):
    check(docs.where("doc_id < 20"), corpus=docs.where("doc_id >= 20"), least=1, backoff=0.2)


def test_odd_rows(odd, empty):
    check(odd)
    assert lm.op1_lm_scoring(empty).count() == 0
    assert {(r.n_words, r.log_score) for r in lm.score_documents(odd, corpus=empty).collect() if r.n_words} and lm.score_documents(odd.withColumn("slice", F.lit(1))).count() == odd.count()


def test_repeated_slices(spark):
    df = spark.createDataFrame([(i % 3, "the same text again and again", "en", "a", 1) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(8)
    check(df)


@given(st.lists(st.integers(0, 2**56 - 1), max_size=60), st.lists(st.integers(0, 2**40), max_size=60))
def test_codecs(values, counts):
    v = np.unique(np.array(values, np.uint64))
    assert np.array_equal(lm.unpack_sorted(lm.pack_sorted(v)), v) and lm.unpack_counts(lm.pack_counts(np.array(counts, np.int64))).tolist() == counts
