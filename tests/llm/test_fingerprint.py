import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemill.llm.common import WORD
from tidemill.llm import fingerprint as fp


def shingles(text, n=5):
    w = re.findall(WORD, text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_small_texts_are_exact():
    texts = ["", " ", "a", "a b c d", "a b c d e", "a b c d e f a b c d e f", "f e d c b a"]
    s = fp.sketches(pa.array(texts))
    for i, a in enumerate(texts):
        assert len(s[i]) == len(shingles(a)) == fp.distinct_count(s[i])
        for j, b in enumerate(texts):
            A, B = shingles(a), shingles(b)
            assert fp.resemblance(s[i], s[j]) == (len(A & B) / len(A | B) if A | B else 1.0)


def test_estimates_and_merging():
    rng = random.Random(1)
    parts = [words(rng, 3000, 50_000) for _ in range(3)]
    a, b = parts[0] + " " + parts[1], parts[1] + " " + parts[2]
    sa, sb, s1 = fp.sketches(pa.array([a, b, parts[1]]))
    A, B = shingles(a), shingles(b)
    assert abs(fp.resemblance(sa, sb) - len(A & B) / len(A | B)) < 0.1
    assert abs(fp.containment(s1, sa) - 1) < 0.1 and abs(fp.distinct_count(sa) / len(A) - 1) < 0.2
    merged = fp.merge(sa, sb)
    assert len(merged) == fp.K and np.array_equal(fp.merge(merged, sa), merged) and abs(fp.distinct_count(merged) / len(A | B) - 1) < 0.2
    assert np.array_equal(fp.decode(fp.encode(sa)), sa)
    repeated = fp.sketches(pa.array([" ".join([parts[0]] * 5)]))[0]
    assert len(repeated) == fp.K


def check(df):
    rows = [r for r in fp.op8_fingerprints(df).collect()]
    order = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in rows) == sorted((d is None, d or 0, len(t)) for d, t in order)
    assert len({(r.n_chars, r.fingerprint) for r in rows}) <= len({t for _, t in order})
    return rows, order


@pytest.mark.parametrize("parts", [1, 6])
def test_documents(docs, parts):
    rows, order = check(docs.repartition(parts))
    by = {r.doc_id: r for r in rows}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        e = fp.edited(t, following)
        st_, se, sn = fp.sketches(pa.array([t, e, following]))
        r = by[d]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.fingerprint == fp.encode(st_) and r.edited_fingerprint == fp.encode(se)
        assert r.near_edited == fp.resemblance(st_, se) and r.near_next == fp.resemblance(st_, sn)


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert fp.op8_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(7, "abcd")], "doc_id bigint, text string")
    assert fp.op8_fingerprints(one).collect()[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "doc_id bigint, text string")
    assert fp.op8_fingerprints(nulls).count() == 2
    assert fp.edited("abc", "") == "ab" and fp.edited("🙂é", "xyz") == "🙂x"
    out = fp.add_fingerprints(odd.withColumn("Fingerprint", F.lit(0)))
    assert out.columns == [*odd.columns, "fingerprint", "n_shingles"] and out.count() == odd.count()
