import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, duck, words
from tidemill.llm.common import WORD
from tidemill.llm import near_dedup as nd
from tidemill.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, n):
    w = re.findall(WORD, (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, n, percent=80):
    """Every pair of rows."""
    u = Union()
    sets = [(k, shingles(t, n)) for k, t in rows]
    by = defaultdict(list)
    for k, s in sets:
        if k is not None:
            u.find(k)
            for q in s:
                by[q].append((k, s))
    for k, s in sets:
        if k is not None and s:
            for other, t in {id(t): (o, t) for q in s for o, t in by[q]}.values():
                common = len(s & t)
                if 100 * common >= percent * (len(s) + len(t) - common):
                    u.join(k, other)
    return u


def check(df, n=4, **options):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    u = brute(rows, n)
    got = (nd.op10_near_dedup(df) if not options else nd.near_groups(df, shingle=n, **options)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted((k is None, k or 0, len(shingles(t, n))) for k, t in rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else u.find(r.doc_id))
    return got


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_components(spark, edges):
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.component for r in got} == {x: u.find(x) for x in list(u.up)} and len(got) == len(u.up)


def test_long_path_and_no_edges(spark):
    path = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert components(path).groupBy("component").count().collect()[0]["count"] == 301
    assert components(path.limit(0)).count() == 0


def test_pigeonhole():
    """Signatures within the distance share a key, wherever the errors are."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (300, nd.SYMBOLS)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(nd.SYMBOLS, nd.MOST_ERRORS, replace=False)
        row[at] ^= 1
    shared = (nd.bucket_keys(a) == nd.bucket_keys(b)).any(axis=1)
    assert shared.all()
    masks = nd.chunk_masks(12, 5, 1)
    assert len(masks) == 12 and all(len(m) == 3 for m in masks)
    assert not (nd.bucket_keys(a) == nd.bucket_keys(np.roll(a, 1, axis=0))).any()


def test_signature_distance_follows_resemblance():
    rng = random.Random(4)
    base = words(rng, 500, 10_000).split()
    other = base[:400] + words(rng, 100, 10_000).split()
    sets, h1, h2 = nd.shingle_sets(pa.array([" ".join(base), " ".join(other), " ".join(base).upper()]), 5, True)
    j = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    differ = (nd.signature(sets[0]) != nd.signature(sets[1])).mean()
    assert abs(differ - (1 - j)) < 0.2 and h1[0] == h1[2] and h2[0] == h2[2] and h1[0] != h1[1]
    assert np.array_equal(nd.signature(sets[0]), nd.signature(sets[2]))


def test_documents(docs):
    check(docs)


def test_sql_gives_the_same(docs):
    want = duck().execute(nd.OP10_SQL).fetchall()
    assert sorted(tuple(r) for r in nd.op10_near_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()) == sorted(want)


def test_no_link_is_lost_in_a_group():
    """Texts of one candidate group are judged by their full sets, however far their signatures are."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k : 900 - 40 * (k % 3)], rng.integers(0, 2**64, 60 + k, dtype=np.uint64)])) for k in range(0, 120, 3)] + [np.zeros(0, np.uint64), base[:1], base[:1]]
    u, v = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = nd.Sets(sets, 80).linked(u, v)
    want = [len(b := set(sets[j].tolist())) > 0 and 100 * len(a & b) >= 80 * len(a | b) > 0 for i, j in zip(u, v, strict=True) for a in [set(sets[i].tolist())]]
    assert got.tolist() == want and any(want) and not all(want)


def test_odd_rows(odd, empty):
    got = {r.doc_id: r for r in check(odd) if r.doc_id not in (None, 8)}
    assert got[5].component_id == got[6].component_id == got[7].component_id == 5 and not got[7].kept
    assert got[2].component_id == 2 and got[3].component_id == 3 and got[1].n_shingles == 0
    assert nd.op10_near_dedup(empty).count() == 0


@pytest.fixture(scope="module")
def family(spark):
    """A large group of near copies of all degrees, a chain, exact copies and short texts."""
    rng = random.Random(9)
    base = words(rng, 120, 5000).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    chain = list(base)[::-1]
    for i in range(40):
        chain = [*chain[4:], *words(rng, 4, 10**6).split()]
        rows.append((2000 - i, " ".join(chain)))
    rows += [(3000 + i, "the same words in this text " * 20) for i in range(50)] + [(4000 + i, f"short {i % 3}") for i in range(9)]
    rng.shuffle(rows)
    return spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], SCHEMA)


def test_family(family):
    check(family)


def test_blocks_lose_nothing(family):
    check(family, block=16)


def test_five_words_and_dropping(family, odd, empty):
    check(family, n=5, percent=80)
    u = brute([(r.doc_id, r.text) for r in family.collect()], 5)
    kept = {r.doc_id for r in nd.drop_near_duplicates(family).collect()}
    assert kept == {u.find(x) for x in u.up}
    assert nd.drop_near_duplicates(odd).columns == odd.columns and nd.drop_near_duplicates(odd).where("doc_id is null").count() == 2
    assert nd.drop_near_duplicates(empty).count() == 0
    assert nd.near_groups(family.withColumn("component_id", F.lit("x"))).columns == ["doc_id", "n_shingles", "component_id"]
