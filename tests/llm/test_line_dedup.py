import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, words
from tidemill.llm import line_dedup as ld

LICENCE = "Copyright {} by {} and friends, all rights are reserved here"


def masked(line):
    return tuple("*" if re.search(ld.VARIABLE, w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))


def groups(n, links):
    """The smallest number reachable from each of n by the pairs that ``links`` accepts."""
    label = list(range(n))
    for a, b in combinations(range(n), 2):
        if label[a] != label[b] and links(a, b):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


def brute(texts):
    """The numbers of the lines that go, for each text: every pair of lines of a leaf, and of texts, is compared on its tokens."""
    texts = list(dict.fromkeys(x for x in texts if x is not None))
    lines = [[(i, w) for i, line in enumerate(t.split("\n")) if len(w := masked(line)) >= ld.LEAST_TOKENS and set(w) != {"*"}] for t in texts]
    leaves = {}
    for own in lines:
        for _, w in own:
            leaves.setdefault((len(w), w[: ld.DEPTH]), {})[w] = None
    template = {}
    for (n, _), variety in leaves.items():
        ws = list(variety)
        for w, k in zip(ws, groups(len(ws), lambda a, b, ws=ws, n=n: sum(x == y for x, y in zip(ws[a], ws[b], strict=True)) >= ld.SIMILARITY * n - 1e-9), strict=True):
            template[w] = (n, ws[k])
    shingles = []
    for t in texts:
        w = masked(t)
        shingles.append({w[i : i + ld.SHINGLE] for i in range(max(1, len(w) - ld.SHINGLE + 1))} if w else set())
    copy = groups(len(texts), lambda a, b: len(shingles[a] & shingles[b]) >= 0.625 * len(shingles[a] | shingles[b]) > 0)
    holders = {}
    for k, own in enumerate(lines):
        for _, w in own:
            holders.setdefault(template[w], set()).add(k)
    again = {t for t, ks in holders.items() if len(c := {copy[k] for k in ks}) >= ld.LEAST_DOCUMENTS and len(c) * ld.TEXTS_A_CLASS > len(ks)}
    return {t: gone for t, own in zip(texts, lines, strict=True) if (gone := [i for i, w in own if template[w] in again])}


def check(df):
    texts = [r.text for r in df.collect()]
    want = brute(texts)
    rows = ld.drop_recurring_lines(df).collect()
    assert len(rows) == len(texts)
    left = lambda t: t if t is None or t not in want else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(want[t]))
    assert sorted(((d is None, d or 0), t is None, t or "") for d, t in ((r.doc_id, r.text) for r in rows)) == sorted(((d is None, d or 0), left(t) is None, left(t) or "") for d, t in ((r.doc_id, r.text) for r in df.collect()))
    assert all(list(r.dropped) == sorted(set(r.dropped)) for r in rows)
    return rows


def test_documents(docs):
    assert any(r.dropped for r in check(docs))


@pytest.fixture(scope="module")
def boiler(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lines = [words(rng, rng.randrange(3, 30), 5000) for _ in range(5)]
        lines.insert(rng.randrange(6), LICENCE.format(1990 + i % 20, f"someone{i}"))
        if i % 4 == 0:
            lines.insert(rng.randrange(6), "Read  more\tabout this")
        rows.append("\n".join(lines))
    copied = "\n".join(words(rng, 12, 5000) for _ in range(6))
    rows += [copied] * 30 + [copied.replace(copied.split()[20], "edited", 1) + f"\nlast {words(rng, 3, 10**6)}" for _ in range(3)]
    passage = words(rng, 70, 5000)
    rows += [words(rng, 20, 5000) + "\n" + passage + "\n" + words(rng, 9, 5000) for _ in range(12)]
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(rows)], SCHEMA)


def test_boilerplate_goes_and_copies_stay(boiler):
    for r in check(boiler):
        if r.doc_id < 60:
            assert "Copyright" not in r.text and "Read  more" not in r.text and len(r.dropped) == 1 + (r.doc_id % 4 == 0)
        elif r.doc_id < 93:
            assert not r.dropped
        else:
            assert list(r.dropped) == [1] and r.n_lines == 3


@pytest.mark.parametrize("lines", [1, 3, 10])
def test_every_line_of_a_block_in_many_documents_goes(spark, lines):
    rng = random.Random(lines)
    block = [words(rng, 4 + i % 7, 5000) for i in range(lines)]
    texts = ["\n".join([words(rng, 20, 50_000), *block, words(rng, 20, 50_000)]) for _ in range(200)]
    rows = ld.drop_recurring_lines(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert all(list(r.dropped) == list(range(1, lines + 1)) for r in rows)


@pytest.mark.parametrize("leaf_lines", [ld.LEAF_LINES, 3])
def test_names_are_variable_fields(spark, leaf_lines):
    """A name as third, fourth or later word, one to three words that no text shares; also where a leaf is dealt to many tasks."""
    rng = random.Random(50)
    name = lambda n: words(rng, n, 10**7)
    rows = [(i, "\n".join([words(rng, 15, 50_000), *own, words(rng, 15, 50_000)]), "en", "a", 1) for i, own in enumerate(
        [[f"This page was written by {name(1)} for readers of the paper", f"Copyright 20{i:02d} by {name(2)} and friends, all rights are reserved here", f"See also {name(3)} and whatever else they wrote about the same matter there"] for i in range(20)]
    )]
    out = ld.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA), leaf_lines=leaf_lines).collect()
    assert all(list(r.dropped) == [1, 2, 3] for r in out)


def test_one_changed_word_in_a_long_line(spark):
    rng = random.Random(51)
    line = words(rng, 60, 50_000).split()
    rows = []
    for i in range(6):
        own = list(line)
        for at in range(3 + i, 60, 8):  # seven or eight changed words, far apart; two lines differ in sixteen
            own[at] = words(rng, 1, 10**7)
        rows.append((i, "\n".join([words(rng, 20, 50_000), " ".join(own), words(rng, 20, 50_000)]), "en", "a", 1))
    out = ld.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(list(r.dropped) == [1] for r in out)
    assert len(brute([r[1] for r in rows])) == 6


def test_what_is_no_template(spark):
    rng = random.Random(52)
    rows = [(i, f"{words(rng, 20, 50_000)}\n12 34 56\nword\n\nnot one {words(rng, 2, 10**7)}\n{words(rng, 20, 50_000)}", "en", "a", 1) for i in range(10)]
    assert all(not r.dropped for r in ld.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect())


def test_odd_rows(odd, empty):
    rows = check(odd)
    assert sum(r.text is None for r in rows) == 2 and {r.n_lines for r in rows if r.text is None} == {0}
    assert ld.op9_line_dedup(empty).count() == 0
    clash = ld.drop_recurring_lines(odd.withColumn("Dropped", F.lit(1)).withColumn("line", F.lit("x")).withColumn("leaf", F.lit("y")))
    assert clash.columns == [*odd.columns, "line", "leaf", "n_lines", "dropped"] and clash.count() == odd.count()


@pytest.mark.parametrize("n", [2, 3, 4, 7, 20, 41])
def test_templates_of_leaves(n):
    """Against all pairs, in several leaves at once, with runs longer than those compared by pairs."""
    rng = np.random.default_rng(n)
    leaf = rng.integers(0, 3, 400)
    base = rng.integers(0, 4, (3, n))
    tokens = np.where(rng.random((400, n)) < 0.25, rng.integers(0, 60, (400, n)), base[leaf]).astype(np.uint16)
    tokens[:, : ld.DEPTH] = leaf[:, None]
    want = groups(400, lambda a, b: leaf[a] == leaf[b] and (tokens[a] == tokens[b]).sum() >= ld.SIMILARITY * n - 1e-9)
    assert ld.Leaves(leaf.astype(np.int64), tokens.ravel(), np.arange(401) * n).templates().tolist() == want


def test_signatures_estimate_resemblance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2250], rng.integers(0, 2**64, 750, dtype=np.uint64)])
    few = a[:5]
    s = ld.text_signatures(np.concatenate([a, b, few, few[::-1]]), np.array([0, 3000, 6000, 6005, 6010]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15 and (s[2] == s[3]).all() and (s[0] == s[2]).mean() < 0.1
    assert len(ld.line_templates(pa.array(["", None, " \n "]))["row"]) == 0
