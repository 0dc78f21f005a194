"""Recurring lines judged by the classes of near copies that hold them."""

import random

import pytest

from tests.llm.conftest import SCHEMA, words
from tidemill.llm import line_dedup as ld

FOOTERS = {n: [words(random.Random(100 * n + i), 6, 5000) for i in range(n)] for n in (2, 3)}


def dropped(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in ld.op9_line_dedup(df).collect()}
    return [[int(x) for x in rows[i].dropped_lines.split(",") if x] for i in range(len(texts))]


def unlike(rng, lines=4):
    return [words(rng, 15, 50_000) for _ in range(lines)]


@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("header", [False, True])
def test_fixed_headers_and_footers_of_several_lines_go(spark, n, header):
    rng = random.Random(n)
    texts = ["\n".join(FOOTERS[n] + unlike(rng) if header else unlike(rng) + FOOTERS[n]) for _ in range(12)]
    want = list(range(n)) if header else list(range(4, 4 + n))
    assert dropped(spark, texts) == [want] * 12


@pytest.mark.parametrize("holders", [2, 3, 4])
def test_passages_of_few_unlike_documents_go(spark, holders):
    rng = random.Random(20 + holders)
    one, several = words(rng, 60, 50_000), [words(rng, 15, 50_000) for _ in range(4)]
    texts = ["\n".join(unlike(rng, 2) + p + unlike(rng, 2)) for p in ([one], several) for _ in range(holders)]
    assert dropped(spark, texts) == [[2]] * holders + [[2, 3, 4, 5]] * holders


def test_two_near_copies_stay(spark):
    rng = random.Random(30)
    lines = [words(rng, 20, 50_000) for _ in range(6)]
    edited = [*lines[:2], lines[2] + " edited here", *lines[3:]]
    assert dropped(spark, ["\n".join(lines), "\n".join(edited), "\n".join(unlike(rng))]) == [[], [], []]


def test_a_large_group_of_near_copies_weighs_as_one(spark):
    rng = random.Random(40)
    common = words(rng, 12, 50_000)
    base = unlike(rng, 8)
    texts = ["\n".join([*unlike(rng), common]) for _ in range(30)]
    for i in range(200):
        lines = list(base)
        at = lines[i % 8].split()
        at[5 + i % 10] = words(rng, 1, 10**6)
        lines[i % 8] = " ".join(at)
        texts.append("\n".join([*lines, common]))
    assert dropped(spark, texts) == [[4]] * 30 + [[8]] * 200
