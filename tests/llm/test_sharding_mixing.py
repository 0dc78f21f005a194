import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm.mixing import mix_sources, op7_mixing, source_targets, word_count
from tidemill.llm.sharding import assign_shards, jump_hash, op3_sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 256, 10**12, *range(5, 200, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 7, 40, 1000):
        assert [r[1] for r in df.select("k", jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        jump_hash(F.col("k"), 0)


def _check_shards(rows):
    slots = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_documents(docs):
    rows = op3_sharding(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.shard == jump(r.doc_id, 40) and r.grown_shard == jump(r.doc_id, 41)
        assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    _check_shards(rows)


def test_shards_stay_inside_the_jvm(docs):
    plan = op3_sharding(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text_crc32" in plan


def test_shards_of_odd_rows(odd, empty):
    rows = op3_sharding(odd).collect()
    assert len(rows) == odd.count()
    assert {r.shard for r in rows if r.doc_id is None} == {jump(0, 40)} and {(r["size"], r.text_crc32) for r in rows if r.doc_id == 1} == {(16, 0)}
    assert len({r.shard for r in rows if r.doc_id == 8}) == 1
    _check_shards(rows)
    assert op3_sharding(empty).count() == 0
    again = assign_shards(odd.withColumn("Shard", F.lit("old")).withColumn("slot", F.lit("old")), 3)
    assert again.columns == [*odd.columns, "shard", "grown_shard", "slot"] and dict(again.dtypes)["slot"] == "bigint"


def _targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9), st.booleans())
def test_targets_are_filled_by_weight(spark, sizes, with_null):
    named = {f"s{i}": n for i, n in enumerate(sizes)} | ({None: 77} if with_null else {})
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(named.items()), "source string, source_size bigint")).collect()}
    want = _targets(named)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in got)


def _check_mix(docs):
    rows = op7_mixing(docs).collect()
    sources = defaultdict(int)
    for r in docs.collect():
        sources[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = _targets(sources)
    taken = defaultdict(int)
    by = defaultdict(set)
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by[(r.source_size, r.target)].add(r.doc_id)
    of = defaultdict(list)
    for r in docs.select("doc_id", "source").collect():
        of[r.doc_id].append(r.source)
    for r in rows:
        if len(set(of[r.doc_id])) == 1:
            s = of[r.doc_id][0]
            assert r.source_size == sources[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
            taken[s] += r.taken
    return taken, want, sources, rows


def test_mix_of_documents(docs):
    taken, want, _, rows = _check_mix(docs)
    assert len(rows) == docs.count() and all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op7_mixing(docs.repartition(7)).collect()))


def test_mix_of_odd_rows(spark, odd, empty):
    _, _, _, rows = _check_mix(odd)
    assert len(rows) == odd.count()
    assert op7_mixing(empty).count() == 0
    clash = mix_sources(odd.withColumn("taken", F.lit("x")), word_count(), F.col("doc_id"), whole=True)
    assert clash.columns == [*odd.columns, "size", "source_size", "target", "taken", "copies"]
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in clash.collect())
    nothing = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string").withColumn("source", F.lit("a"))
    assert {(r.taken, r.target) for r in op7_mixing(nothing).collect()} == {(0, 0.0)}
