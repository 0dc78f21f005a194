import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from tests.llm.conftest import SCHEMA
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check as check_packing
from tidemill.llm.packing import tokenizer_file
from tidemill.llm.quality import fit_quality, judge_quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out.append(docs)
    return out


def test_shape(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    counts = [d.count() for d in stages[:4]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_rejected_documents_go(spark, stages):
    trees = fit_quality(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r.doc_id for r in judge_quality(stages[0], trees).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept and 0 < len(kept) < stages[0].count()


def test_recurring_lines_go(stages):
    old = {r.doc_id: r.text for r in stages[1].collect()}
    want = brute_lines(list(old.values()))
    left = {d: t if t not in want else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(want[t])) for d, t in old.items()}
    got = {r.doc_id: r for r in stages[2].collect()}
    assert {d: r.text for d, r in got.items()} == {d: t for d, t in left.items() if t == old[d] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert want and all(r.n_chars == len(r.text) for r in got.values() if r.text != old[r.doc_id])


def test_one_of_each_group_stays(stages):
    u = brute([(r.doc_id, r.text) for r in stages[2].collect()], 5)
    assert {r.doc_id for r in stages[3].collect()} == {u.find(x) for x in u.up}


def test_mixed_whole_and_packed(stages):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in stages[3].collect()}
    copies = Counter(r.doc_id for r in stages[4].collect())
    total = sum(size[d] * n for d, n in copies.items())
    assert max(copies.values()) <= 2 and abs(total - 1.5 * sum(size.values())) <= len({r.source for r in stages[3].collect()}) * max(size.values())
    from tokenizers import Tokenizer

    check_packing(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()], Tokenizer.from_file(tokenizer_file()))


def test_run(spark, stages):
    got = cp.run(spark, FOLDER)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows(spark, request, which, tmp_path):
    docs = request.getfixturevalue(which)
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, FOLDER)
        # Each stage also gets the odd rows themselves, whatever the one before it kept.
        assert stage(spark, request.getfixturevalue(which), FOLDER).count() >= 0
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes


def test_registered(spark):
    import duckdb

    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    sql = e.oracle_sql()
    for n in names:
        if n in sql:
            df = e.queries()[n](spark, FOLDER)
            want = con.execute(sql[n]).df()
            assert sorted(df.columns) == sorted(want.columns)
            assert sorted(tuple(r) for r in df.collect()) == sorted(want[df.columns].itertuples(index=False, name=None))
