"""Nearest rows for many queries at once, against every pair in numpy."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemill.functions import vectors
from tidemill.plans.registry import QUERIES


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_against_every_pair(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "BLOCK", 3)  # several blocks
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (200, 3)).astype(float)  # with ties
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id bigint, e array<float>").repartition(5)
    queries = [(i, x[i].tolist()) for i in range(0, 200, 25)]
    got = {}
    for r in vectors.nearest_of(df, queries, "id", "e", 6, metric).collect():
        got.setdefault(r["query"], []).append((round(r["distance"], 9), r["id"]))
    d = vectors._distances(metric, x, np.array([v for _, v in queries]))
    for j, (q, _) in enumerate(queries):
        want = sorted((round(float(d[i, j]), 9), i) for i in range(200))[:6]
        assert [a for a, _ in sorted(got[q])] == [a for a, _ in want] and (metric == "cosine" or sorted(got[q]) == want)
    near = {(r["query"], r["id"]) for r in vectors.nearest_of(df, queries, "id", "e", metric=metric, within=1.1).collect()}
    assert near == {(q, i) for j, (q, _) in enumerate(queries) for i in range(200) if d[i, j] < 1.1}


def test_odd_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, e array<float>")
    assert vectors.nearest_of(df, [], "id", "e").count() == 0 and vectors.nearest_of(df.limit(0), [(1, [1.0, 0.0])], "id", "e").count() == 0
    with pytest.raises(ValueError, match="metric"):
        vectors.nearest_of(df, [], "id", "e", metric="taxi")
    with pytest.raises(Exception, match="different sizes"):
        vectors.nearest_of(df, [(1, [1.0])], "id", "e").collect()


def test_join_at_its_bound(spark, tmp_path):
    """Pairs so near to 1.2 that single and double precision, or another order of summing, put them on different sides."""
    rng = np.random.default_rng(5)
    centre, away = np.repeat(rng.normal(size=(40, 64)), 50, axis=0), rng.normal(size=(2000, 64))
    x = centre + 1.2 * away / np.linalg.norm(away, axis=1)[:, None] * (np.arange(2000) % 50 > 0)[:, None]
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": np.arange(2000), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 2000, pa.int32())}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    query = QUERIES["vec_distance_join"]
    want = con.execute(query.sql).fetchall()
    assert 500 < len(want) < 1500 and sorted(map(tuple, query.run(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("size", [1, 3, 64, 257])
def test_single_precision_to_the_bit(size):
    x = np.random.default_rng(size).normal(size=(500, size)).astype(np.float32)
    kind = pa.list_(pa.float32())
    t = pa.table({"e": pa.array(x.tolist(), kind), "v": pa.array([x[0].tolist()] * 500, kind)})  # noqa: F841
    want = duckdb.connect().execute("SELECT list_distance(e, v) AS d FROM t").fetchnumpy()["d"]
    assert vectors._single_l2(x, x[0]).tobytes() == np.asarray(want, np.float32).tobytes()
