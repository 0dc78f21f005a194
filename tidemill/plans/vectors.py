"""Vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.vectors import nearest_of
from tidemill.plans.registry import connect, dialect, plan


def _queries(spark: SparkSession, sf_dir: str) -> list[tuple[int, list[float]]]:
    """Every row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id", "embedding").collect()
    return [(r[0], [float(x) for x in r[1]]) for r in rows]


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return next(v for i, v in _queries(spark, sf_dir) if i == 0)


def _knn(metric: str, where: str = "true", k: int = 10):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(where)
        return nearest_of(rows, _queries(spark, sf_dir), "vec_id", "embedding", k, metric).select(F.col("query").alias("q"), "vec_id", F.round("distance", 3).alias("d"))

    return run


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query in the dialect."""
    ranked = "SELECT vec_id, embedding <-> $1 AS d FROM embeddings ORDER BY d, vec_id LIMIT 10"
    return connect(spark, sf_dir, "embeddings").sql(f"SELECT t.vec_id, round(t.d, 3) AS d FROM ({ranked}) t", [_query(spark, sf_dir)])


def _distance(term: str) -> str:
    parts = "list_zip(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.v, lambda x: x::DOUBLE))"
    dot = f"list_sum(list_transform({parts}, lambda p: p[1] * p[2]))"
    l2 = f"sqrt(list_sum(list_transform({parts}, lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    norms = "sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.v, lambda x: x::DOUBLE * x::DOUBLE)))"
    return {"l2": l2, "ip": f"-({dot})", "cosine": f"1 - {dot} / ({norms})"}[term]


def _sql(term: str, where: str = "", k: int = 10) -> str:
    asked = "(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0) q"
    return f"SELECT q, vec_id, round(d, 3) AS d FROM (SELECT q.id AS q, e.vec_id, {_distance(term)} AS d FROM embeddings e, {asked} {where}) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, vec_id) <= {k}"


def _sql_one() -> str:
    return f"SELECT vec_id, round(d, 3) AS d FROM (SELECT e.vec_id, {_distance('l2')} AS d FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q ORDER BY d, e.vec_id LIMIT 10)"


def _join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_of(rows, _queries(spark, sf_dir), "vec_id", "embedding", within=1.2).select(F.col("query").alias("q"), "vec_id")


def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connect(spark, sf_dir, "embeddings").sql("SELECT vec_id FROM embeddings WHERE embedding <-> $1 < 1.2", [_query(spark, sf_dir)])


def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.functions.ann import build_index

    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return build_index(df, "vec_id", "embedding", "l2", cells=16).search(_query(spark, sf_dir), 10, probes=16).selectExpr("vec_id", "round(distance, 3) as d")


def recall(spark: SparkSession, sf_dir: str, metric: str = "l2", k: int = 10) -> tuple[int, float]:
    """(queries, recall at ``k``) of an index with the default settings, for all rows with ``vec_id % 50 = 0``, against all rows by brute force."""
    from tidemill.functions.ann import build_index

    df, queries = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _queries(spark, sf_dir)
    found = build_index(df, "vec_id", "embedding", metric).search_all(queries, k).select(F.col("query").alias("q"), "vec_id")
    return len(queries), _hits(df, queries, found, metric, k)


def _hits(df: DataFrame, queries: list, found: DataFrame, metric: str, k: int) -> float:
    true = nearest_of(df, queries, "vec_id", "embedding", k, metric).select(F.col("query").alias("q"), "vec_id")
    total, hit = true.count(), true.join(found, ["q", "vec_id"]).count()
    return hit / total if total else 1.0


def kept_recall(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[int, float]:
    """As ``recall``, of an index that a database keeps: built over half of the rows, then extended by INSERT, with rows deleted and changed since."""
    from tidemill.sources.scratch import scratch
    from tidemill.store.connection import Database

    c = Database(spark, scratch(spark, "store")).attach_parquet(sf_dir, "embeddings").connect()
    size = len(_query(spark, sf_dir))
    c.exec(
        f"CREATE TABLE v (vec_id INTEGER PRIMARY KEY, e VECTOR({size}), n INTEGER); INSERT INTO v SELECT vec_id, embedding, 0 FROM embeddings WHERE vec_id % 2 = 0; "
        "CREATE INDEX v_e ON v USING hnsw (e vector_l2_ops); INSERT INTO v SELECT vec_id, embedding, 0 FROM embeddings WHERE vec_id % 2 = 1; "
        "UPDATE v SET n = 1 WHERE vec_id % 100 = 1; DELETE FROM v WHERE vec_id % 100 = 3"
    )
    queries = _queries(spark, sf_dir)
    found = c.nearest_all("v", "e", queries, k, approximate=True).select(F.col("query").alias("q"), "vec_id")
    return len(queries), _hits(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 <> 3"), queries, found, "l2", k)


def _kept_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, reached = kept_recall(spark, sf_dir)
    return spark.range(1).select(F.lit(n).cast("long").alias("queries"), F.lit(reached >= 0.9).alias("reached"))


def _ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, reached = recall(spark, sf_dir)
    return spark.range(1).select(F.lit(n).cast("long").alias("queries"), F.lit(reached >= 0.9).alias("reached"))


def register() -> None:
    plan("knn_l2", _knn("l2"), _sql("l2"))
    plan("knn_cosine", _knn("cosine"), _sql("cosine"))
    plan("knn_ip", _knn("ip"), _sql("ip"))
    plan("knn_filtered", _knn("l2", "label = 3", 5), _sql("l2", "WHERE label = 3", 5))
    plan("knn_dialect", _one, _sql_one())
    plan("knn_ann_all_cells", _ann, _sql_one())
    plan("knn_ann_recall", _ann_recall, "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
    plan("knn_kept_index_recall", _kept_recall, "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
    plan("vec_distance_join", _join, "SELECT q.id AS q, e.vec_id FROM embeddings e, (SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0) q WHERE list_distance(e.embedding, q.v) < 1.2")
    plan("vec_distance_filter", _within, "SELECT e.vec_id FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q WHERE list_distance(e.embedding, q.v) < 1.2")
    dialect("vec_literal", "SELECT round([1, 2, 3] <-> '[1,2,5]', 6) AS l2, round([1, 0] <=> [0, 2], 6) AS cosine, [1, 2] <#> [3, 4] AS ip, [0, 0] <=> [1, 1] AS zero", "SELECT 2.0::DOUBLE AS l2, 1.0::DOUBLE AS cosine, -11.0::DOUBLE AS ip, 1.0::DOUBLE AS zero")
