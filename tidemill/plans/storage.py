"""Row-level security, data changes, branches, versions, snapshots and embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.registry import plan


def _store(spark: SparkSession, sf_dir: str, *names: str):
    from tidemill.sources.scratch import scratch
    from tidemill.store.connection import Database

    return Database(spark, scratch(spark, "store")).attach_parquet(sf_dir, *names).connect()


def _stored(name: str, script: str, query: str, sql: str, *sources: str) -> None:
    """Register the rows of ``query`` after a script over a new store."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _store(spark, sf_dir, *sources)
        c.exec(script)
        return c.sql(query)

    plan(name, run, sql)


def _secured(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _store(spark, sf_dir, "orders", "customer")
        c.exec(
            "CREATE TABLE mine (id INTEGER PRIMARY KEY, owner INTEGER, status TEXT, price REAL); "
            "INSERT INTO mine SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders; "
            "ALTER TABLE mine ENABLE ROW LEVEL SECURITY; "
            "CREATE POLICY finals ON mine FOR SELECT TO reader USING (status = 'F'); "
            "CREATE POLICY own ON mine FOR ALL TO reader USING (owner = auth.uid()::int); "
            "SET ROLE reader; SET request.jwt.claims = '{\"sub\": \"7\"}'"
        )
        return c.sql(query)

    return run


def _denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _store(spark, sf_dir, "nation")
    c.exec("CREATE TABLE hidden (id INTEGER PRIMARY KEY); INSERT INTO hidden SELECT n_nationkey FROM nation; ALTER TABLE hidden ENABLE ROW LEVEL SECURITY")
    return c.sql("SELECT count(*) AS n FROM hidden")


def _branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _store(spark, sf_dir, "nation")
    c.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    b = c.create_branch("trial")
    b.exec("DELETE FROM t WHERE id % 2 = 0; UPDATE t SET name = 'B' || id WHERE id = 1")
    c.exec("INSERT INTO t VALUES (100, 'main')")
    return c.sql("SELECT 'main' AS branch, id, name FROM t").unionByName(b.sql("SELECT 'trial' AS branch, id, name FROM t"))


def _past(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _store(spark, sf_dir, "region")
    c.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT); INSERT INTO t SELECT r_regionkey, r_name FROM region")
    then = c.last_version
    c.exec("DELETE FROM t WHERE id > 1")
    return c.db.connect(version=then).sql("SELECT 'then' AS at, id FROM t").unionByName(c.sql("SELECT 'now' AS at, id FROM t"))


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.plans.registry import connect
    from tidemill.sources.export import materialize
    from tidemill.sources.scratch import scratch

    path = materialize(connect(spark, sf_dir, "events"), "events", scratch(spark, "export"), ["event_id", "event_type", "value"])
    return spark.read.parquet(path)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.plans.registry import connect
    from tidemill.sources.export import materialize
    from tidemill.sources.scratch import scratch

    path = materialize(connect(spark, sf_dir, "part"), "part", scratch(spark, "export"), ["p_partkey", "p_name", "p_retailprice"], "csv")
    return spark.read.csv(path, header=True, schema="p_partkey bigint, p_name string, p_retailprice double")


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.embed import embed_one

    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return embed_one(n.select("n_nationkey", "n_regionkey"), r, {"n_regionkey": "r_regionkey"}, ["r_regionkey", "r_name"], "region").drop("n_regionkey")


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.operators.embed import embed_many

    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return embed_many(r, n, {"r_regionkey": "n_regionkey"}, ["n_nationkey", "n_name"], "nations", ["n_nationkey"])


def register() -> None:
    plan("rls_select", _secured("SELECT id, owner, status FROM mine"), "SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status FROM orders WHERE (o_orderstatus = 'F' OR o_custkey = 7)")
    plan("rls_join", _secured("SELECT c.c_name, m.id FROM customer c JOIN (SELECT * FROM mine) m ON m.owner = c.c_custkey"), "SELECT c.c_name, o_orderkey AS id FROM customer c JOIN orders ON o_custkey = c_custkey WHERE (o_orderstatus = 'F' OR o_custkey = 7)")
    plan("rls_default_deny", _denied, "SELECT 0::BIGINT AS n")
    small = "CREATE TABLE t (id INTEGER PRIMARY KEY, owner INTEGER, status TEXT, price REAL); INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders;"
    rows = "SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status, o_totalprice AS price FROM orders"
    every = "SELECT id, owner, status, price FROM t"
    _stored("dml_insert_select", small, every, rows, "orders")
    _stored("dml_insert_defaults", "CREATE TABLE t (id SERIAL PRIMARY KEY, name TEXT DEFAULT 'none', n INTEGER DEFAULT 1 + 1); INSERT INTO t (name) VALUES ('a'), (DEFAULT); INSERT INTO t (id, name) VALUES (10, 'x'); INSERT INTO t DEFAULT VALUES", "SELECT id, name, n FROM t", "SELECT id::BIGINT AS id, name, 2::BIGINT AS n FROM (VALUES (1, 'a'), (2, 'none'), (10, 'x'), (11, 'none')) v(id, name)")
    _stored("dml_update", small + "UPDATE t SET price = price * 2, status = 'X' WHERE status = 'F'", every, f"SELECT id, owner, CASE WHEN status = 'F' THEN 'X' ELSE status END AS status, CASE WHEN status = 'F' THEN price * 2 ELSE price END AS price FROM ({rows})", "orders")
    _stored("dml_update_from", small + "UPDATE t SET status = c.c_mktsegment FROM customer c WHERE c.c_custkey = t.owner AND c.c_acctbal < 0", every, f"SELECT id, owner, coalesce(c_mktsegment, status) AS status, price FROM ({rows}) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_custkey = owner", "orders", "customer")
    _stored("dml_delete", small + "DELETE FROM t WHERE price > 200000.0", every, f"{rows} WHERE o_totalprice <= 200000.0", "orders")
    _stored("dml_delete_using", small + "DELETE FROM t USING customer c WHERE c.c_custkey = t.owner AND c.c_mktsegment = 'BUILDING'", every, f"SELECT * FROM ({rows}) WHERE owner NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "orders", "customer")
    upsert = "INSERT INTO t SELECT o_orderkey * 2, o_custkey, 'new', o_totalprice + 1 FROM orders ON CONFLICT (id) DO UPDATE SET status = excluded.status || t.status, price = excluded.price WHERE t.status <> 'P'"
    upserted = (
        "SELECT b.o_orderkey AS id, b.o_custkey AS owner, CASE WHEN n.o_orderkey IS NOT NULL AND b.o_orderstatus <> 'P' THEN 'new' || b.o_orderstatus ELSE b.o_orderstatus END AS status, "
        "CASE WHEN n.o_orderkey IS NOT NULL AND b.o_orderstatus <> 'P' THEN n.o_totalprice + 1 ELSE b.o_totalprice END AS price FROM orders b LEFT JOIN orders n ON n.o_orderkey * 2 = b.o_orderkey "
        "UNION ALL SELECT o_orderkey * 2, o_custkey, 'new', o_totalprice + 1 FROM orders WHERE o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)"
    )
    _stored("dml_upsert", small + upsert, every, upserted, "orders")
    _stored("dml_ignore_replace", small + "INSERT OR IGNORE INTO t VALUES (1, 0, 'never', 0.0), (-1, 0, 'new', 1.5); INSERT OR REPLACE INTO t VALUES (2, 5, 'put', 2.5)", every, f"{rows} WHERE o_orderkey <> 2 UNION ALL SELECT -1, 0, 'new', 1.5 UNION ALL SELECT 2, 5, 'put', 2.5", "orders")
    _stored("dml_transaction", small + "BEGIN; DELETE FROM t WHERE price > 200000.0; SAVEPOINT a; DELETE FROM t; ROLLBACK TO a; INSERT INTO t VALUES (-5, 1, 'kept', 0.5); COMMIT; BEGIN; DELETE FROM t; ROLLBACK", "SELECT count(*) AS n, min(id) AS lo FROM t", "SELECT (count(*) + 1)::BIGINT AS n, -5::BIGINT AS lo FROM orders WHERE o_totalprice <= 200000.0", "orders")
    _stored("ddl_alter", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT); INSERT INTO t SELECT r_regionkey, r_name FROM region; ALTER TABLE t ADD COLUMN score INTEGER DEFAULT 7; ALTER TABLE t RENAME COLUMN name TO label; ALTER TABLE t RENAME TO renamed", "SELECT id, label, score FROM renamed", "SELECT r_regionkey::BIGINT AS id, r_name AS label, 7::BIGINT AS score FROM region", "region")
    _stored("ddl_view", "CREATE TABLE t (n INTEGER); INSERT INTO t SELECT n_nationkey FROM nation; CREATE VIEW doubled AS SELECT n * 2 AS d FROM t; CREATE VIEW over AS SELECT d + 1 AS e FROM doubled WHERE d > 10", "SELECT e FROM over", "SELECT (n_nationkey * 2 + 1)::BIGINT AS e FROM nation WHERE n_nationkey > 5", "nation")
    _stored("catalog_relation", "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, n REAL UNIQUE DEFAULT 0)", "SHOW db.catalog", "SELECT * FROM (VALUES ('t', 'id', 'INTEGER', false, true, false, NULL), ('t', 'name', 'TEXT', true, false, false, NULL), ('t', 'n', 'REAL', false, false, true, '0')) v(tbl, col, typ, \"notnull\", pk, uniq, dflt)")
    plan("branch_isolation", _branch, "SELECT 'main' AS branch, n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 'main', 100, 'main' UNION ALL SELECT 'trial', n_nationkey, CASE WHEN n_nationkey = 1 THEN 'B1' ELSE n_name END FROM nation WHERE n_nationkey % 2 = 1")
    plan("time_travel", _past, "SELECT 'then' AS at, r_regionkey::BIGINT AS id FROM region UNION ALL SELECT 'now', r_regionkey FROM region WHERE r_regionkey <= 1")
    plan("export_roundtrip", _export, "SELECT event_id, event_type, value FROM events")
    plan("export_csv", _csv, "SELECT p_partkey, p_name, p_retailprice FROM part")
    plan("embed_to_one", _one, "SELECT n_nationkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
    plan("embed_to_many", _many, "SELECT r_regionkey, r_name, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
