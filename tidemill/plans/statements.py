"""Statements, settings, constraints, metadata and errors: what a connection answers, row by row."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import EngineError
from tidemill.plans.registry import dialect, plan
from tidemill.store.connection import Connection, Database

Rows = list[tuple]


def _report(name: str, columns: str, work: Callable[[Connection, str], Rows], sql: str, *sources: str) -> None:
    """Register the rows that ``work(connection, scratch folder)`` tells of a new store."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidemill.sources.scratch import scratch

        folder = scratch(spark, name)
        c = Database(spark, f"{folder}/store").attach_parquet(sf_dir, *sources).connect()
        return spark.createDataFrame(work(c, folder), columns)

    plan(name, run, sql)


def _told(c: Connection, *scripts: str) -> Rows:
    """For each script its text and ``ok``, or the class of its error."""
    out = []
    for script in scripts:
        try:
            c.exec(script)
            out.append((script, "ok"))
        except EngineError as e:
            out.append((script, type(e).__name__))
    return out


def _values(rows: Rows, *names: str) -> str:
    def cell(v: object) -> str:
        return "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else repr(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) v({', '.join(names)})"


_CREW = "CREATE TABLE crew (id INTEGER PRIMARY KEY, name TEXT NOT NULL, rank INTEGER CHECK (rank BETWEEN 1 AND 9), badge TEXT UNIQUE); INSERT INTO crew VALUES (1, 'Ines', 3, 'k1'), (2, 'Oda', 5, 'k2'), (3, 'Pim', NULL, NULL)"


def _by_url(c: Connection, folder: str) -> Rows:
    url = f"file://{folder}/by-url" if folder.startswith("/") else f"{folder}/by-url"
    other = Database(c.spark, url)
    other.attached = c.db.attached
    own = other.connect()
    own.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT); INSERT INTO t SELECT r_regionkey, r_name FROM region; DELETE FROM t WHERE id = 0")
    return Database(c.spark, url).connect().query("SELECT id, name FROM t").rows


def _guard(c: Connection, folder: str) -> Rows:
    from tidemill.sources.export import materialize

    c.exec(_CREW)
    out = []
    for name in ("crew", "crew; DROP TABLE crew", "crew name", '"crew"', "1crew", "../crew"):
        try:
            materialize(c, name, f"{folder}/out")
            out.append((name, "written"))
        except EngineError as e:
            out.append((name, type(e).__name__))
    return out


def _materializer(c: Connection, folder: str) -> Rows:
    from tidemill.sources.export import Materializer

    c.exec("CREATE TABLE t (id INTEGER PRIMARY KEY); INSERT INTO t SELECT n_nationkey FROM nation")
    m = Materializer(c.db, ["t"], f"{folder}/out", 3600)
    out = []
    for _ in range(2):
        (path,) = m.run_once()
        out.append((m.runs, c.spark.read.parquet(path).count()))
        c.exec("DELETE FROM t WHERE id >= 10")
    return out


def _seed(c: Connection, folder: str) -> Rows:
    from tidemill.__main__ import run

    script = "-- two statements\nCREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT);\nINSERT INTO t VALUES (1, 'a;b'), (2, 'c');\n"
    c.spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(f"{folder}/seed", lineSep="\n")
    run(c, argparse.Namespace(command="seed", script=f"{folder}/seed"))
    return c.query("SELECT id, v FROM t").rows


def _relationships(c: Connection, folder: str) -> Rows:
    c.exec("CREATE TABLE port (code TEXT PRIMARY KEY); CREATE TABLE ship (id INTEGER PRIMARY KEY, home TEXT REFERENCES port); CREATE TABLE call (ship INTEGER, at TEXT, CONSTRAINT of_ship FOREIGN KEY (ship) REFERENCES ship (id), FOREIGN KEY (at) REFERENCES port (code))")
    return [tuple(r) for r in c.query("SHOW db.relationships").df.collect()]


def _stats(c: Connection, folder: str) -> Rows:
    c.exec(_CREW + "; CREATE VIEW v AS SELECT id FROM crew; DELETE FROM crew WHERE id = 1")
    wanted = ("version", "commits", "tables", "views", "branches", "policies", "indexes", "in_transaction")
    return [tuple(r) for r in c.query("SHOW db.stats").df.collect() if r["metric"] in wanted]


def _policies(c: Connection, folder: str) -> Rows:
    c.exec(_CREW + "; CREATE POLICY b ON crew FOR SELECT TO mate, cook USING (rank < 5); CREATE POLICY a ON crew USING (id = 1) WITH CHECK (id > 0); DROP POLICY IF EXISTS none ON crew")
    return [(p["table"], p["name"], p["command"], ",".join(p["roles"]), p["using"], p["check"]) for p in c.policies()]


def _dimensions(c: Connection, folder: str) -> Rows:
    c.exec("CREATE TABLE v (id INTEGER PRIMARY KEY, e VECTOR(3))")
    out = _told(c, "INSERT INTO v VALUES (1, [1, 2, 3])", "INSERT INTO v VALUES (2, '[4,5,6]')", "INSERT INTO v VALUES (3, [1, 2])", "INSERT INTO v VALUES (4, NULL)", "UPDATE v SET e = '[1]' WHERE id = 1")
    for text in ("SELECT count(e <-> [1, 2, 3]) FROM v", "SELECT max(e <-> [1, 2]) FROM v"):
        try:
            out.append((text, str(c.query(text).rows[0][0])))
        except EngineError as e:
            out.append((text, type(e).__name__))
    return out


def _ef_search(c: Connection, folder: str) -> Rows:
    out = [("first", c.query("SHOW ef_search").rows[0][0])]
    c.exec("SET hnsw.ef_search = 100")
    out.append(("set", c.query("SHOW hnsw.ef_search").rows[0][0]))
    out.append(("other connection", c.db.connect().query("SHOW ef_search").rows[0][0]))
    c.exec("RESET ef_search")
    return [*out, ("reset", c.query("SHOW ef_search").rows[0][0])]


def _index(c: Connection, folder: str) -> Rows:
    c.exec("CREATE TABLE v (id INTEGER PRIMARY KEY, e VECTOR(3), t TEXT); CREATE INDEX near ON v USING hnsw (e vector_ip_ops) WITH (m = 8, ef_construction = 50, ef_search = 20); CREATE INDEX IF NOT EXISTS near ON v USING hnsw (e)")
    out = _told(c, "CREATE INDEX near ON v USING hnsw (e)", "CREATE INDEX x ON v USING hnsw (t)", "CREATE INDEX x ON v USING btree (id)", "CREATE INDEX x ON v USING hnsw (nothing)", "DROP INDEX nothing")
    i = c.manifest.table("v").indexes["near"]
    return [*out, *((k, str(i[k])) for k in ("column", "metric", "size", "m", "ef_construction", "ef_search"))]


def _returning(c: Connection, folder: str) -> Rows:
    c.exec(_CREW)
    out = []
    for text in ("INSERT INTO crew VALUES (4, 'Ada', 2, 'k4'), (5, 'Bo', 1, 'k5') RETURNING id, name || '!' AS said", "UPDATE crew SET rank = coalesce(rank, 0) + 1 WHERE id >= 3 RETURNING id, rank", "DELETE FROM crew WHERE name = 'Oda' RETURNING id, badge"):
        r = c.query(text)
        out += [(text.split()[0], r.changes, *(str(v) for v in row)) for row in r.rows]
    return out


def _counts(c: Connection, folder: str) -> Rows:
    c.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    return [(text, c.exec(text)) for text in ("INSERT INTO t SELECT c_custkey, c_nationkey FROM customer", "UPDATE t SET n = -1 WHERE n = 3", "UPDATE t SET n = 0 WHERE n = 99", "DELETE FROM t WHERE n < 5", "INSERT OR IGNORE INTO t SELECT c_custkey, 1 FROM customer")]


_BROKEN = [
    ("INSERT INTO crew VALUES (9, NULL, 1, 'z')", "ConstraintError"), ("INSERT INTO crew VALUES (9, 'x', 12, 'z')", "ConstraintError"), ("INSERT INTO crew VALUES (9, 'x', NULL, NULL)", "ok"), ("INSERT INTO crew VALUES (1, 'x', 1, 'z')", "ConstraintError"),
    ("INSERT INTO crew VALUES (10, 'x', 1, 'k2')", "ConstraintError"), ("INSERT INTO crew VALUES (10, 'x', 1, 'a'), (10, 'y', 1, 'b')", "ConstraintError"), ("UPDATE crew SET badge = 'k1'", "ConstraintError"), ("UPDATE crew SET badge = 'k9' WHERE id = 1", "ok"),
    ("INSERT INTO crew VALUES (1, 'Ines', 4, 'k2') ON CONFLICT (id) DO UPDATE SET badge = excluded.badge", "ConstraintError"), ("UPDATE crew SET id = id + 1", "ok"), ("INSERT INTO nowhere VALUES (1)", "SqlError"),
]


def _foreign(c: Connection, folder: str) -> Rows:
    c.exec("CREATE TABLE port (code TEXT PRIMARY KEY); CREATE TABLE ship (id INTEGER PRIMARY KEY, home TEXT REFERENCES port)")
    return _told(c, "INSERT INTO ship VALUES (1, 'nowhere')", "DELETE FROM port", "DROP TABLE port") + [("rows", str(c.query("SELECT count(*) FROM ship").rows[0][0]))]


def _first_wins(c: Connection, folder: str) -> Rows:
    c.exec("CREATE TABLE stock (id INTEGER PRIMARY KEY, n INTEGER); INSERT INTO stock VALUES (1, 10); CREATE TABLE log (what TEXT); INSERT INTO log VALUES ('start')")
    a, b = c.db.connect(), c.db.connect()
    a.exec("BEGIN; UPDATE stock SET n = n - 3")
    b.exec("BEGIN; UPDATE stock SET n = n - 5")
    out = [(f"a: {s}", r) for s, r in _told(a, "COMMIT")] + [(f"b: {s}", r) for s, r in _told(b, "COMMIT")]
    b.transaction(lambda x: x.exec("UPDATE stock SET n = n - 5"), retries=1)
    a.exec("BEGIN; INSERT INTO log VALUES ('a')")
    b.exec("BEGIN; INSERT INTO log VALUES ('b')")  # rows that are added to a table without keys don't conflict
    out += [(f"a log: {s}", r) for s, r in _told(a, "COMMIT")] + [(f"b log: {s}", r) for s, r in _told(b, "COMMIT")]
    return [*out, ("stock", str(c.query("SELECT n FROM stock").rows[0][0])), ("log", str(c.query("SELECT count(*) FROM log").rows[0][0]))]


def _retention(c: Connection, folder: str) -> Rows:
    import time

    c.exec("CREATE TABLE t (n INTEGER); INSERT INTO t VALUES (1)")
    then = time.time()
    time.sleep(0.02)
    c.exec("INSERT INTO t VALUES (2)")
    old = c.db.create_branch("old", at=then)
    out = [("branch of a time", str(old.query("SELECT count(*) FROM t").rows[0][0]))]
    kept = len(c.db.log.versions("main"))
    c.db.log.vacuum(keep=1, keep_seconds=3600)
    out.append(("kept for their age", str(len(c.db.log.versions("main")) == kept)))
    c.db.log.vacuum(keep=1)
    out += [("kept", str(len(c.db.log.versions("main")))), ("rows", str(c.query("SELECT count(*) FROM t").rows[0][0])), ("rows of the branch", str(old.query("SELECT count(*) FROM t").rows[0][0]))]
    try:
        c.db.connect(version=1)
        return [*out, ("old version", "ok")]
    except EngineError as e:
        return [*out, ("old version", type(e).__name__)]


def _show(c: Connection, folder: str) -> Rows:
    out = [(n, str(c.query(f"SHOW {n}").rows[0][0])) for n in ("transaction_isolation", "client_encoding", "role")]
    for text in ("EXPLAIN SELECT r_name FROM region WHERE r_regionkey > 2", "EXPLAIN ANALYZE SELECT 1"):
        r = c.query(text)
        out.append((text, f"{len(r.rows)} {r.columns[0]} {'Scan' in r.rows[0][0] or 'OneRow' in r.rows[0][0]}"))
    return out


_NOOPS = ["SET search_path TO public", "SET TIME ZONE 'UTC'", "PRAGMA foreign_keys = ON", "VACUUM", "ANALYZE", "DISCARD ALL", "SET TRANSACTION ISOLATION LEVEL SERIALIZABLE"]


def _prepared(c: Connection, folder: str) -> Rows:
    s = c.prepare("SELECT n_name FROM nation WHERE n_nationkey >= :low AND n_nationkey < $2 ORDER BY n_nationkey")
    out = []
    for low, high in ((3, 5), (20, 22)):
        s.bind("low", low).bind(2, high)
        while s.step():
            out.append((low, s.row[0]))
        s.reset()
    return out


def _written(c: Connection, folder: str) -> Rows:
    """Writes under a policy that lets a role see and write its own deck's rows."""
    c.exec(
        "CREATE TABLE cargo (id INTEGER PRIMARY KEY, deck TEXT, kg INTEGER); INSERT INTO cargo VALUES (1, 'fore', 10), (2, 'aft', 20), (3, 'fore', 30); ALTER TABLE cargo ENABLE ROW LEVEL SECURITY; "
        "CREATE POLICY own ON cargo FOR ALL TO mate USING (deck = auth.claim('deck')) WITH CHECK (deck = auth.claim('deck') AND kg < 100); SET ROLE mate; SET request.jwt.claims = '{\"deck\": \"fore\"}'"
    )
    out = _told(c, "INSERT INTO cargo VALUES (4, 'fore', 5)", "INSERT INTO cargo VALUES (5, 'aft', 5)", "INSERT INTO cargo VALUES (6, 'fore', 500)", "UPDATE cargo SET deck = 'aft' WHERE id = 1", "UPDATE cargo SET kg = 99 WHERE id = 1")
    out += [(text, str(c.exec(text))) for text in ("UPDATE cargo SET kg = 0 WHERE id = 2", "DELETE FROM cargo WHERE kg = 20", "DELETE FROM cargo WHERE id = 3")]
    c.exec("SET ROLE nobody")
    out += [("sum as nobody", str(c.query("SELECT sum(kg) FROM cargo").rows[0][0])), *_told(c, "INSERT INTO cargo VALUES (7, 'fore', 1)")]
    c.exec("SET rls.bypass = on")
    return [*out, ("sum of all", str(c.query("SELECT sum(kg) FROM cargo").rows[0][0]))]


_ERRORS = [("SELEC 1", "42601"), ("SELECT nothing FROM region", "42601"), ("INSERT INTO t VALUES (1)", "23000"), ("COMMIT", "25000"), ("BEGIN; CREATE TABLE x (i INTEGER)", "25000"), ("ROLLBACK", "ok")]


def _states(c: Connection, folder: str) -> Rows:
    c.exec("CREATE TABLE t (id INTEGER PRIMARY KEY); INSERT INTO t VALUES (1)")
    out = []
    for text, _ in _ERRORS:
        try:
            c.exec(text)
            out.append((text, "ok"))
        except EngineError as e:
            out.append((text, e.sqlstate))
    return out


def register() -> None:
    pair, said = "what string, told string", ("what", "told")
    _report("store_by_url", "id bigint, name string", _by_url, "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region WHERE r_regionkey <> 0", "region")
    _report("export_guard", pair, _guard, _values([("crew", "written"), *((n, "MisuseError") for n in ("crew; DROP TABLE crew", "crew name", '"crew"', "1crew", "../crew"))], *said))
    _report("materializer_runs", "run bigint, n bigint", _materializer, "SELECT 1::BIGINT AS run, count(*) AS n FROM nation UNION ALL SELECT 2, count(*) FROM nation WHERE n_nationkey < 10", "nation")
    _report("seed_script", "id bigint, v string", _seed, _values([(1, "a;b"), (2, "c")], "id", "v"))
    _report("show_relationships", "tbl string, name string, cols string, ftable string, fcols string", _relationships, _values([("call", "of_ship", "ship", "ship", "id"), ("call", "call_at_fkey", "at", "port", "code"), ("ship", "ship_home_fkey", "home", "port", "code")], "tbl", "name", "cols", "ftable", "fcols"))
    _report("show_stats", "metric string, value bigint", _stats, _values([("version", 4), ("commits", 4), ("tables", 1), ("views", 1), ("branches", 1), ("policies", 0), ("indexes", 0), ("in_transaction", 0)], "metric", "value"))
    _report("show_policies", "tbl string, name string, command string, roles string, using string, chk string", _policies, _values([("crew", "a", "ALL", "", "id = 1", "id > 0"), ("crew", "b", "SELECT", "mate,cook", "rank < 5", None)], "tbl", "name", "command", "roles", '"using"', "chk"))
    dialect("subquery_elsewhere", "SELECT n_name, CASE WHEN n_regionkey = (SELECT max(r_regionkey) FROM region) THEN 'last' ELSE 'other' END AS place FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey IN (SELECT c_nationkey FROM customer) WHERE n_nationkey > (SELECT min(n_nationkey) FROM nation)")
    dialect("in_select_unlike_kinds", "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_name FROM nation) OR r_regionkey NOT IN (SELECT n_name FROM nation WHERE n_nationkey > 3) AND r_regionkey > 1", "SELECT r_name FROM region WHERE r_regionkey > 1")
    dialect("cte_once", "WITH r AS (SELECT n_nationkey AS k, random() AS x FROM nation) SELECT count(*) AS n, sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS same FROM r a JOIN r b ON a.k = b.k", "SELECT count(*) AS n, count(*)::BIGINT AS same FROM nation")
    dialect("agg_json_numbers", "SELECT n_regionkey, json_agg(nullif(n_nationkey, 10)) AS keys, group_concat(n_nationkey, '+') AS sum FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, replace(to_json(list(nullif(n_nationkey, 10) ORDER BY nullif(n_nationkey, 10) NULLS LAST))::VARCHAR, ' ', '') AS keys, string_agg(n_nationkey::VARCHAR, '+' ORDER BY n_nationkey) AS sum FROM nation GROUP BY n_regionkey")
    dialect("fn_now_family", "SELECT length(current_date) AS d, length(current_time) AS t, length(now()) AS n, current_timestamp >= '2024-01-01' AS later, date('now') = current_date AS same", "SELECT 10::BIGINT AS d, 8::BIGINT AS t, 19::BIGINT AS n, true AS later, true AS same")
    _report("vec_dimension_error", pair, _dimensions, _values([("INSERT INTO v VALUES (1, [1, 2, 3])", "ok"), ("INSERT INTO v VALUES (2, '[4,5,6]')", "ok"), ("INSERT INTO v VALUES (3, [1, 2])", "SqlError"), ("INSERT INTO v VALUES (4, NULL)", "ok"), ("UPDATE v SET e = '[1]' WHERE id = 1", "SqlError"), ("SELECT count(e <-> [1, 2, 3]) FROM v", "2"), ("SELECT max(e <-> [1, 2]) FROM v", "SqlError")], *said))
    _report("ef_search_setting", pair, _ef_search, _values([("first", "64"), ("set", "100"), ("other connection", "64"), ("reset", "64")], *said))
    _report("index_definition", pair, _index, _values([*((t, "SqlError") for t in ("CREATE INDEX near ON v USING hnsw (e)", "CREATE INDEX x ON v USING hnsw (t)", "CREATE INDEX x ON v USING btree (id)", "CREATE INDEX x ON v USING hnsw (nothing)", "DROP INDEX nothing")), ("column", "e"), ("metric", "ip"), ("size", "3"), ("m", "8"), ("ef_construction", "50"), ("ef_search", "20")], *said))
    _report("dml_returning", "command string, n bigint, a string, b string", _returning, _values([("INSERT", 2, "4", "Ada!"), ("INSERT", 2, "5", "Bo!"), ("UPDATE", 3, "3", "1"), ("UPDATE", 3, "4", "3"), ("UPDATE", 3, "5", "2"), ("DELETE", 1, "2", "k2")], "command", "n", "a", "b"))
    _report(
        "dml_counts", "what string, n bigint", _counts,
        "SELECT 'INSERT INTO t SELECT c_custkey, c_nationkey FROM customer' AS what, count(*) AS n FROM customer UNION ALL SELECT 'UPDATE t SET n = -1 WHERE n = 3', count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'UPDATE t SET n = 0 WHERE n = 99', 0 "
        "UNION ALL SELECT 'DELETE FROM t WHERE n < 5', count(*) FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'INSERT OR IGNORE INTO t SELECT c_custkey, 1 FROM customer', count(*) FROM customer WHERE c_nationkey < 5",
        "customer",
    )
    _report("dml_constraints", pair, lambda c, _: (c.exec(_CREW), _told(c, *[t for t, _ in _BROKEN]))[1], _values(_BROKEN, *said))
    _report("foreign_keys_are_told", pair, _foreign, _values([("INSERT INTO ship VALUES (1, 'nowhere')", "ok"), ("DELETE FROM port", "ok"), ("DROP TABLE port", "ok"), ("rows", "1")], *said))
    _report("commit_first_wins", pair, _first_wins, _values([("a: COMMIT", "ok"), ("b: COMMIT", "ConflictError"), ("a log: COMMIT", "ok"), ("b log: COMMIT", "ok"), ("stock", "2"), ("log", "3")], *said))
    _report("retention", pair, _retention, _values([("branch of a time", "1"), ("kept for their age", "True"), ("kept", "1"), ("rows", "2"), ("rows of the branch", "1"), ("old version", "StorageError")], *said))
    _report("show_and_explain", pair, _show, _values([("transaction_isolation", "repeatable read"), ("client_encoding", "UTF8"), ("role", "anon"), ("EXPLAIN SELECT r_name FROM region WHERE r_regionkey > 2", "1 QUERY PLAN True"), ("EXPLAIN ANALYZE SELECT 1", "1 QUERY PLAN True")], *said), "region")
    _report("session_noops", pair, lambda c, _: _told(c, *_NOOPS), _values([(t, "ok") for t in _NOOPS], *said))
    _report("prepared_statement", "low bigint, name string", _prepared, "SELECT CASE WHEN n_nationkey < 10 THEN 3 ELSE 20 END::BIGINT AS low, n_name AS name FROM nation WHERE n_nationkey IN (3, 4, 20, 21)", "nation")
    _report(
        "rls_writes", pair, _written,
        _values([("INSERT INTO cargo VALUES (4, 'fore', 5)", "ok"), ("INSERT INTO cargo VALUES (5, 'aft', 5)", "ConstraintError"), ("INSERT INTO cargo VALUES (6, 'fore', 500)", "ConstraintError"), ("UPDATE cargo SET deck = 'aft' WHERE id = 1", "ConstraintError"), ("UPDATE cargo SET kg = 99 WHERE id = 1", "ok"),
                 ("UPDATE cargo SET kg = 0 WHERE id = 2", "0"), ("DELETE FROM cargo WHERE kg = 20", "0"), ("DELETE FROM cargo WHERE id = 3", "1"), ("sum as nobody", "None"), ("INSERT INTO cargo VALUES (7, 'fore', 1)", "ConstraintError"), ("sum of all", "124")], *said),
    )
    _report("error_states", pair, _states, _values(_ERRORS, *said), "region")
    _report("metadata_settings", "what string, told string", lambda c, _: [("before", c.query("SHOW app.shift").rows[0][0]), *(("set", x) for x in (c.query("SET app.shift = 'night'"), c.query("SHOW app.shift").rows[0][0])[1:]), ("reset", (c.exec("RESET shift"), c.query("SHOW app.shift").rows[0][0])[1])], _values([("before", ""), ("set", "night"), ("reset", "")], *said))
