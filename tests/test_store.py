"""The versioned store: definitions, constraints, changes, transactions, branches, policies, vectors and what concurrent writers do."""

import threading
import time

import pytest

from tidemill.errors import BusyError, ConflictError, ConstraintError, MisuseError, SqlError, StorageError, TransactionError
from tidemill.store import files
from tidemill.store.connection import Database

HIVES = "CREATE TABLE hives (hive INTEGER PRIMARY KEY, site TEXT NOT NULL, queen TEXT UNIQUE, frames INTEGER DEFAULT 4 * 2 + 2 CHECK (frames > 0), CONSTRAINT roomy CHECK (frames <= 40))"


@pytest.fixture
def hives(db):
    db.exec(HIVES + "; INSERT INTO hives VALUES (10, 'meadow', 'red', 10), (20, 'meadow', 'blue', 20), (30, 'wood', NULL, 30)")
    return db


def column(c, sql):
    return [r[0] for r in c.query(sql).rows]


# -- definitions and numbers -------------------------------------------------------
def test_defaults(db):
    db.exec(HIVES + "; INSERT INTO hives (hive, site) VALUES (1, 'a'); INSERT INTO hives VALUES (2, 'b', 'q', DEFAULT)")
    assert db.query("SELECT hive, queen, frames FROM hives ORDER BY hive").rows == [(1, None, 10), (2, "q", 10)]


def test_numbers_go_on_after_given_ones(db):
    db.exec("CREATE TABLE visits (n SERIAL PRIMARY KEY, day TEXT); INSERT INTO visits (day) VALUES ('mon'), ('tue'), ('wed')")
    db.exec("INSERT INTO visits VALUES (50, 'thu'); INSERT INTO visits (day) SELECT day || '2' FROM visits WHERE n < 3")
    assert column(db, "SELECT n FROM visits ORDER BY n") == [1, 2, 3, 50, 51, 52]


def test_altered_tables(hives):
    hives.exec("ALTER TABLE hives ADD COLUMN kg REAL DEFAULT 1.5; UPDATE hives SET kg = 9 WHERE hive = 30; ALTER TABLE hives RENAME COLUMN site TO place; ALTER TABLE hives DROP COLUMN queen; ALTER TABLE hives RENAME TO colonies")
    assert hives.query("SELECT * FROM colonies ORDER BY hive").rows == [(10, "meadow", 10, 1.5), (20, "meadow", 20, 1.5), (30, "wood", 30, 9.0)]
    hives.exec("CREATE TABLE IF NOT EXISTS colonies (x TEXT); DROP TABLE IF EXISTS wasps; CREATE TABLE honey (jar INTEGER, hive INTEGER REFERENCES colonies)")
    told = hives.relationships().collect()[0]
    assert (told["name"], told["ftable"], told["fcols"]) == ("honey_hive_fkey", "colonies", "hive")
    assert {r["tbl"] for r in hives.query("SHOW any.catalog").df.collect()} == {"colonies", "honey"}
    for bad in ("CREATE TABLE colonies (x TEXT)", "DROP TABLE wasps", "ALTER TABLE colonies DROP COLUMN hive", "ALTER TABLE colonies ADD COLUMN kg TEXT", "ALTER TABLE colonies RENAME TO honey", "CREATE TABLE twice (a TEXT, A TEXT)"):
        with pytest.raises(SqlError):
            hives.exec(bad)


def test_views(hives):
    hives.exec("CREATE VIEW big AS SELECT hive, frames FROM hives WHERE frames >= 20; CREATE VIEW twice AS SELECT hive, frames * 2 AS f FROM big")
    assert hives.query("SELECT f FROM twice ORDER BY f").rows == [(40,), (60,)]
    hives.exec("CREATE OR REPLACE VIEW big AS SELECT hive, frames FROM hives WHERE frames = 10")
    assert column(hives, "SELECT f FROM twice") == [20]
    for bad in ("CREATE VIEW big AS SELECT 1", "CREATE OR REPLACE VIEW big AS SELECT hive, f AS frames FROM twice", "CREATE VIEW none AS SELECT nothing FROM hives"):
        with pytest.raises(SqlError):
            hives.exec(bad)
    hives.exec("DROP VIEW big")
    with pytest.raises(SqlError):
        _ = hives.query("SELECT * FROM twice").rows


# -- constraints -------------------------------------------------------------------
@pytest.mark.parametrize(
    "bad",
    [
        "INSERT INTO hives VALUES (40, 'x', 'q', 0)", "INSERT INTO hives VALUES (40, 'x', 'q', 41)", "INSERT INTO hives VALUES (40, NULL, 'q', 5)", "INSERT INTO hives VALUES (NULL, 'x', 'q', 5)", "INSERT INTO hives VALUES (10, 'x', 'q', 5)",
        "INSERT INTO hives VALUES (40, 'x', 'blue', 5)", "UPDATE hives SET frames = frames + 15", "UPDATE hives SET queen = 'red' WHERE hive = 30", "UPDATE hives SET hive = 20 WHERE hive = 10", "INSERT INTO hives VALUES (10, 'x', 'blue', 5) ON CONFLICT (hive) DO UPDATE SET queen = excluded.queen",
        "INSERT OR REPLACE INTO hives VALUES (10, 'x', 'blue', 5)", "INSERT INTO hives VALUES (10, 'x', 'n', 5), (10, 'y', 'm', 5) ON CONFLICT (hive) DO UPDATE SET site = excluded.site",
    ],
)
def test_violations_change_nothing(hives, bad):
    before = hives.last_version
    with pytest.raises(ConstraintError):
        hives.exec(bad)
    assert hives.last_version == before and column(hives, "SELECT frames FROM hives ORDER BY hive") == [10, 20, 30]


def test_nulls_are_no_duplicates_and_keys_may_be_wide(hives):
    hives.exec("INSERT INTO hives VALUES (40, 'x', NULL, NULL); UPDATE hives SET hive = hive + 10")
    assert column(hives, "SELECT hive FROM hives ORDER BY hive") == [20, 30, 40, 50]
    hives.exec("CREATE TABLE readings (hive INTEGER, hour INTEGER, kg REAL, PRIMARY KEY (hive, hour)); INSERT INTO readings VALUES (1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5)")
    with pytest.raises(ConstraintError):
        hives.exec("INSERT INTO readings VALUES (2, 2, 1), (1, 2, 1)")


def test_vectors_have_their_size(db):
    db.exec("CREATE TABLE songs (id INTEGER, e VECTOR(2)); INSERT INTO songs VALUES (1, '[0.5, 2]'), (2, [3, 4])")
    assert db.query("SELECT e FROM songs ORDER BY id").rendered() == [("[0.5,2]",), ("[3,4]",)]
    for bad in ("INSERT INTO songs VALUES (3, [1, 2, 3])", "CREATE TABLE v (e VECTOR)", "CREATE INDEX i ON songs USING hnsw (id)"):
        with pytest.raises(SqlError):
            db.exec(bad)


# -- changes -----------------------------------------------------------------------
def test_changes_from_another_table(hives):
    hives.exec("CREATE TABLE added (at INTEGER, n INTEGER); INSERT INTO added VALUES (10, 3), (30, -20), (99, 1)")
    r = hives.query("UPDATE hives SET frames = frames + a.n FROM added a WHERE a.at = hives.hive RETURNING hive, frames")
    assert r.changes == 2 and sorted(r.rows) == [(10, 13), (30, 10)]
    assert hives.query("DELETE FROM hives USING added WHERE hive = added.at AND n > 0 RETURNING hive, site").rows == [(10, "meadow")]
    assert hives.exec("DELETE FROM hives WHERE site = 'sea'") == 0 and column(hives, "SELECT hive FROM hives ORDER BY hive") == [20, 30]


def test_upserts(hives):
    hives.exec("INSERT INTO hives VALUES (10, 'no', 'no', 1), (40, 'dune', 'x', 1) ON CONFLICT DO NOTHING")
    hives.exec("INSERT INTO hives VALUES (20, 'sea', 'blue', 2), (50, 'bog', 'y', 2) ON CONFLICT (hive) DO UPDATE SET frames = hives.frames + excluded.frames WHERE hives.site = 'meadow'")
    hives.exec("INSERT OR IGNORE INTO hives VALUES (40, 'no', 'no', 3); INSERT OR REPLACE INTO hives VALUES (30, 'a', 'p', 3), (30, 'b', 'p', 4)")
    assert hives.query("SELECT hive, site, frames FROM hives ORDER BY hive").rows == [(10, "meadow", 10), (20, "meadow", 22), (30, "b", 4), (40, "dune", 1), (50, "bog", 2)]


def test_only_touched_files_are_rewritten(hives):
    hives.exec("INSERT INTO hives VALUES (40, 'bog', 'x', 4)")
    before = hives.manifest.table("hives").files
    hives.exec("UPDATE hives SET frames = 5 WHERE hive = 40")
    assert len(set(before) & set(hives.manifest.table("hives").files)) == len(before) - 1
    assert column(hives, "SELECT frames FROM hives ORDER BY hive") == [10, 20, 30, 5]


# -- transactions and versions -------------------------------------------------------
def test_savepoints(hives):
    other = hives.db.connect()
    hives.exec("BEGIN; DELETE FROM hives WHERE hive = 10; SAVEPOINT one; INSERT INTO hives VALUES (60, 'x', 'x', 1); SAVEPOINT two; DELETE FROM hives; ROLLBACK TO two")
    assert column(hives, "SELECT hive FROM hives ORDER BY hive") == [20, 30, 60] and column(other, "SELECT count(*) FROM hives") == [3]
    with pytest.raises(TransactionError):
        hives.exec("DROP TABLE hives")
    hives.exec("ROLLBACK TO one; RELEASE one; INSERT INTO hives VALUES (70, 'y', 'y', 1); COMMIT")
    assert column(other, "SELECT hive FROM hives ORDER BY hive") == [20, 30, 70]
    hives.exec("BEGIN; DELETE FROM hives; ROLLBACK")
    assert column(other, "SELECT count(*) FROM hives") == [3]
    for bad in ("COMMIT", "ROLLBACK", "SAVEPOINT s", "RELEASE s"):
        with pytest.raises(TransactionError):
            hives.exec(bad)


def test_the_first_commit_wins(hives):
    hives.exec("CREATE TABLE weather (day TEXT)")
    a, b, c = (hives.db.connect() for _ in range(3))
    for x in (a, b, c):
        x.begin()
    a.exec("UPDATE hives SET frames = frames - 1")
    b.exec("UPDATE hives SET frames = frames - 2")
    c.exec("INSERT INTO weather VALUES ('fog')")
    a.commit()
    assert column(b, "SELECT frames FROM hives ORDER BY hive") == [8, 18, 28]  # its own snapshot still
    with pytest.raises(ConflictError):
        b.commit()
    c.commit()
    b.transaction(lambda x: x.exec("UPDATE hives SET frames = frames - 2"), retries=2)
    assert column(hives, "SELECT frames FROM hives ORDER BY hive") == [7, 17, 27] and column(hives, "SELECT day FROM weather") == ["fog"]


def test_rows_added_at_once_stay_together(db):
    db.exec("CREATE TABLE log (line TEXT); INSERT INTO log VALUES ('a'); CREATE TABLE keyed (k INTEGER PRIMARY KEY)")
    a, b = db.db.connect(), db.db.connect()
    for x, line in ((a, "b"), (b, "c")):
        x.exec(f"BEGIN; INSERT INTO log VALUES ('{line}')")
    a.commit()
    b.commit()
    assert column(db, "SELECT line FROM log ORDER BY line") == ["a", "b", "c"]
    a.exec("BEGIN; INSERT INTO keyed VALUES (1)")
    b.exec("BEGIN; INSERT INTO keyed VALUES (1)")
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    a.exec("BEGIN; INSERT INTO log VALUES ('d')")
    b.exec("BEGIN; DELETE FROM log WHERE line = 'a'")
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()


def test_statements_of_many_writers(db):
    """Single statements run again by themselves; none is lost."""
    db.exec("CREATE TABLE tally (id INTEGER PRIMARY KEY, n INTEGER); INSERT INTO tally VALUES (1, 0)")
    failed = []

    def work():
        c = db.db.connect()
        try:
            for _ in range(2):
                c.transaction(lambda x: x.exec("UPDATE tally SET n = n + 1"), retries=20)
            c.exec(f"INSERT INTO tally VALUES ({threading.get_ident()}, 0)")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sum(column(db, "SELECT n FROM tally")) == 6 + sum(column(db, "SELECT n FROM tally WHERE id <> 1")) and column(db, "SELECT count(*) FROM tally") == [4]


def test_moving_between_rows_keeps_the_sum(hives):
    for n in (4, -7):
        hives.transaction(lambda c, n=n: c.exec(f"UPDATE hives SET frames = frames - {n} WHERE hive = 20; UPDATE hives SET frames = frames + {n} WHERE hive = 10"))
    assert column(hives, "SELECT frames FROM hives ORDER BY hive") == [7, 23, 30]


def test_branches_and_the_past(hives):
    then = hives.last_version
    trial = hives.create_branch("trial")
    assert trial.manifest.table("hives").files == hives.manifest.table("hives").files  # nothing is copied
    trial.exec("DELETE FROM hives WHERE site = 'meadow'")
    moment = time.time()
    time.sleep(0.02)
    hives.exec("UPDATE hives SET site = 'sea' WHERE hive = 10")
    assert column(trial, "SELECT hive FROM hives") == [30] and column(hives, "SELECT site FROM hives ORDER BY hive") == ["sea", "meadow", "wood"]
    assert column(hives.db.connect(version=then), "SELECT site FROM hives WHERE hive = 10") == ["meadow"]
    assert column(hives.db.create_branch("before", at=moment), "SELECT site FROM hives WHERE hive = 10") == ["meadow"]
    for bad in (lambda: hives.db.connect(version=then).exec("DELETE FROM hives"), lambda: trial.create_branch("deeper"), lambda: hives.db.drop_branch("main"), lambda: hives.create_branch("a b"), lambda: hives.create_branch("trial")):
        with pytest.raises(MisuseError):
            bad()
    with pytest.raises(StorageError):
        hives.db.create_branch("ancient", at=1.0)
    hives.begin()
    with pytest.raises(TransactionError):
        hives.create_branch("inside")
    hives.rollback()
    for name in ("trial", "before"):
        hives.db.drop_branch(name)
    assert hives.db.branches() == ["main"]


def test_vacuum(spark, hives):
    hives.exec("UPDATE hives SET frames = 1 WHERE hive = 10; CREATE VIEW sites AS SELECT site FROM hives")
    again = Database(spark, hives.db.log.root).connect()
    kept = hives.db.log.versions("main")
    hives.db.log.vacuum(keep=1, keep_seconds=3600)
    assert hives.db.log.versions("main") == kept
    assert hives.db.log.vacuum(keep=1) > 0 and len(hives.db.log.versions("main")) == 1
    again.exec("INSERT INTO hives VALUES (40, 'bog', 'x', 2)")
    assert column(again, "SELECT site FROM sites ORDER BY site") == ["bog", "meadow", "meadow", "wood"]


def test_a_root_with_odd_characters(spark, tmp_path):
    c = Database(spark, str(tmp_path / "x y" / "ö%41")).connect()
    c.exec(HIVES + "; INSERT INTO hives VALUES (1, 'a', 'a', 1), (2, 'b', 'b', 2); DELETE FROM hives WHERE hive = 2; UPDATE hives SET site = 'c'")
    assert c.query("SELECT hive, site FROM hives").rows == [(1, "c")]


def test_claims(db, monkeypatch):
    """Where names can't be linked they are claimed: a dead writer's claim is taken over when it is old, and a claim that was taken is no longer one's own."""
    f = files.Files(db.spark)
    monkeypatch.setattr(files.Files, "_linked", files.Files._claimed)
    db.exec("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    p, fs = f._at(f"{db.db.log._path('main', db.last_version + 1)}.claim")
    assert f._claim(fs, p, "dead") and not f._claim(fs, p, "other") and f._owner(fs, p) == "dead"
    with pytest.raises(BusyError):
        db.exec("INSERT INTO t VALUES (1)")
    fs.setTimes(p, 1000, 1000)
    assert f._claim(fs, p, "taker") and f._owner(fs, p) == "taker"
    fs.setTimes(p, 1000, 1000)
    db.exec("INSERT INTO t VALUES (1)")
    assert column(db, "SELECT id FROM t") == [1]


def test_a_name_is_given_once(db, tmp_path):
    f, path = files.Files(db.spark), str(tmp_path / "v.json")
    f.create(path, "one")
    with pytest.raises(ConflictError):
        f.create(path, "two")
    assert f.read(path) == "one" and f.names(str(tmp_path)).count("v.json") == 1


# -- settings, policies, vectors -----------------------------------------------------
def test_settings(db):
    db.exec("SET statement_timeout TO '5s'; SET TIME ZONE 'Europe/Oslo'; PRAGMA cache_size = 10; VACUUM; ANALYZE; SET hnsw.ef_search = 12")
    assert db.query("SHOW statement_timeout").rows == [("5s",)] and db.query("SHOW ef_search").rows == [("12",)]
    db.exec("RESET ef_search")
    assert db.query("SHOW ef_search").rows == [("64",)] and db.query("EXPLAIN (FORMAT TEXT) SELECT 1").columns == ["QUERY PLAN"]
    assert dict(db.stats().collect())["tables"] == 0


@pytest.fixture
def guarded(hives):
    hives.exec("ALTER TABLE hives ENABLE ROW LEVEL SECURITY; CREATE POLICY keeper ON hives FOR ALL TO keeper USING (site = auth.claim('site')) WITH CHECK (site = auth.claim('site') AND frames < 35)")
    return hives


def become(c, site, role="keeper"):
    c.exec(f"SET ROLE {role}")
    c.query(f"SET request.jwt.claims = '{{\"sub\": \"u7\", \"site\": \"{site}\"}}'")


def test_policies_on_reads(guarded):
    assert column(guarded, "SELECT count(*) FROM hives") == [0]  # no policy for this role: nothing
    become(guarded, "meadow")
    assert guarded.query("SELECT auth.uid(), auth.role(), auth.claim('site')").rows == [("u7", "keeper", "meadow")]
    for text in ("SELECT hive FROM hives ORDER BY hive", "SELECT hive FROM (SELECT * FROM hives) h ORDER BY hive", "WITH w AS (SELECT hive FROM hives) SELECT hive FROM w ORDER BY hive", "SELECT DISTINCT a.hive FROM hives a JOIN hives b ON a.site = b.site ORDER BY a.hive"):
        assert column(guarded, text) == [10, 20]
    assert guarded.query("SELECT (SELECT max(hive) FROM hives) AS m").rows == [(20,)]
    become(guarded, "nowhere")
    assert column(guarded, "SELECT count(*) FROM hives") == [0]
    guarded.exec("SET rls.bypass = on")
    assert column(guarded, "SELECT count(*) FROM hives") == [3]
    guarded.exec("RESET rls.bypass; DROP POLICY keeper ON hives")
    become(guarded, "meadow")
    assert column(guarded, "SELECT count(*) FROM hives") == [0] and guarded.rls_enabled("hives") and guarded.policies() == []
    assert guarded.db.connect().query("SELECT auth.role(), auth.uid()").rows == [("anon", None)]


def test_policies_on_writes(guarded):
    become(guarded, "meadow")
    guarded.exec("INSERT INTO hives VALUES (40, 'meadow', 'x', 5)")
    for bad in ("INSERT INTO hives VALUES (50, 'wood', 'y', 5)", "INSERT INTO hives VALUES (50, 'meadow', 'y', 39)", "UPDATE hives SET site = 'wood'", "UPDATE hives SET frames = 38 WHERE hive = 10"):
        with pytest.raises(ConstraintError):
            guarded.exec(bad)
    assert guarded.exec("UPDATE hives SET frames = 1 WHERE hive = 30") == 0 and guarded.exec("DELETE FROM hives") == 3
    guarded.exec("SET rls.bypass = on")
    assert guarded.query("SELECT hive, frames FROM hives").rows == [(30, 30)] and guarded.policies()[0]["command"] == "ALL"


def test_nearest(db):
    """Points on a line, and one without a place; the index gives the metric."""
    db.exec("CREATE TABLE posts (id INTEGER PRIMARY KEY, at VECTOR(2)); CREATE INDEX by_place ON posts USING hnsw (at vector_l2_ops) WITH (m = 4); INSERT INTO posts VALUES " + ", ".join(f"({i}, [{i * i}, 1])" for i in range(60)) + ", (99, NULL)")
    assert db.manifest.table("posts").indexes["by_place"]["metric"] == "l2"
    exact = [r["id"] for r in db.nearest("posts", "at", [101, 1], 4).collect()]
    assert exact == [10, 9, 11, 8]
    db.exec("SET ef_search = 1000")
    assert [r["id"] for r in db.nearest("posts", "at", [101, 1], 4, approximate=True).collect()] == exact
    db.exec("DROP INDEX by_place")
    assert not db.manifest.table("posts").indexes


def test_kept_index(db, monkeypatch):
    """An index is written once, extended by what is added, and right after every change, in old versions and in branches."""
    db.exec("CREATE TABLE posts (id INTEGER PRIMARY KEY, at VECTOR(2), n INTEGER); CREATE INDEX by_place ON posts USING hnsw (at vector_l2_ops)")
    many = ", ".join(f"({i}, [{i * i}, 1], 0)" for i in range(40))
    db.exec(f"INSERT INTO posts VALUES {many}, (99, NULL, 0)")
    kept = db._index(db.manifest.table("posts").indexes["by_place"])
    assert len(kept.parts()) == 1 and len(kept.centres()) == 40
    then = db.last_version
    branch = db.create_branch("other")
    db.exec("SET ef_search = 1000; INSERT INTO posts VALUES (100, [101, 1], 0), (101, [99, 1], 0); DELETE FROM posts WHERE id = 10; UPDATE posts SET at = [100.5, 1] WHERE id = 1")
    assert len(kept.centres()) == 40 and len(kept.parts()) > 1

    def both(c, at=(101, 1), k=5):
        return [[(r["id"], round(r["distance"], 4)) for r in c.nearest("posts", "at", list(at), k, approximate=a).collect()] for a in (False, True)]

    exact, found = both(db)
    assert found == exact and [i for i, _ in found[:3]] == [100, 1, 101] and 10 not in dict(found)
    exact, found = both(db.db.connect(version=then))
    assert dict(found).keys() <= set(range(40)) and found[0] == exact[0]
    assert both(branch)[1][0] == (10, 1.0)
    db.exec("ALTER TABLE posts RENAME COLUMN at TO place")
    assert [r["id"] for r in db.nearest("posts", "place", [101, 1], 2, approximate=True).collect()] == [100, 1]
    db.exec("ALTER TABLE posts RENAME COLUMN place TO at; BEGIN; INSERT INTO posts VALUES (102, [101.1, 1], 0)")
    assert both(db)[0] == both(db)[1]
    db.exec("ROLLBACK")
    several = db.nearest_all("posts", "at", [(7, [49, 1]), (8, [64, 1])], 1, approximate=True)
    assert sorted((r["query"], r["id"]) for r in several.collect()) == [(7, 7), (8, 8)]
    monkeypatch.setattr("tidemill.store.vector_index.MOST_PARTS", 1)
    kept.compact(db.manifest.table("posts").files)
    assert len(kept.parts()) == 1 and both(db)[0] == both(db)[1]
    db.exec("DROP INDEX by_place")
    db.db.drop_branch("other")
    db.db.log.vacuum(keep=1)
    assert db.db.log.files.names(f"{db.db.log.root}/index") == []


def test_index_without_vectors(db):
    db.exec("CREATE TABLE e (v VECTOR(2)); CREATE INDEX i ON e USING hnsw (v vector_l2_ops)")
    assert db.nearest("e", "v", [1, 2], 3, approximate=True).count() == 0
    db.exec("INSERT INTO e VALUES (NULL)")
    assert db.nearest("e", "v", [1, 2], 3, approximate=True).count() == 0
    db.exec("INSERT INTO e VALUES ([1, 2]), ([1, 2]), ([5, 5])")
    assert [r["distance"] for r in db.nearest("e", "v", [1, 2], 2, approximate=True).collect()] == [0.0, 0.0]


def test_definitions_change_without_files(db):
    """A constant default, a new name and a dropped column leave the files alone, and rows right however they were written."""
    db.exec("CREATE TABLE jars (id INTEGER PRIMARY KEY, lid TEXT); INSERT INTO jars VALUES (1, 'red'), (2, 'blue')")
    files = db.manifest.table("jars").files
    db.exec("ALTER TABLE jars ADD COLUMN grams INTEGER DEFAULT 450; ALTER TABLE jars RENAME COLUMN lid TO colour; ALTER TABLE jars ADD COLUMN lid TEXT DEFAULT 'tin'")
    assert db.manifest.table("jars").files == files
    db.exec("INSERT INTO jars (id, grams) VALUES (3, NULL); ALTER TABLE jars ADD COLUMN shelf INTEGER DEFAULT 7")
    assert db.query("SELECT id, colour, grams, lid, shelf FROM jars ORDER BY id").rows == [(1, "red", 450, "tin", 7), (2, "blue", 450, "tin", 7), (3, None, None, "tin", 7)]
    db.exec("UPDATE jars SET grams = 500, shelf = NULL WHERE id = 1; INSERT INTO jars VALUES (4, 'green', 1, 'cork', 2); DELETE FROM jars WHERE id = 3")
    assert db.query("SELECT id, colour, grams, lid, shelf FROM jars ORDER BY id").rows == [(1, "red", 500, "tin", None), (2, "blue", 450, "tin", 7), (4, "green", 1, "cork", 2)]
    db.exec("ALTER TABLE jars DROP COLUMN lid; ALTER TABLE jars ADD COLUMN lid TEXT; ALTER TABLE jars ADD COLUMN mark TEXT DEFAULT ('m' || 1)")
    assert db.query("SELECT id, lid, mark FROM jars ORDER BY id").rows == [(1, None, "m1"), (2, None, "m1"), (4, None, "m1")]
    db.exec("ALTER TABLE jars ADD COLUMN n INTEGER DEFAULT 3")
    assert db.query("SELECT sum(n) FROM jars WHERE shelf = 7 OR shelf = 2").rows == [(6,)]
    then = db.last_version
    db.exec("ALTER TABLE jars RENAME COLUMN n TO many")
    assert db.db.connect(version=then).query("SELECT count(*) FROM jars WHERE n = 3").rows == [(3,)]
