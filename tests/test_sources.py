import time
from pathlib import Path

import pytest

from tidemill.errors import MisuseError, StorageError
from tidemill.sources.export import Materializer, materialize, snapshot


@pytest.fixture
def events(db):
    db.exec("CREATE TABLE events (id INTEGER PRIMARY KEY, kind TEXT, amount REAL); INSERT INTO events VALUES (1, 'click', 1.5), (2, 'view', 0.0), (3, 'cl,\"ick', 2.5), (4, NULL, 4.0)")
    return db


def test_snapshots(spark, events, tmp_path):
    for _ in range(2):  # the second replaces the first
        path = materialize(events, "events", str(tmp_path), ["id", "kind"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "click"), (2, "view"), (3, 'cl,"ick'), (4, None)]
    path = materialize(events, "events", str(tmp_path), format="csv")
    text = "".join(p.read_text() for p in sorted(Path(path).glob("*.csv")))
    assert text.startswith("id,kind,amount\n") and '"cl,""ick"' in text and "4,,4.0" in text
    assert snapshot(events, "events", str(tmp_path), "csv") == path
    for n in range(3):  # a reader's folder stays while the next one is written
        before = snapshot(events, "events", str(tmp_path))
        events.exec(f"INSERT INTO events VALUES ({10 + n}, 'more', 1)")
        held = spark.read.parquet(before)
        assert materialize(events, "events", str(tmp_path)) == snapshot(events, "events", str(tmp_path)) != before
        assert held.count() == 4 + n and spark.read.parquet(snapshot(events, "events", str(tmp_path))).count() == 5 + n
    assert len([p for p in (tmp_path / "events.parquet").iterdir() if p.is_dir()]) == 2
    with pytest.raises(StorageError):
        snapshot(events, "nothing", str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("db")) == ["events.csv", "events.parquet"]
    for bad in ("events; drop", "a b"):
        with pytest.raises(MisuseError):
            materialize(events, bad, str(tmp_path))
    with pytest.raises(MisuseError):
        materialize(events, "events", str(tmp_path), ["x-y"])


def test_materializer(spark, events, tmp_path):
    m = Materializer(events.db, ["events"], str(tmp_path / "out"), 0.05).start()
    until = time.time() + 20
    while m.runs < 2 and time.time() < until:
        time.sleep(0.05)
    m.stop()
    assert m.runs >= 2 and m.last_error is None
    assert spark.read.parquet(snapshot(events, "events", str(tmp_path / "out"))).count() == 4
