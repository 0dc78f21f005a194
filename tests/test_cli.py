from tidemill.__main__ import main


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    script = tmp_path / "seed.sql"
    script.write_text("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT); -- a comment; with a semicolon\nINSERT INTO t VALUES (1, 'a;b'), (2, NULL);\n")
    say = lambda *args: (main(["--root", root, *args]), capsys.readouterr().out)
    assert say("seed", str(script))[0] == 0
    assert say("tables") == (0, "t\n")
    assert say("sql", "SELECT * FROM t ORDER BY id") == (0, "id\tname\n1\ta;b\n2\t\n")
    assert say("sql", "DELETE FROM t WHERE id = 2") == (0, "1 rows changed\n")
    assert "t\tid\tINTEGER" in say("describe", "t")[1] and "commits\t3" in say("stats")[1]
    assert say("branch", "b") == (0, "b\nmain\n") and say("branch", "--drop", "b") == (0, "main\n")
    done, told = say("export", "t", str(tmp_path), "--format", "csv")
    assert done == 0 and told.startswith(f"{tmp_path}/t.csv/")
    assert say("sql", "SELECT nope FROM t")[0] == 1
    assert main(["--attach", "n=/root/testdata/sf0.001/nation.parquet", "sql", "SELECT count(*) AS n FROM n"]) == 0 and capsys.readouterr().out == "n\n25\n"
